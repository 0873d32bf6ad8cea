"""Authors, keywords, sources and mean citations over the years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, most_used, ratio, rounded
from folioscope.operators.production import counts_over_time, keyword_rows


@operator
def authors_over_time(c: Corpus, n: int = 12) -> DataFrame:
    """Yearly documents and citations of the most productive names, only in years they published."""
    pairs = c.authors.where(filled("name")).select("name", "eid").distinct()
    rows = pairs.join(c.cited().where("year is not null"), "eid").crossJoin(c.last_year())
    kept = F.broadcast(rows.groupBy("name").agg(F.countDistinct("eid").alias("d")).orderBy(F.desc("d"), "name").limit(n).select("name"))
    counts = rows.join(kept, "name", "left_semi").groupBy("name", "year", "last_corpus_year").agg(F.countDistinct("eid").alias("documents"), F.sum("cited_by").alias("citations"))
    running = Window.partitionBy("name").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_year = ratio(F.col("citations"), F.col("last_corpus_year") - F.col("year") + 1, 2)
    return counts.select(F.col("name").alias("author"), "year", "documents", "citations", per_year.alias("citations_per_year"), F.sum("documents").over(running).alias("cumulative")).orderBy("author", "year")


@operator
def word_dynamics(c: Corpus, n: int = 10, kind: str = "author") -> DataFrame:
    """Yearly and cumulative occurrences of the most used keywords."""
    rows = keyword_rows(c, kind)
    names = most_used(rows.withColumn("keyword", F.trim("keyword")), ["norm"], "keyword")
    counts = counts_over_time(c, rows.select("norm", "eid").distinct(), "norm", n, "occurrences")
    return counts.join(names, "norm").select("year", "keyword", "occurrences", "cumulative").orderBy("keyword", "year")


@operator
def sources_over_time(c: Corpus, n: int = 8) -> DataFrame:
    pairs = c.documents.where(filled("source")).select("source", "eid").distinct()
    return counts_over_time(c, pairs, "source", n).select("source", "year", "documents", "cumulative").orderBy("source", "year")


@operator
def average_citations_per_year(c: Corpus) -> DataFrame:
    """Mean citations of each year's documents, also per year since they could be cited."""
    rows = c.cited().where("year is not null").groupBy("year").agg(F.countDistinct("eid").alias("documents"), F.avg("cited_by").alias("mean")).crossJoin(c.last_year())
    age = F.col("last_corpus_year") - F.col("year") + 1
    return rows.select("year", "documents", rounded(F.col("mean"), 2).alias("mean_citations"), age.alias("citable_years"), rounded(F.col("mean") / age, 2).alias("mean_citations_per_year")).orderBy("year")
