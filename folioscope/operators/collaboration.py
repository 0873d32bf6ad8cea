"""Collaboration: authors per document and what follows from their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import author_key, filled, ratio, rounded
from folioscope.operators.geography import by_category


def authors_per_document(c: Corpus) -> DataFrame:
    """(eid, j): distinct author names of each document that has any."""
    return c.authors.where(filled("name")).groupBy("eid").agg(F.countDistinct("name").alias("j"))


def _author_count(c: Corpus) -> DataFrame:
    return c.authors.agg(F.countDistinct(author_key()).alias("authors"))


@operator
def collaboration_indicators(c: Corpus) -> DataFrame:
    """Degree of collaboration, Lawani's index, collaborative coefficient (plain and modified), documents per author."""
    counted = authors_per_document(c).groupBy("j").agg(F.count(F.lit(1)).alias("f"))
    sums = counted.agg(
        F.sum("f").alias("documents"), F.sum(F.when(F.col("j") == 1, F.col("f")).otherwise(0)).alias("single"), F.sum(F.col("j") * F.col("f")).alias("signed"),
        F.sum(F.col("f") / F.col("j").cast("double")).alias("parts"), F.max("j").alias("max_authors"),
    ).where("documents is not null").crossJoin(_author_count(c))
    n = F.col("documents").cast("double")
    cc = 1 - F.col("parts") / n
    modified = F.when(F.col("authors") > 1, rounded(F.try_divide(cc * F.col("authors"), (F.col("authors") - 1).cast("double")), 4)).otherwise(0.0)
    return sums.select(
        "documents", F.col("single").alias("single_authored"), (F.col("documents") - F.col("single")).alias("multi_authored"),
        rounded((F.col("documents") - F.col("single")) / n, 4).alias("degree_of_collaboration"), rounded(F.col("signed") / n, 4).alias("collaboration_index"),
        rounded(cc, 4).alias("collaborative_coefficient"), modified.alias("modified_collaborative_coefficient"), "authors", ratio(F.col("documents"), F.col("authors"), 4).alias("aapp"), "max_authors",
    )


@operator
def authorship_pattern(c: Corpus) -> DataFrame:
    counted = authors_per_document(c).groupBy(F.col("j").alias("authors")).agg(F.count(F.lit(1)).alias("documents"))
    return counted.select("authors", "documents", ratio(F.col("documents"), F.sum("documents").over(Window.partitionBy()), 2, 100).alias("share")).orderBy("authors")


BANDS = ["single", "two", "three", "multi"]


@operator
def cai(c: Corpus, block_years: int = 5) -> DataFrame:
    """Co-authorship index of each band of team sizes per block of years; 100 is the corpus average."""
    years = c.documents.where("year is not null").groupBy("eid").agg(F.min("year").cast("long").alias("year"))
    rows = authors_per_document(c).join(years, "eid").select("year", F.least("j", F.lit(4)).alias("band"))
    counts = rows.groupBy("year", "band").agg(F.count(F.lit(1)).alias("n"))
    bounds = F.broadcast(counts.agg(F.min("year").alias("y0"), F.max("year").alias("y1")))
    blocks = counts.crossJoin(bounds).withColumn("block", F.floor((F.col("year") - F.col("y0")) / block_years))
    table = blocks.groupBy("block", "y0", "y1").agg(F.sum("n").alias("documents"), *(F.sum(F.when(F.col("band") == i + 1, F.col("n")).otherwise(0)).alias(b) for i, b in enumerate(BANDS)))
    everything = Window.partitionBy()
    whole = F.sum("documents").over(everything)
    start = F.col("y0") + F.col("block") * block_years
    end = F.least(start + block_years - 1, F.col("y1"))
    period = F.when(end > start, F.concat(start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(start.cast("string"))
    index = lambda b: rounded(F.try_divide(F.col(b) / F.col("documents").cast("double"), F.sum(b).over(everything) / whole.cast("double")) * 100, 1)
    return table.select(period.alias("period"), "documents", *BANDS, *(index(b).alias(f"cai_{b}") for b in BANDS)).orderBy("period")


@operator
def price_law(c: Corpus) -> DataFrame:
    """Whether the square root of all authors sign half of the papers, one row."""
    per = c.author_rows().where("key is not null").groupBy("key").agg(F.countDistinct("eid").alias("d"))
    # counted by productivity first, so the ranking below is as long as there are different productivities
    levels = per.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = levels.withColumns({"t": F.sum("n").over(down), "s": F.sum(F.col("n") * F.col("d")).over(down)})
    whole = run.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("authors"), F.coalesce(F.sum(F.col("n") * F.col("d")), F.lit(0)).alias("signatures"))
    run = F.broadcast(whole).withColumn("core", F.rint(F.sqrt(F.col("authors").cast("double"))).cast("long")).join(run, F.lit(True), "left")
    before = F.col("t") - F.col("n")
    by_core = F.when(before < F.col("core"), (F.least("t", "core") - before) * F.col("d")).otherwise(0)
    half = F.col("signatures") / 2.0
    need = F.when((F.col("s") >= half) & (F.col("s") - F.col("n") * F.col("d") < half), before + F.ceil((half - (F.col("s") - F.col("n") * F.col("d"))) / F.col("d")))
    out = run.groupBy("authors", "signatures", "core").agg(F.sum(by_core).alias("held"), F.min(need).cast("long").alias("half_reached_with"))
    return out.select("authors", "signatures", F.col("core").alias("expected_core"), ratio(F.col("held"), F.col("signatures"), 1, 100).alias("observed_share"), "half_reached_with")


GROUPS = ["1 author", "2 authors", "3 authors", "4+ authors"]


@operator
def authorship_groups(c: Corpus) -> DataFrame:
    """Documents and citations by number of authors: one, two, three, four or more."""
    spark = c.documents.sparkSession
    rows = c.cited().join(authors_per_document(c), "eid").select(F.element_at(F.array(*map(F.lit, GROUPS)), F.least("j", F.lit(4)).cast("int")).alias("group"), F.col("cited_by").alias("cites"))
    sizes = F.broadcast(spark.createDataFrame([(g, i + 1) for i, g in enumerate(GROUPS)], "group string, min_authors long"))
    return by_category(c, rows, "group", GROUPS, "share").join(sizes, "group").select("group", "min_authors", "documents", "share", "citations", "citations_per_document").orderBy("min_authors")
