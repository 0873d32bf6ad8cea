"""Impact: citation indices of the corpus, of authors, institutions, sources, countries and cities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import citation_indices, filled, m_index, most_used, ratio, rounded, top


@operator
def impact(c: Corpus) -> DataFrame:
    rows = c.cited().withColumn("all", F.lit(1))
    totals = rows.groupBy("all").agg(F.count(F.lit(1)).alias("documents"), F.sum("cited_by").alias("citations"), F.sum(F.when(F.col("cited_by") == 0, 1).otherwise(0)).alias("uncited"))
    both = totals.join(citation_indices(rows, ["all"]), "all")
    return both.select("documents", "citations", ratio(F.col("citations"), F.col("documents"), 2).alias("citations_per_doc"), "h_index", "g_index", "i10_index", "e_index", "uncited")


def _scores(c: Corpus, pairs: DataFrame, keys: list[str], min_documents: int = 1) -> DataFrame:
    """Counts, years and indices of each key from distinct (eid, keys) pairs."""
    rows = pairs.join(c.cited(), "eid", "left").withColumn("cited_by", F.coalesce("cited_by", F.lit(0)))
    counted = rows.groupBy(*keys).agg(F.countDistinct("eid").alias("documents"), F.sum("cited_by").alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    joined = counted.where(F.col("documents") >= min_documents).join(citation_indices(rows, keys), keys).crossJoin(c.last_year())
    return joined.withColumn("m_index", m_index(F.col("h_index"), F.col("first_year"), F.col("last_corpus_year"))).drop("last_corpus_year")


@operator
def authors_impact(c: Corpus, n: int | None = 20, min_documents: int = 1) -> DataFrame:
    rows = c.author_rows().where("key is not null")
    pairs = rows.select("key", "eid").distinct()
    scores = _scores(c, pairs, ["key"], min_documents)
    place = rows.groupBy("key", "eid").agg(F.min("position").alias("p"))
    at = lambda k: F.sum(F.when(F.col("p") == k, 1).otherwise(0))
    places = place.groupBy("key").agg(at(1).alias("first_author"), at(2).alias("second_author"), at(3).alias("third_author"), F.count(F.lit(1)).alias("signed"))
    ids = rows.groupBy("key").agg(F.min("scopus_id").alias("scopus_id"))
    out = scores.join(places, "key").join(ids, "key").join(most_used(rows, ["key"], "name"), "key")
    later = F.col("signed") - F.col("first_author") - F.col("second_author") - F.col("third_author")
    columns = [
        "m_index", F.col("name").alias("author"), "scopus_id", "documents", "citations", "h_index", "g_index", "i10_index", "e_index",
        "first_author", "second_author", "third_author", later.alias("later_author"), "first_year", "last_year", "key",
    ]
    return top(out.select(*columns), n, F.desc("h_index"), F.desc("citations"), F.desc("documents"), F.asc("key")).drop("key")


@operator
def institutions_impact(c: Corpus, n: int | None = 20, level: str = "parent") -> DataFrame:
    pairs = c.organisations(level).groupBy("eid", "org").agg(F.min_by("country", F.struct("aff_pos", "country")).alias("country"))
    scores = _scores(c, pairs.select("eid", "org"), ["org"]).join(most_used(pairs, ["org"], "country"), "org", "left")
    out = scores.select(F.col("org").alias("institution"), "documents", "citations", "h_index", "g_index", "m_index", "first_year", "country")
    return top(out, n, F.desc("h_index"), F.desc("citations"), F.desc("documents"), F.asc("institution"))


def _unit_impact(c: Corpus, pairs: DataFrame, key: str, n: int | None, min_documents: int) -> DataFrame:
    out = _scores(c, pairs, [key], min_documents).select(key, "documents", "citations", "h_index", "g_index", "m_index", "first_year", "last_year")
    return top(out, n, F.desc("h_index"), F.desc("citations"), F.desc("documents"), F.asc(key))


@operator
def sources_impact(c: Corpus, n: int | None = 20, min_documents: int = 1) -> DataFrame:
    rows = c.documents.where(filled("source")).select("eid", "source").distinct()
    return _unit_impact(c, rows, "source", n, min_documents)


@operator
def countries_impact(c: Corpus, n: int | None = 20, min_documents: int = 1) -> DataFrame:
    rows = c.affiliations.where(filled("country")).select("eid", "country").distinct()
    return _unit_impact(c, rows, "country", n, min_documents)


@operator
def normalized_citations(c: Corpus) -> DataFrame:
    rows = c.documents.select("eid", F.col("year").cast("long").alias("year"), F.col("cited_by").cast("long").alias("citations"))
    # the means are aggregated and joined back: a year may hold a large share of the documents
    means = rows.where("year is not null").groupBy("year").agg(F.avg("citations").alias("mean"))
    joined = rows.join(F.broadcast(means), "year", "left")
    score = F.when(F.col("mean") > 0, rounded(F.col("citations") / F.col("mean"), 3)).otherwise(0.0)
    return joined.select("eid", "citations", rounded(F.coalesce("mean", F.lit(0.0)), 2).alias("year_mean_citations"), score.alias("normalized_citations"))
