"""Production: who and what the documents come from, with full counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import INDEPENDENT, filled, most_used, ratio, top, year_grid

_RUNNING = (Window.unboundedPreceding, Window.currentRow)


def documents_and_citations(c: Corpus, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """`documents` and `citations` of each key, from distinct (eid, keys) pairs."""
    counted = pairs.join(c.cited(), "eid", "left").groupBy(*keys)
    return counted.agg(F.countDistinct("eid").alias("documents"), F.coalesce(F.sum("cited_by"), F.lit(0)).alias("citations"))


def counts_over_time(c: Corpus, pairs: DataFrame, key: str, n: int, value: str = "documents") -> DataFrame:
    """Yearly and cumulative documents of the `n` keys with most dated documents, on the years those keys span."""
    dated = pairs.join(c.cited().where("year is not null").select("eid", "year").distinct(), "eid").select(key, "eid", "year").distinct()
    kept = F.broadcast(dated.groupBy(key).agg(F.countDistinct("eid").alias("_d")).orderBy(F.col("_d").desc(), key).limit(n).select(key))
    dated = dated.join(kept, key, "left_semi")
    counts = dated.groupBy(key, "year").agg(F.countDistinct("eid").alias(value))
    grid = kept.crossJoin(F.broadcast(year_grid(dated)))
    filled_in = grid.join(counts, [key, "year"], "left").withColumn(value, F.coalesce(value, F.lit(0)))
    running = Window.partitionBy(key).orderBy("year").rowsBetween(*_RUNNING)
    return filled_in.withColumn("cumulative", F.sum(value).over(running))


@operator
def production_by_year(c: Corpus) -> DataFrame:
    years = c.cited().where("year is not null").groupBy("year").agg(F.countDistinct("eid").alias("documents"), F.sum("cited_by").alias("citations"))
    full = year_grid(years).join(years, "year", "left").na.fill(0, ["documents", "citations"])
    running = Window.orderBy("year").rowsBetween(*_RUNNING)
    return full.select("year", "documents", "citations", ratio(F.col("citations"), F.col("documents"), 2).alias("citations_per_doc"), F.sum("documents").over(running).alias("cumulative")).orderBy("year")


@operator
def production_by_country(c: Corpus, n: int | None = None) -> DataFrame:
    pairs = c.affiliations.where(filled("country")).select("eid", "country").distinct()
    return top(documents_and_citations(c, pairs, ["country"]), n, F.desc("documents"), F.desc("citations"), F.asc("country"))


@operator
def top_institutions(c: Corpus, n: int | None = 20, level: str = "parent") -> DataFrame:
    pairs = c.organisations(level).groupBy("eid", "org").agg(F.min_by("country", F.struct("aff_pos", "country")).alias("country"))
    ranked = documents_and_citations(c, pairs, ["org"]).join(most_used(pairs, ["org"], "country"), "org", "left")
    return top(ranked.select(F.col("org").alias("institution"), "documents", "citations", "country"), n, F.desc("documents"), F.desc("citations"), F.asc("institution"))


@operator
def institutions_over_time(c: Corpus, n: int = 10, level: str = "parent") -> DataFrame:
    pairs = c.organisations(level).select(F.col("org").alias("institution"), "eid").distinct()
    return counts_over_time(c, pairs, "institution", n).orderBy("institution", "year")


@operator
def institutions_by_country(c: Corpus, n: int | None = 20, level: str = "parent") -> DataFrame:
    pairs = c.organisations(level).where(filled("country")).select("eid", "org", "country").distinct()
    each = pairs.groupBy("country", "org").agg(F.countDistinct("eid").alias("d"))
    best = each.groupBy("country").agg(F.countDistinct("org").alias("institutions"), F.min_by("org", F.struct(-F.col("d"), "org")).alias("top_institution"))
    whole = pairs.groupBy("country").agg(F.countDistinct("eid").alias("documents"))
    return top(best.join(whole, "country").select("country", "institutions", "documents", "top_institution"), n, F.desc("documents"), F.desc("institutions"), F.asc("country"))


@operator
def org_hierarchy(c: Corpus, n: int | None = 20, min_documents: int = 1) -> DataFrame:
    base = c.institution_rows().where(F.col("institution") != INDEPENDENT).withColumnRenamed("institution", "parent")
    units = documents_and_citations(c, base.where(filled("subparent")).select("eid", "parent", "subparent").distinct(), ["parent", "subparent"])
    totals = base.groupBy("parent").agg(F.countDistinct("eid").alias("parent_documents"))
    shares = units.join(totals, "parent").where(F.col("documents") >= min_documents)
    out = shares.select("parent", "subparent", "documents", "citations", "parent_documents", ratio(F.col("documents"), F.col("parent_documents"), 1, 100).alias("share"))
    return top(out, n, F.desc("parent_documents"), F.asc("parent"), F.desc("documents"), F.asc("subparent"))


@operator
def top_authors(c: Corpus, n: int | None = 20) -> DataFrame:
    rows = c.author_rows().where("key is not null")
    cites = rows.join(c.cited(), "eid", "left").groupBy("key").agg(
        F.countDistinct("eid").alias("documents"), F.coalesce(F.sum("cited_by"), F.lit(0)).alias("citations"), F.min("scopus_id").alias("scopus_id"),
        F.sum(F.when(F.col("position") == 1, 1).otherwise(0)).alias("first_author"),
    )
    named = cites.join(most_used(rows, ["key"], "name"), "key")
    return top(named.select(F.col("name").alias("author"), "scopus_id", "documents", "citations", "first_author", "key"), n, F.desc("documents"), F.desc("citations"), F.asc("key")).drop("key")


@operator
def top_sources(c: Corpus, n: int | None = 20) -> DataFrame:
    pairs = c.documents.where(filled("source")).select("source", "eid", F.col("cited_by").cast("long").alias("cited_by"))
    counted = pairs.groupBy("source").agg(F.countDistinct("eid").alias("documents"), F.sum("cited_by").alias("citations"))
    return top(counted, n, F.desc("documents"), F.desc("citations"), F.asc("source"))


@operator
def top_sources_ranked(c: Corpus, n: int | None = 20) -> DataFrame:
    return top_sources(c, n)


def keyword_rows(c: Corpus, kind: str) -> DataFrame:
    """Keywords of a kind with their plain form in `norm`."""
    if kind not in ("author", "index", "all"):
        raise ValueError(f"kind must be 'author', 'index' or 'all', not {kind!r}")
    rows = c.keywords if kind == "all" else c.keywords.where(F.col("kind") == kind)
    return rows.where(filled("keyword")).withColumn("norm", F.lower(F.trim("keyword")))


@operator
def top_keywords(c: Corpus, n: int | None = 30, kind: str = "author") -> DataFrame:
    rows = keyword_rows(c, kind)
    counted = rows.groupBy("norm").agg(F.countDistinct("eid").alias("documents")).join(most_used(rows.withColumn("keyword", F.trim("keyword")), ["norm"], "keyword"), "norm")
    return top(counted.select("keyword", "documents", "norm"), n, F.desc("documents"), F.asc("norm")).drop("norm")


@operator
def document_types(c: Corpus) -> DataFrame:
    counted = c.documents.where(filled("doc_type")).groupBy("doc_type").agg(F.countDistinct("eid").alias("documents"))
    whole = F.sum("documents").over(Window.partitionBy())
    return counted.select("doc_type", "documents", ratio(F.col("documents"), whole, 1, 100).alias("share")).orderBy(F.desc("documents"), "doc_type")
