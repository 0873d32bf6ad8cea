"""Journal attributes: quartiles, subject areas and open access of the sources, from an external journal table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, most_used, ratio, rounded, top
from folioscope.functions.textual import plain_title

# Columns of the journal file and their names here.
TEXTS = {"Sourceid": "scimago_id", "Title": "scimago_title", "Type": "source_type", "Publisher": "publisher", "Country": "publisher_country", "Region": "publisher_region", "Coverage": "coverage", "Categories": "categories", "Areas": "areas"}
NUMBERS = {
    "SJR": "sjr", "H index": "source_h_index", "Total Docs. (2025)": "docs_year", "Total Docs. (3years)": "docs_3y", "Total Refs.": "total_refs", "Total Citations (3years)": "citations_3y",
    "Citable Docs. (3years)": "citable_docs_3y", "Citations / Doc. (2years)": "citations_per_doc_2y", "Ref. / Doc.": "refs_per_doc", "%Female": "female_share", "Overton": "overton",
}
QUARTILES = ["Q1", "Q2", "Q3", "Q4", "Not indexed"]
ACCESS = ["Open access", "Subscription", "Unknown"]
SCHEMA = ", ".join([f"{x} string" for x in TEXTS.values()] + [f"{x} double" for x in NUMBERS.values()] + ["quartile string", "issns array<string>", "scimago_rank double", "open_access boolean", "open_access_diamond boolean"])


def plain_issn(column: Column) -> Column:
    """The eight characters of an ISSN; null for anything else."""
    text = F.upper(F.regexp_replace(column, "[^0-9Xx]", ""))
    return F.when(F.length(text) == 8, text)


def load_scimago(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A journal file (semicolons, decimal commas, bad lines left out) under the names used here; without a path, no journals."""
    if path is None:
        return spark.createDataFrame([], SCHEMA)
    raw = spark.read.csv(path, sep=";", header=True, inferSchema=False, mode="DROPMALFORMED", encoding="UTF-8")
    have = set(raw.columns)
    cell = lambda name: F.col(f"`{name}`") if name in have else F.lit(None).cast("string")
    text = lambda name: F.trim(F.regexp_replace(F.trim(cell(name)), '^"|"$', ""))
    number = lambda name: F.regexp_replace(F.regexp_replace(F.trim(cell(name)), r"\.", ""), ",", ".").try_cast("double")
    quartile = F.upper(F.trim(cell("SJR Best Quartile")))
    issns = F.array_compact(F.transform(F.split(F.regexp_replace(F.coalesce(cell("Issn"), F.lit("")), '"', ""), ","), plain_issn))
    flag = lambda name: F.lower(F.trim(cell(name))) == "yes"
    return raw.select(
        *(text(a).alias(b) for a, b in TEXTS.items()), *(number(a).alias(b) for a, b in NUMBERS.items()), F.when(quartile.isin(*QUARTILES[:4]), quartile).alias("quartile"),
        issns.alias("issns"), number("Rank").alias("scimago_rank"), flag("Open Access").alias("open_access"), flag("Open Access Diamond").alias("open_access_diamond"),
    )


def _journals(c: Corpus, journals: DataFrame | None) -> DataFrame:
    return load_scimago(c.documents.sparkSession) if journals is None else journals


@operator
def scimago_sources(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """Each source with its documents, citations and the journal it is: matched by ISSN, else by a title of 8 letters or more."""
    table = _journals(c, journals)
    docs = c.documents.where(filled("source")).withColumn("source", F.trim("source"))
    own = docs.groupBy("source").agg(F.countDistinct("eid").alias("documents"), F.sum(F.col("cited_by").cast("long")).alias("citations"))
    issn = most_used(docs.withColumn("k", plain_issn(F.col("issn"))), ["source"], "k")
    rows = own.join(issn, "source", "left").withColumn("title", plain_title(F.col("source")))
    order = F.struct(F.coalesce("scimago_rank", F.lit(float("inf"))), "scimago_id")
    rich = table.withColumn("j", F.struct(*table.columns))
    by_issn = rich.select(F.explode("issns").alias("k"), "j", "scimago_rank", "scimago_id").groupBy("k").agg(F.min_by("j", order).alias("ji"))
    by_title = rich.select(plain_title(F.col("scimago_title")).alias("title"), "j", "scimago_rank", "scimago_id").where(F.length("title") >= 8).groupBy("title").agg(F.min_by("j", order).alias("jt"))
    out = rows.join(by_issn, "k", "left").join(by_title, "title", "left").withColumn("j", F.coalesce("ji", "jt"))
    how = F.when(F.col("ji").isNotNull(), "issn").when(F.col("jt").isNotNull(), "title").otherwise("")
    out = out.select("source", "documents", "citations", how.alias("matched_by"), *(F.col(f"j.{x}").alias(x) for x in table.columns if x != "issns"))
    return out.orderBy(F.desc("documents"), "source")


def enrich_sources(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    return scimago_sources(c, journals)


def _weighted(c: Corpus, journals: DataFrame | None, key: Column) -> DataFrame:
    return scimago_sources(c, journals).withColumn("k", key)


def _fixed(c: Corpus, rows: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """Sources, documents, share and citations of every category of `rows` (k, documents, citations)."""
    sums = rows.groupBy(F.col("k").alias(key)).agg(F.count(F.lit(1)).alias("sources"), F.sum("documents").alias("documents"), F.sum("citations").alias("citations"))
    every = F.broadcast(c.documents.sparkSession.createDataFrame(list(enumerate(categories)), f"place int, {key} string"))
    out = every.join(sums, key, "left").na.fill(0, ["sources", "documents", "citations"])
    whole = F.sum("documents").over(Window.partitionBy())
    part, each = F.coalesce(ratio(F.col("documents"), whole, 1, 100), F.lit(0.0)), F.coalesce(ratio(F.col("citations"), F.col("documents"), 2), F.lit(0.0))
    return out.select("place", key, "sources", "documents", part.alias("share"), "citations", each.alias("citations_per_document")).orderBy("place").drop("place")


@operator
def quartile_distribution(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    return _fixed(c, _weighted(c, journals, F.coalesce("quartile", F.lit(QUARTILES[4]))), "quartile", QUARTILES)


@operator
def quartile_over_time(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """Documents of each quartile in each year that has documents; a document without a source isn't indexed."""
    spark = c.documents.sparkSession
    found = scimago_sources(c, journals).select("source", F.coalesce("quartile", F.lit(QUARTILES[4])).alias("quartile"))
    rows = c.documents.where("year is not null").select(F.trim("source").alias("source"), F.col("year").cast("long").alias("year"), "eid").join(found, "source", "left").na.fill(QUARTILES[4], ["quartile"])
    counts = rows.groupBy("year", "quartile").agg(F.countDistinct("eid").alias("documents"))
    every = F.broadcast(spark.createDataFrame(list(enumerate(QUARTILES)), "place int, quartile string"))
    out = rows.select("year").distinct().crossJoin(every).join(counts, ["year", "quartile"], "left").na.fill(0, ["documents"])
    share = ratio(F.col("documents"), F.sum("documents").over(Window.partitionBy("year")), 1, 100)
    return out.select("place", "year", "quartile", "documents", share.alias("share")).orderBy("year", "place").drop("place")


@operator
def scimago_coverage(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """What the matching found, one row; `available` tells whether there is a journal table at all."""
    rows = scimago_sources(c, journals).agg(
        F.count(F.lit(1)).alias("sources"), F.count(F.when(F.col("matched_by") != "", 1)).alias("matched_sources"), F.count(F.when(F.col("matched_by") == "issn", 1)).alias("matched_by_issn"),
        F.count(F.when(F.col("matched_by") == "title", 1)).alias("matched_by_title"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.when(F.col("matched_by") != "", F.col("documents"))), F.lit(0)).alias("matched_documents"),
    )
    available = _journals(c, journals).agg((F.count(F.lit(1)) > 0).alias("available"))
    share = F.coalesce(ratio(F.col("matched_documents"), F.col("documents"), 1, 100), F.lit(0.0))
    return F.broadcast(available).crossJoin(rows).withColumn("document_share", share)


def _split(column: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


@operator
def subject_areas(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """Areas of the journals; a journal of several areas counts for each, shares are of all documents with a source."""
    found = scimago_sources(c, journals)
    whole = F.broadcast(found.agg(F.sum("documents").alias("whole")))
    rows = found.select("source", "documents", "citations", F.explode(_split("areas")).alias("area"))
    sums = rows.groupBy("area").agg(F.countDistinct("source").alias("sources"), F.sum("documents").alias("documents"), F.sum("citations").alias("citations"))
    out = sums.crossJoin(whole).select("area", "sources", "documents", ratio(F.col("documents"), F.col("whole"), 1, 100).alias("share"), "citations")
    return out.orderBy(F.desc("documents"), F.desc("citations"), "area")


@operator
def subject_categories(c: Corpus, n: int | None = 25, journals: DataFrame | None = None) -> DataFrame:
    """Categories of the journals with the best quartile that a journal has in each."""
    rows = scimago_sources(c, journals).select("source", "documents", F.explode(_split("categories")).alias("t"))
    rows = rows.select("source", "documents", F.trim(F.regexp_replace("t", r"\(Q[1-4]\)\s*$", "")).alias("category"), F.nullif(F.regexp_extract("t", r"\((Q[1-4])\)\s*$", 1), F.lit("")).alias("q"))
    sums = rows.groupBy("category").agg(F.countDistinct("source").alias("sources"), F.sum("documents").alias("documents"), F.min("q").alias("best_quartile"))
    return top(sums, n, F.desc("documents"), F.desc("sources"), F.asc("category"))


@operator
def interdisciplinarity(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """Spread of documents over areas: Shannon's and Simpson's indices, evenness and the largest area, one row; without areas nulls."""
    areas = subject_areas(c, journals).withColumn("p", F.try_divide(F.col("documents").cast("double"), F.sum("documents").over(Window.partitionBy())))
    first = F.min_by(F.struct("area", "share"), F.struct(-F.col("documents"), -F.col("citations"), "area"))
    out = areas.agg(F.count(F.lit(1)).alias("areas"), (-F.sum(F.col("p") * F.log("p"))).alias("h"), (1 - F.sum(F.col("p") * F.col("p"))).alias("d"), first.alias("best"))
    even = F.when(F.col("areas") > 1, rounded(F.col("h") / F.log(F.col("areas").cast("double")), 3)).when(F.col("areas") == 1, 0.0)
    covered = scimago_coverage(c, journals).select("document_share")
    coverage = F.when(F.col("areas") > 0, F.col("document_share")).otherwise(0.0)
    return out.crossJoin(F.broadcast(covered)).select("areas", rounded(F.col("h"), 3).alias("shannon"), rounded(F.col("d"), 3).alias("simpson"), even.alias("evenness"), F.col("best.area").alias("top_area"), F.col("best.share").alias("top_area_share"), coverage.alias("coverage"))


@operator
def journal_open_access(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """Documents by the access of their journal; that of a journal not in the table is unknown."""
    kind = F.when(F.col("open_access"), ACCESS[0]).when(~F.col("open_access"), ACCESS[1]).otherwise(ACCESS[2])
    return _fixed(c, _weighted(c, journals, kind), "access", ACCESS)


@operator
def access_against_journals(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """Documents in open journals, and open documents outside them (none where there is no source at all)."""
    from folioscope.operators.access import document_access

    sources = scimago_sources(c, journals)
    found = sources.where("open_access").select("source")
    inside = c.documents.withColumn("source", F.trim("source")).join(found, "source", "left_semi").select("eid").distinct()
    outside = document_access(c).where("open").select("eid").join(inside, "eid", "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    known = sources.agg((F.count(F.lit(1)) > 0).alias("known"))
    out = inside.agg(F.count(F.lit(1)).alias("journal_open_documents")).crossJoin(F.broadcast(outside)).crossJoin(F.broadcast(known))
    return out.select("journal_open_documents", F.when(F.col("known"), F.col("outside")).otherwise(0).alias("disagreement"))
