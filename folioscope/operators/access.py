"""Open access: status and routes of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import ratio
from folioscope.operators.geography import by_category

# The routes that a cell may name, and the one for open documents that name none.
ROUTES = ["Gold", "Hybrid", "Bronze", "Green", "Unspecified"]
STATUS = ["Open access", "Not flagged"]


def routes_of(column: Column) -> Column:
    """The routes an open-access cell names; open access without a route is unspecified."""
    text = F.lower(column)
    found = F.array_compact(F.array(*(F.when(text.rlike(rf"\b{r.lower()}\b"), r) for r in ROUTES[:4])))
    loose = F.when(text.rlike(r"\bopen\s*access\b"), F.array(F.lit(ROUTES[4]))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(loose)


def document_access(c: Corpus) -> DataFrame:
    d = c.documents.select("eid", F.col("year").cast("long").alias("year"), F.col("cited_by").cast("long").alias("cites"), routes_of(F.coalesce("open_access", F.lit(""))).alias("routes"))
    return d.withColumn("open", F.size("routes") > 0)


@operator
def access_status(c: Corpus) -> DataFrame:
    rows = document_access(c).select(F.when(F.col("open"), STATUS[0]).otherwise(STATUS[1]).alias("status"), "cites")
    return by_category(c, rows, "status", STATUS, "share")


@operator
def access_routes(c: Corpus) -> DataFrame:
    """Documents of each route; a document may take several, shares are of the open documents."""
    spark = c.documents.sparkSession
    rows = document_access(c).where("open")
    counted = rows.select("cites", F.explode("routes").alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("documents"), F.sum("cites").alias("citations"))
    whole = F.broadcast(rows.agg(F.count(F.lit(1)).alias("whole")))
    every = F.broadcast(spark.createDataFrame(list(enumerate(ROUTES)), "place int, route string"))
    out = every.join(counted, "route", "left").na.fill(0, ["documents", "citations"]).crossJoin(whole)
    part, each = F.coalesce(ratio(F.col("documents"), F.col("whole"), 1, 100), F.lit(0.0)), F.coalesce(ratio(F.col("citations"), F.col("documents"), 2), F.lit(0.0))
    return out.orderBy("place").select("route", "documents", part.alias("share_of_open"), "citations", each.alias("citations_per_document"))


@operator
def access_over_time(c: Corpus) -> DataFrame:
    rows = document_access(c).where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("open").cast("long")).alias("open_access"))
    return rows.select("year", "documents", "open_access", ratio(F.col("open_access"), F.col("documents"), 1, 100).alias("share")).orderBy("year")


@operator
def access_summary(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """Documents, those that report access, the open ones, and how that agrees with their journals' access, one row.

    A cell that names no route counts as not reported, so reported documents are the open ones. `disagreement` counts open documents
    whose journal isn't open; it is 0 in a corpus without sources.
    """
    from folioscope.operators.journals import access_against_journals

    sums = document_access(c).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("open"), 1)).alias("open_documents"))
    share = F.when(F.col("open_documents") > 0, 100.0)
    out = sums.crossJoin(F.broadcast(access_against_journals(c, journals)))
    return out.select("documents", F.col("open_documents").alias("reported"), "open_documents", share.alias("open_share_of_reported"), "journal_open_documents", "disagreement")
