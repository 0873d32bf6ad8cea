"""Ages of cited references, and spectroscopy of their years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, ratio, rounded


def reference_ages(c: Corpus) -> DataFrame:
    """(eid, year, age) of references whose document and whose own year are known; 2 years ahead count as 0, others are errors."""
    rows = c.references.where("ref_year is not null").select("eid", "ref_year").join(c.cited().where("year is not null").select("eid", "year"), "eid")
    return rows.withColumn("age", F.col("year") - F.col("ref_year")).where("age between -2 and 200").select("eid", "year", F.greatest("age", F.lit(0)).alias("age"))


def _counted(c: Corpus, *keys: str) -> DataFrame:
    return reference_ages(c).groupBy(*keys, "age").agg(F.count(F.lit(1)).alias("n"))


def _median(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median of counted ages: the mean of the two middle ones."""
    up = Window.partitionBy(*keys).orderBy("age").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counted.withColumns({"t": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(*keys))})
    reach = lambda k: F.min(F.when(F.col("t") >= k, F.col("age")))
    return run.groupBy(*keys).agg(((reach(F.floor((F.col("all") + 1) / 2)) + reach(F.floor((F.col("all") + 2) / 2))) / 2.0).alias("median_age"))


def _sums(counted: DataFrame, keys: list[str], window: int) -> DataFrame:
    young = F.when(F.col("age") < window, F.col("n")).otherwise(0)
    return counted.groupBy(*keys).agg(F.sum("n").alias("references"), F.sum(young).alias("young"), F.sum(F.col("n") * F.col("age")).alias("years"))


@operator
def price_index(c: Corpus, window: int = 5) -> DataFrame:
    """Percentage of references younger than `window` years, median and mean age, one row."""
    counted = _counted(c).withColumn("k", F.lit(1))
    docs = reference_ages(c).agg(F.countDistinct("eid").alias("documents_with_references"))
    out = F.broadcast(docs).withColumn("k", F.lit(1)).join(_sums(counted, ["k"], window).join(_median(counted, ["k"]), "k"), "k", "left")
    half, count = rounded(F.col("median_age"), 1), F.coalesce("references", F.lit(0)).alias("references")
    share, mean = ratio(F.col("young"), F.col("references"), 1, 100), ratio(F.col("years"), F.col("references"), 1)
    return out.select(share.alias("price_index"), count, half.alias("median_age"), mean.alias("mean_age"), half.alias("half_life"), "documents_with_references", F.lit(window).cast("long").alias("window"))


@operator
def price_index_by_year(c: Corpus, window: int = 5) -> DataFrame:
    counted = _counted(c, "year")
    docs = reference_ages(c).groupBy("year").agg(F.countDistinct("eid").alias("documents"))
    out = _sums(counted, ["year"], window).join(docs, "year").join(_median(counted, ["year"]), "year")
    return out.select("year", "documents", "references", ratio(F.col("young"), F.col("references"), 1, 100).alias("price_index"), rounded(F.col("median_age"), 1).alias("median_age")).orderBy("year")


@operator
def reference_age_distribution(c: Corpus, max_age: int = 40) -> DataFrame:
    """References by age up to `max_age`, ages without any included; shares are of all references."""
    counted = _counted(c)
    whole = F.broadcast(counted.agg(F.sum("n").alias("whole"), F.least(F.max("age"), F.lit(max_age)).cast("long").alias("top")).where("whole is not null"))
    grid = whole.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("age"), "whole")
    rows = grid.join(counted, "age", "left").select("age", F.coalesce("n", F.lit(0)).alias("references"), "whole")
    rows = rows.withColumn("share", ratio(F.col("references"), F.col("whole"), 2, 100))
    up = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("age", "references", "share", rounded(F.sum("share").over(up), 2).alias("cumulative_share")).orderBy("age")


@operator
def reference_spectroscopy(c: Corpus) -> DataFrame:
    """References by year of publication against the median of five years around; years that stand out are peaks.

    Without a dated document the last year is that of the latest reference.
    """
    last = F.broadcast(c.documents.agg(F.max("year").alias("last")))
    rows = c.references.where("ref_year >= 1800").crossJoin(last).where("last is null or ref_year <= last").withColumn("year", F.col("ref_year").cast("long"))
    counts = rows.groupBy("year").agg(F.count(F.lit(1)).alias("references"))
    bounds = F.broadcast(counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).where("lo is not null"))
    grid = bounds.select(F.explode(F.sequence("lo", "hi")).alias("year")).join(counts, "year", "left").na.fill(0, ["references"])
    around = Window.orderBy("year").rowsBetween(-2, 2)
    line = grid.withColumn("median_5", F.percentile("references", 0.5).over(around)).withColumn("deviation", F.col("references") - F.col("median_5"))
    level = F.broadcast(line.where("deviation > 0").agg(F.percentile("deviation", 0.5).alias("level")))
    text = F.concat_ws(": ", F.when(filled("ref_authors"), F.trim("ref_authors")), F.when(filled("ref_title"), F.trim("ref_title")))
    named = rows.where(filled("ref_title") | filled("ref_authors")).groupBy("year", text.alias("label")).agg(F.count(F.lit(1)).alias("k"))
    best = named.groupBy("year").agg(F.min_by(F.struct("label", "k"), F.struct(-F.col("k"), "label")).alias("b"))
    best = best.select("year", F.concat("b.label", F.lit(" ("), F.col("b.k").cast("string"), F.lit("×)")).alias("top_reference"))
    out = line.crossJoin(level).join(best, "year", "left")
    peak = F.coalesce((F.col("deviation") > 0) & (F.col("deviation") >= F.col("level")), F.lit(False))
    return out.select("year", "references", rounded(F.col("median_5"), 1).alias("median_5"), rounded(F.col("deviation"), 1).alias("deviation"), peak.alias("is_peak"), "top_reference").orderBy("year")
