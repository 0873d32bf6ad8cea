"""Growth of production over the years."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import ratio, rounded, year_grid


def yearly(c: Corpus) -> DataFrame:
    """Document rows per year on the dense grid of years. From here on there are as many rows as years."""
    counts = c.documents.where("year is not null").groupBy(F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("documents"))
    return year_grid(counts).join(counts, "year", "left").na.fill(0, ["documents"])


def _by_year() -> WindowSpec:
    return Window.orderBy("year")


def _so_far() -> WindowSpec:
    return _by_year().rowsBetween(Window.unboundedPreceding, Window.currentRow)


@operator
def cagr(c: Corpus) -> DataFrame:
    """Compound growth in percent between the first and the last year."""
    ends = yearly(c).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("documents", "year").alias("first"), F.max_by("documents", "year").alias("last"))
    span = F.col("last_year") - F.col("first_year")
    rate = (F.pow(F.col("last") / F.col("first").cast("double"), F.try_divide(F.lit(1.0), span)) - 1) * 100
    return ends.where("first_year is not null").select(F.when((span > 0) & (F.col("first") > 0), rounded(rate, 2)).alias("cagr"))


@operator
def agr(c: Corpus) -> DataFrame:
    """Yearly growth in percent, null after a year without documents."""
    before = F.lag("documents").over(_by_year())
    change = F.when(before > 0, ratio(F.col("documents") - before, before, 2, 100))
    return yearly(c).select("year", "documents", change.alias("agr"), F.sum("documents").over(_so_far()).alias("cumulative")).orderBy("year")


@operator
def rgr_doubling_time(c: Corpus) -> DataFrame:
    """Relative growth rate of the cumulative total and the time it takes to double."""
    run = yearly(c).withColumn("cumulative", F.sum("documents").over(_so_far()))
    run = run.withColumn("ln", F.log(F.when(F.col("cumulative") > 0, F.col("cumulative").cast("double"))))
    run = run.withColumn("rate", F.col("ln") - F.lag("ln").over(_by_year()))
    double = F.when(F.col("rate") > 0, rounded(F.lit(math.log(2)) / F.when(F.col("rate") > 0, F.col("rate")), 2))
    return run.select("year", "documents", "cumulative", rounded(F.col("ln"), 4).alias("ln_cumulative"), rounded(F.col("rate"), 4).alias("rgr"), double.alias("doubling_time")).orderBy("year")


@operator
def growth_summary(c: Corpus) -> DataFrame:
    means = rgr_doubling_time(c).agg(rounded(F.avg("rgr"), 4).alias("rgr_mean"), rounded(F.avg("doubling_time"), 2).alias("doubling_time_mean"))
    return cagr(c).crossJoin(agr(c).agg(rounded(F.avg("agr"), 2).alias("agr_mean"))).crossJoin(means)


# Quantiles of the normal distribution by confidence, and the coefficients of the rational approximation for others.
_QUANTILES = {0.80: 1.2816, 0.85: 1.4395, 0.90: 1.6449, 0.95: 1.9600, 0.98: 2.3263, 0.99: 2.5758}
_ABOVE, _BELOW = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)


def normal_quantile(confidence: float) -> float:
    """How many standard deviations hold `confidence` of a normal distribution, after Abramowitz and Stegun, 26.2.23."""
    for known, quantile in _QUANTILES.items():
        if math.isclose(confidence, known, abs_tol=1e-9):
            return quantile
    t = math.sqrt(-2 * math.log((1 - confidence) / 2))
    value = lambda coefficients: sum(c * t**i for i, c in enumerate(coefficients))
    return abs(t - value(_ABOVE) / value(_BELOW))


@operator
def cochran_sample_size(c: Corpus, confidence: float = 0.95, margin: float = 0.05, proportion: float = 0.5) -> DataFrame:
    """How many documents to sample, with the correction for a finite population."""
    if not (0 < confidence < 1 and 0 < margin < 1 and 0 < proportion < 1):
        raise ValueError("confidence, margin and proportion lie between 0 and 1")
    z = normal_quantile(confidence)
    n0 = z**2 * proportion * (1 - proportion) / margin**2
    size = F.ceil(F.least(F.lit(n0) / (1 + F.lit(n0 - 1) / F.col("population")), F.col("population").cast("double"))).cast("long")
    out = c.documents.agg(F.count(F.lit(1)).alias("population")).withColumn("sample_size", F.when(F.col("population") > 0, size).otherwise(0))
    return out.select(
        "population", F.lit(confidence).alias("confidence"), F.lit(margin).alias("margin_of_error"), F.lit(proportion).alias("proportion"), F.lit(round(z, 4)).alias("z_score"),
        F.lit(math.ceil(n0)).cast("long").alias("sample_size_infinite"), "sample_size", F.coalesce(ratio(F.col("sample_size"), F.col("population"), 1, 100), F.lit(0.0)).alias("sampling_fraction"),
    )


@operator
def trend_forecast(c: Corpus, horizon: int = 5, model: str = "linear", this_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A least-squares trend of yearly documents over the years since the first: its table (observed and forecast) and its fit.

    Both are empty for fewer than three years (three with documents, if exponential). A forecast is never below zero. `this_year` marks
    a last year that may be incomplete; the current one by default.
    """
    if model not in ("linear", "exponential"):
        raise ValueError(f"model must be 'linear' or 'exponential', not {model!r}")
    rows = yearly(c)
    first = F.broadcast(rows.agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count(F.lit(1)).alias("years")))
    rows = rows.crossJoin(first).withColumn("t", (F.col("year") - F.col("first")).cast("double"))
    count = F.col("documents").cast("double")
    rows = rows.withColumn("y", F.log(F.when(count > 0, count)) if model == "exponential" else count)
    line = rows.where("y is not null").groupBy("first", "last", "years").agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"), F.count(F.lit(1)).alias("used"))
    line = F.broadcast(line.where("years >= 3 and used >= 3").select("slope", "intercept", F.col("last").alias("end"), F.col("first").alias("begin")))
    raw = F.col("intercept") + F.col("slope") * F.col("t")
    value = F.exp(raw) if model == "exponential" else raw
    seen = rows.crossJoin(line).withColumn("v", value)
    errors = seen.withColumn("m", F.avg("documents").over(Window.partitionBy())).groupBy("slope", "intercept", "years", "end").agg(
        F.sum(F.pow(F.col("documents") - F.col("v"), 2)).alias("sse"), F.sum(F.pow(F.col("documents") - F.col("m"), 2)).alias("sst"),
    )
    # What the slope says.
    slope, label = (rounded(F.exp("slope"), 4), "annual growth factor") if model == "exponential" else (rounded(F.col("slope"), 3), "additional documents per year")
    fit = errors.select(
        F.lit(model).alias("model"), slope.alias("slope"), F.lit(label).alias("slope_label"), rounded(F.col("intercept"), 3).alias("intercept"),
        rounded(1 - F.try_divide(F.col("sse"), F.col("sst")), 4).alias("r2"), rounded(F.sqrt(F.col("sse") / F.greatest(F.col("years") - 2, F.lit(1))), 2).alias("rmse"),
        F.col("years").alias("years_used"), F.col("end").alias("last_year"), (F.col("end") >= F.lit(this_year or datetime.date.today().year)).alias("last_year_partial"),
    )
    ahead = line.select(F.explode(F.sequence(F.col("end") + 1, F.col("end") + horizon)).alias("year"), "slope", "intercept", "begin")
    ahead = ahead.withColumn("t", (F.col("year") - F.col("begin")).cast("double")).withColumn("v", F.greatest(value, F.lit(0.0)))
    table = seen.select("year", "documents", rounded(F.col("v"), 2).alias("fitted"), F.lit("observed").alias("kind"))
    table = table.unionByName(ahead.select("year", F.lit(None).cast("long").alias("documents"), rounded(F.col("v"), 2).alias("fitted"), F.lit("forecast").alias("kind")))
    return table.orderBy("year"), fit
