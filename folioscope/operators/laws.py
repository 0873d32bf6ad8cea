"""Bibliometric laws: Lotka, Bradford, Zipf, and a Kolmogorov-Smirnov test of the first."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, most_used, ratio, rounded, top
from folioscope.functions.ranking import ranked
from folioscope.operators.production import keyword_rows
from folioscope.runtime import durable


def power_law(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Exponent, constant and R2 of y = constant / x^exponent, by least squares on logarithms."""
    lx, ly = F.log10(F.col(x).cast("double")), F.log10(F.col(y).cast("double"))
    fit = rows.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(ly, lx).alias("s"), F.regr_intercept(ly, lx).alias("i"), F.regr_r2(ly, lx).alias("r"))
    return fit.select(rounded(-F.col("s"), 3).alias("exponent"), rounded(F.pow(F.lit(10.0), "i"), 3).alias("constant"), rounded(F.col("r"), 4).alias("r2"))


def zeta(s: float, terms: int = 20) -> float:
    """Riemann's zeta for s > 1: leading terms and the Euler-Maclaurin remainder."""
    head = sum(k**-s for k in range(1, terms))
    return head + terms ** (1 - s) / (s - 1) + 0.5 * terms**-s + s * terms ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * terms ** (-s - 3) / 720


#: Terms over which the mean logarithm under a power law is taken, a fixed value: more of them change the exponent's third digit.
_TERMS = 200_000


def lotka_exponent(mean_log: float | None) -> float | None:
    """The likeliest exponent between 1.01 and 6 where the mean logarithm of productivity is `mean_log`; null without authors."""
    if mean_log is None:
        return None
    log = np.log(np.arange(1, _TERMS + 1, dtype=float))
    low, high = 1.01, 6.0
    for _ in range(60):
        middle = (low + high) / 2
        weight = np.exp(-middle * log)
        # the mean falls as the exponent grows
        low, high = (middle, high) if float(log @ weight) / float(weight.sum()) > mean_log else (low, middle)
    return (low + high) / 2


def productivity(c: Corpus) -> DataFrame:
    """(documents_written, n_authors): as many rows as there are productivities."""
    per = c.author_rows().where("key is not null").groupBy("key").agg(F.countDistinct("eid").alias("documents_written"))
    return per.groupBy("documents_written").agg(F.count(F.lit(1)).alias("n_authors"))


def _kept_productivity(c: Corpus) -> DataFrame:
    """`productivity`, counted once: it is read for the exponent and again for the table."""
    if "productivity" not in c.kept:
        c.kept["productivity"] = durable(productivity(c), "productivity")
    return c.kept["productivity"]


def _exponent(levels: DataFrame) -> float | None:
    k = F.col("documents_written").cast("double")
    return lotka_exponent(levels.agg(F.sum(F.col("n_authors") * F.log(k)) / F.sum("n_authors")).first()[0])


@operator
def lotka_table(c: Corpus) -> DataFrame:
    """Authors by number of documents: their share, that of the fitted law and that of Lotka's inverse square."""
    rows = _kept_productivity(c)
    exponent = _exponent(rows)
    x = F.col("documents_written").cast("double")
    whole = F.sum("n_authors").over(Window.partitionBy())
    fitted = rounded(F.lit(1 / zeta(exponent)) * F.pow(x, F.lit(-exponent)), 4) if exponent else F.lit(None).cast("double")
    return rows.select("documents_written", "n_authors", ratio(F.col("n_authors"), whole, 4).alias("share_observed"), fitted.alias("share_fitted"), rounded(F.lit(6 / math.pi**2) / (x * x), 4).alias("share_lotka")).orderBy("documents_written")


@operator
def lotka_fit(c: Corpus) -> DataFrame:
    """The fitted law: the likeliest exponent and its constant, with the exponent and R2 of least squares beside them, to six digits."""
    rows = _kept_productivity(c)
    exponent = _exponent(rows)
    lx, ly = F.log10(F.col("documents_written").cast("double")), F.log10(F.col("n_authors").cast("double"))
    line = rows.agg((-F.regr_slope(ly, lx)).alias("s"), F.regr_r2(ly, lx).alias("r"))
    value = lambda v: F.lit(v if v is None else round(v, 6)).cast("double")
    return line.select(value(exponent).alias("exponent"), value(1 / zeta(exponent) if exponent else None).alias("constant"), rounded(F.col("r"), 6).alias("r2"), rounded(F.col("s"), 6).alias("exponent_ols"))


def kolmogorov_smirnov(levels: list[tuple[int, int]], exponent: float) -> dict[str, float | bool | None]:
    """D of observed productivities against a zeta distribution over all levels up to the highest, and its significance."""
    total = sum(n for _, n in levels)
    if not total:
        return dict.fromkeys(("d", "p_value", "critical_5pct", "follows_lotka"))
    observed = np.zeros(max(k for k, _ in levels))
    for k, n in levels:
        observed[k - 1] = n / total
    expected = np.arange(1, len(observed) + 1) ** -exponent / zeta(exponent)
    d = float(np.abs(np.cumsum(observed) - np.cumsum(expected)).max())
    x = d * math.sqrt(total)
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)) if x > 0 else 1.0
    critical = 1.36 / math.sqrt(total)
    return {"d": round(d, 4), "p_value": round(min(1.0, max(0.0, p)), 4), "critical_5pct": round(critical, 4), "follows_lotka": d <= critical}


@operator
def lotka_tests(c: Corpus) -> DataFrame:
    """The test against the fitted law and against the strict one. The list of productivities, one row each, comes to the driver."""
    found = lotka(c)
    rows = [(law, *found[key].values()) for law, key in (("fitted", "ks_test"), ("strict", "ks_test_strict"))]
    return c.documents.sparkSession.createDataFrame(rows, "law string, d double, p_value double, critical_5pct double, follows_lotka boolean")


@operator
def lotka(c: Corpus) -> dict:
    """Table, fit, number of authors and both tests. The list of productivities, one row each, comes to the driver."""
    levels = [(r.documents_written, r.n_authors) for r in _kept_productivity(c).orderBy("documents_written").collect()]
    exponent = _exponent(_kept_productivity(c)) or 2.0
    return {"table": lotka_table(c), "fit": lotka_fit(c), "total_authors": sum(n for _, n in levels), "ks_test": kolmogorov_smirnov(levels, exponent), "ks_test_strict": kolmogorov_smirnov(levels, 2.0)}


@operator
def bradford(c: Corpus, zones: int = 3) -> DataFrame:
    """Sources ranked by documents with the zone each belongs to: the one being filled when the source comes."""
    counts = c.documents.where(filled("source")).groupBy("source").agg(F.countDistinct("eid").alias("documents"))
    run, whole = ranked(counts, "documents", "source")
    zone = F.least(F.lit(zones), F.floor((F.col("cumulative") - F.col("documents")) * zones / F.lit(whole or 1)) + 1)
    return run.select("rank", "source", "documents", "cumulative", zone.cast("long").alias("zone")).orderBy("rank")


@operator
def bradford_zones(c: Corpus, zones: int = 3) -> DataFrame:
    """Sources and documents of each zone, and how many times more sources than the zone before."""
    table = bradford(c, zones).groupBy("zone").agg(F.count(F.lit(1)).alias("sources"), F.sum("documents").alias("documents"))
    before = F.lag("sources").over(Window.orderBy("zone"))
    return table.select("zone", "sources", "documents", ratio(F.col("sources"), before, 2).alias("multiplier")).orderBy("zone")


def _ranked_keywords(c: Corpus, kind: str) -> DataFrame:
    rows = keyword_rows(c, kind)
    counted = rows.groupBy("norm").agg(F.countDistinct("eid").alias("frequency")).join(most_used(rows.withColumn("keyword", F.trim("keyword")), ["norm"], "keyword"), "norm")
    return ranked(counted, "frequency", "norm")[0]


@operator
def zipf(c: Corpus, n: int | None = 100, kind: str = "author") -> DataFrame:
    """Keywords by rank with the frequency that the fitted law gives; fitted over all ranks, shown for `n`."""
    rows = _ranked_keywords(c, kind)
    lx, ly = F.log10(F.col("rank").cast("double")), F.log10(F.col("frequency").cast("double"))
    fit = F.broadcast(rows.agg(F.regr_slope(ly, lx).alias("s"), F.regr_intercept(ly, lx).alias("i")))
    predicted = rounded(F.pow(F.lit(10.0), F.col("i") + F.col("s") * F.log10(F.col("rank").cast("double"))), 2)
    return top(rows.crossJoin(fit).select("rank", "keyword", "frequency", predicted.alias("predicted")), n, F.asc("rank"))


@operator
def zipf_fit(c: Corpus, kind: str = "author") -> DataFrame:
    return power_law(_ranked_keywords(c, kind), "rank", "frequency")
