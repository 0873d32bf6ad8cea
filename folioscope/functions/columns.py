"""Column helpers shared by the indicators: rounding, keys, blank tests, index formulas over counted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDEPENDENT = "Independent researcher"


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value, as numpy does it."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def ratio(numerator: Column, denominator: Column, digits: int, scale: float = 1.0) -> Column:
    """`scale * numerator / denominator`, rounded; null where the denominator is 0 or null."""
    return rounded(F.try_divide(F.lit(scale) * numerator, denominator.cast("double")), digits)


def filled(column: str | Column) -> Column:
    """Not null and not only white space."""
    return F.length(F.trim(F.col(column) if isinstance(column, str) else column)) > 0


def author_key() -> Column:
    return F.coalesce(F.col("scopus_id"), F.concat(F.lit("name:"), F.col("name")))


def top(frame: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """`frame` in a total order, its first `n` rows (all of them for None)."""
    ordered = frame.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def first_value(value: str, *order: str) -> Column:
    """The value of the row that comes first in `order`; null values of `value` are skipped."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))


def citation_indices(rows: DataFrame, keys: list[str], cites: str = "cited_by") -> DataFrame:
    """h, g, i10 and e index of each key over its rows' citations.

    Rows are first counted per key and number of citations, so that a key holding a large share of the rows reaches its task as a
    short list of counted values; the indices then follow from running totals over that list.
    """
    counted = rows.groupBy(*keys, F.col(cites).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(*keys)
    ranked = counted.withColumns({"t": F.sum("n").over(down), "s": F.sum(F.col("n") * F.col("c")).over(down)})
    ranked = ranked.withColumns({"b": F.col("t") - F.col("n"), "sb": F.col("s") - F.col("n") * F.col("c")})
    h = F.max(F.least("c", "t")).over(own)
    root = F.floor((F.col("c") + F.sqrt(F.greatest(F.col("c") * F.col("c") + 4 * (F.col("sb") - F.col("c") * F.col("b")), F.lit(0)).cast("double"))) / 2)
    fits = lambda x: F.col("sb") + (x - F.col("b")) * F.col("c") >= x * x
    near = F.least("t", root + 1)
    g = F.when(fits(near), near).when(fits(F.least("t", root)), F.least("t", root)).otherwise(0)
    ranked = ranked.withColumns({"h": h, "g": F.when(g > F.col("b"), g).otherwise(0)})
    out = ranked.groupBy(*keys).agg(
        F.max("h").cast("long").alias("h_index"), F.max("g").cast("long").alias("g_index"), F.sum(F.when(F.col("c") >= 10, F.col("n")).otherwise(0)).alias("i10_index"),
        F.sum(F.when(F.col("b") < F.col("h"), F.col("c") * (F.least("t", "h") - F.col("b"))).otherwise(0)).alias("core"),
    )
    return out.withColumn("e_index", rounded(F.sqrt((F.col("core") - F.col("h_index") * F.col("h_index")).cast("double")), 2)).drop("core")


def m_index(h: Column, first_year: Column, last_year: Column) -> Column:
    """h divided by the years since the first one; null where that is unknown or not positive."""
    span = last_year - first_year + 1
    return F.when(span > 0, ratio(h, span, 2))


def most_used(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent `value` of each key, the least of equally frequent ones; counted before it is shuffled."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def year_grid(years: DataFrame, column: str = "year") -> DataFrame:
    """Every year from the first to the last of `years`."""
    bounds = years.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo is not null")
    return bounds.select(F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias(column))
