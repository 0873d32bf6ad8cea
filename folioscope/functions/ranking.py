"""Ranks and running totals over a whole table or large groups, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import durable


def ranked(rows: DataFrame, value: str, key: str) -> tuple[DataFrame, int]:
    """`rows` with `rank` and `cumulative` in falling order of `value`, the least `key` first, and the sum of `value`.

    The rows are sorted over all tasks; each task then numbers its own, and only the tasks' counts and sums, one row each, are added up
    in one place. A value held by very many rows is so split by the range of its keys.
    """
    spread = durable(rows.orderBy(F.desc(value), key).withColumn("_part", F.spark_partition_id()), "ranked-rows")
    parts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum"), "_s")
    total = parts.agg(F.sum("_s")).first()[0]
    own = Window.partitionBy("_part").orderBy(F.desc(value), key)
    out = spread.join(F.broadcast(parts.drop("_s")), "_part")
    run = F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumns({"rank": (F.row_number().over(own) + F.col("_rank")).cast("long"), "cumulative": run + F.col("_sum")})
    return out.drop("_part", "_rank", "_sum"), total or 0


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with `number`, their place in their group in rising order, without bringing a large group into one task.

    Rows are sorted over all tasks as in `ranked`; a group's counts in the tasks it reaches are added up, one row a task.
    """
    spread = durable(rows.orderBy(group, *order).withColumn("_part", F.spark_partition_id()), "numbered-rows")
    sizes = spread.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reaching = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).where("_before > 0")
    own = Window.partitionBy("_part", group).orderBy(*order)
    out = spread.withColumn("number", F.row_number().over(own))
    return out.join(reaching, [group, "_part"], "left").withColumn("number", F.col("number") + F.coalesce("_before", F.lit(0))).drop("_part", "_before")
