"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.skew import join_counted
from folioscope.runtime import durable


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """`node`, `component` (its least node) of every node with an edge; `edges` has long columns `u` and `v`.

    Each round costs two aggregations over the remaining edges and shortens every path to its least node by about half, so
    chains of a million links need some twenty rounds. A node that holds a large share of the edges, as the centre of a large component
    does in the end, is joined by broadcast. Only a count and a checksum of a round come to the driver.
    """
    stars = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-edges")
    before, size = None, stars.count()
    for _ in range(most_rounds if size else 0):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = join_counted(both.where("v > u"), _nearest(both), ["u"], "n", 2 * size)
        large = near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        least = _nearest(large)
        small = join_counted(large, least, ["u"], "n", size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "component-edges")
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, size = state, state[0]
    else:
        if size:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = stars.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _nearest(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node, and how many it has."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
