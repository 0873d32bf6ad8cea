"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row per key and its number of rows in `count_col`.

    A key is hot when it holds at least one in HOT_KEYS of `total` rows, so there are at most HOT_KEYS of them:
    their side is broadcast whatever the input size. The other keys, each a small share, are joined by shuffle.
    """
    floor = max(2, total // HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col(count_col) >= floor))
    cold = keyed.where(F.col(count_col) < floor)
    hot_keys = F.broadcast(keyed.where(F.col(count_col) >= floor).select(*keys))
    return rows.join(hot, keys).unionByName(rows.join(hot_keys, keys, "left_anti").join(cold, keys))
