"""How often two items stand in the same basket, and how much more often than chance, by heavy-light decomposition.

Items held by at least one in HEAVY of a group's rows are heavy; there are at most HEAVY of them.  Pairs of heavy items are
counted in dense bit matrices, an item's row against the others by AND and popcount.  Pairs of rare items are listed per basket
and hash-counted where they arise, so that partial counts are shuffled and not pairs.  Mixed pairs probe a basket's list of
heavy items for each of its rare ones.  Items in fewer baskets than a pair must share can be in no pair and are left out first.

A basket of more than WIDE rare items (one may hold a third of all rows) isn't listed: what wide baskets add to a pair listed
elsewhere is found by intersecting the two items' lists of wide baskets, and pairs that only wide baskets make frequent come
from bit matrices over the wide baskets, tile by tile.  Every count is exact.

Cases: rows with a null basket, null item or null group are left out; repeated rows count once; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.skew import join_counted
from folioscope.runtime import durable, ship_package

HEAVY = 1_024
WIDE = 512
TILE = 4_096
_FLUSH = 2_000_000


@lru_cache(maxsize=64)
def _both(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size, 1)


def popcount_pairs(rows: np.ndarray, columns: np.ndarray, items: int, counts: np.ndarray) -> None:
    """Add to `counts` (items x items) how many columns each two items share; incidences are (rows[i], columns[i])."""
    present, local = np.unique(rows, return_inverse=True)
    bits = bit_rows(local, columns, len(present))
    for i in range(len(present) - 1):
        shared = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
        counts[present[i], present[i + 1 :]] += shared


def bit_rows(rows: np.ndarray, columns: np.ndarray, count: int) -> np.ndarray:
    """`count` rows of bits, 64 to a word, with bit columns[i] of row rows[i] set."""
    bits = np.zeros((count, int(columns.max()) // 64 + 1 if len(columns) else 0), dtype=np.uint64)
    np.bitwise_or.at(bits, (rows, columns // 64), np.uint64(1) << (columns % 64).astype(np.uint64))
    return bits


def _tally(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.diff(np.r_[first, len(a)])


def _frame(group: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"grp": group, "a": np.minimum(a, b), "b": np.maximum(a, b), "n": n.astype(np.int64)})


def _count_baskets(batches: Iterator[pd.DataFrame], heavy: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Partial pair counts of baskets given as (grp, light ids, heavy ids)."""
    dense: dict[str, np.ndarray] = {}
    for rows in batches:
        for group, part in rows.groupby("grp", sort=False):
            ids = heavy.get(group, np.empty(0, dtype=np.int64))
            # heavy pairs: one bit a basket
            lists = [np.asarray(h, dtype=np.int64) for h in part["heavy"]]
            sizes = np.array([len(x) for x in lists])
            if sizes.sum():
                if group not in dense:
                    dense[group] = np.zeros((len(ids), len(ids)), dtype=np.int64)
                popcount_pairs(np.searchsorted(ids, np.concatenate(lists)), np.repeat(np.arange(len(lists)), sizes), len(ids), dense[group])
            # rare pairs and mixed pairs: listed, then counted
            left, right, waiting = [], [], 0
            for light, heavies in zip(part["light"], lists, strict=True):
                light = np.sort(np.asarray(light, dtype=np.int64))
                if not len(light):
                    continue
                i, j = _both(len(light))
                left += [light[i], np.repeat(light, len(heavies))]
                right += [light[j], np.tile(heavies, len(light))]
                waiting += len(i) + len(light) * len(heavies)
                if waiting >= _FLUSH:
                    yield _frame(group, *_tally(*_ordered(left, right)))
                    left, right, waiting = [], [], 0
            if waiting:
                yield _frame(group, *_tally(*_ordered(left, right)))
    for group, counts in dense.items():
        i, j = np.nonzero(counts)
        yield _frame(group, heavy[group][i], heavy[group][j], counts[i, j])


def _ordered(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


_PAIRS = "grp string, a long, b long, n long"


def count_pairs(rows: DataFrame, group_col: str, basket_col: str, item_col: str, *, min_together: int = 5, min_lift: float = 4.0) -> DataFrame:
    """Pairs of one group's items that share at least `min_together` baskets and have at least `min_lift` of the chance count.

    Columns: group, `item_a` < `item_b`, `together`, `n_a`, `n_b`, `baskets` (the group's nonempty ones) and `lift`.
    The number of groups (fields) is taken to be small; items and baskets may be as many as there are rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    base = rows.select(F.col(group_col).cast("string").alias("grp"), F.col(basket_col).alias("basket"), F.col(item_col).alias("item"))
    base = durable(base.where("grp is not null and basket is not null and item is not null").distinct(), "basket-items")
    sizes = base.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")).join(base.select("grp", "basket").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("baskets")), "grp")
    groups = {r.grp: (r.rows, r.baskets) for r in sizes.collect()}
    if not groups:
        kind = rows.schema[item_col].dataType
        return spark.createDataFrame([], T.StructType([T.StructField(group_col, T.StringType()), T.StructField("item_a", kind), T.StructField("item_b", kind), *(T.StructField(c, T.LongType()) for c in ("together", "n_a", "n_b", "baskets")), T.StructField("lift", T.DoubleType())]))
    floors = F.create_map(*(F.lit(x) for g, (n, _) in groups.items() for x in (g, max(min_together, -(-n // HEAVY)))))
    supports = base.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_together)
    supports = durable(supports.select("grp", "item", "support", (F.col("support") >= floors[F.col("grp")]).alias("is_heavy"), F.monotonically_increasing_id().alias("id")), "item-supports")
    heavy_items = supports.where("is_heavy")
    heavy: dict[str, list[int]] = {}
    for r in heavy_items.select("grp", "id").collect():
        heavy.setdefault(r.grp, []).append(r.id)
    shared = spark.sparkContext.broadcast({g: np.sort(np.array(v, dtype=np.int64)) for g, v in heavy.items()})

    keys = ["grp", "item"]
    heavy_rows = base.join(F.broadcast(heavy_items.select(*keys, "id")), keys).select("grp", "basket", "id", F.lit(True).alias("is_heavy"))
    rest = base.join(F.broadcast(heavy_items.select(*keys)), keys, "left_anti")
    light_rows = rest.join(supports.where("not is_heavy").select(*keys, "id"), keys).select("grp", "basket", "id", F.lit(False).alias("is_heavy"))
    encoded = durable(heavy_rows.unionByName(light_rows), "encoded-baskets")

    light = encoded.where("not is_heavy")
    widths = light.groupBy("grp", "basket").agg(F.count(F.lit(1)).alias("width")).where(F.col("width") > WIDE)
    wide = durable(widths, "wide-baskets")
    any_wide = not wide.isEmpty()
    narrow = encoded
    if any_wide:
        # a wide basket's rare rows go apart; its heavy ones, HEAVY at most, stay in the bit matrix
        total = sum(n for n, _ in groups.values())
        wide_light = durable(join_counted(light, wide, ["grp", "basket"], "width", total), "wide-rows")
        hot = F.broadcast(wide.where(F.col("width") >= total // 1_000).select("grp", "basket"))
        kept = light.join(hot, ["grp", "basket"], "left_anti").join(wide.select("grp", "basket"), ["grp", "basket"], "left_anti")
        narrow = encoded.where("is_heavy").unionByName(kept)
    baskets = narrow.groupBy("grp", "basket").agg(
        F.collect_list(F.when(~F.col("is_heavy"), F.col("id"))).alias("light"), F.collect_list(F.when(F.col("is_heavy"), F.col("id"))).alias("heavy")
    )
    counted = baskets.select("grp", "light", "heavy").mapInPandas(lambda batches: _count_baskets(batches, shared.value), _PAIRS)
    if any_wide:
        counted = durable(counted.groupBy("grp", "a", "b").agg(F.sum("n").alias("n")), "narrow-pairs")
        counted = _with_wide(counted, wide_light, encoded.where("is_heavy"), wide, min_together, total)
    pairs = durable(counted.groupBy("grp", "a", "b").agg(F.sum("n").alias("together")).where(F.col("together") >= min_together), "frequent-pairs")
    return _scored(pairs, supports, {g: b for g, (_, b) in groups.items()}, group_col, min_lift)


def _named(pairs: DataFrame, supports: DataFrame, side: str) -> DataFrame:
    """`pairs` with the item and support of `side`: the few heavy items are broadcast, the others joined by id."""
    names = supports.select("grp", F.col("id").alias(side), F.col("item").alias(f"item_{side}"), F.col("support").alias(f"n_{side}"), "is_heavy")
    heavy = F.broadcast(names.where("is_heavy").drop("is_heavy"))
    light = names.where("not is_heavy").drop("is_heavy")
    rest = pairs.join(F.broadcast(names.where("is_heavy").select("grp", side)), ["grp", side], "left_anti")
    return pairs.join(heavy, ["grp", side]).unionByName(rest.join(light, ["grp", side]))


def _scored(pairs: DataFrame, supports: DataFrame, baskets: dict[str, int], group_col: str, min_lift: float) -> DataFrame:
    named = _named(_named(pairs, supports, "a"), supports, "b")
    number = F.create_map(*(F.lit(x) for pair in baskets.items() for x in pair))
    lift = F.col("together") * F.col("baskets") / (F.col("n_a") * F.col("n_b"))
    swap = F.col("item_a") > F.col("item_b")
    scored = named.withColumn("baskets", number[F.col("grp")].cast("long")).where(F.col("together") * F.col("baskets") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    return scored.select(
        F.col("grp").alias(group_col),
        F.when(swap, F.col("item_b")).otherwise(F.col("item_a")).alias("item_a"), F.when(swap, F.col("item_a")).otherwise(F.col("item_b")).alias("item_b"),
        "together", F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), "baskets", lift.alias("lift"),
    )


def _with_wide(counted: DataFrame, wide_light: DataFrame, heavy_rows: DataFrame, wide: DataFrame, min_together: int, total: int) -> DataFrame:
    """Pair counts of narrow baskets completed by what the wide baskets add."""
    keys = ["grp", "basket"]
    # mixed pairs: a wide basket's heavy list, at most HEAVY long, beside each of its rare rows
    lists = wide.join(heavy_rows.join(wide.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.collect_list("id").alias("heavies")), keys)
    mixed = join_counted(wide_light.drop("width"), lists, keys, "width", total).select("grp", "id", F.explode("heavies").alias("other"))
    mixed = mixed.select("grp", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.lit(1).cast("long").alias("n"))
    # a rare item's list of wide baskets
    numbered = durable(wide.select(*keys, "width", F.monotonically_increasing_id().alias("wide_no")), "wide-numbers")
    held = durable(join_counted(wide_light.drop("width"), numbered, keys, "width", total).groupBy("grp", "id").agg(F.array_sort(F.collect_list("wide_no")).alias("held")), "wide-lists")
    a = held.select("grp", F.col("id").alias("a"), F.col("held").alias("held_a"))
    b = held.select("grp", F.col("id").alias("b"), F.col("held").alias("held_b"))
    added = counted.join(a, ["grp", "a"]).join(b, ["grp", "b"]).select("grp", "a", "b", F.size(F.array_intersect("held_a", "held_b")).cast("long").alias("n")).where("n > 0")
    # pairs that narrow baskets don't list at all
    dense = held.where(F.size("held") >= min_together)
    tiles = max(1, -(-dense.count() // TILE))
    tiled = dense.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    squares = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select("grp", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "id", "held")

    def square(rows: pd.DataFrame) -> pd.DataFrame:
        group, low, high = rows["grp"].iloc[0], rows["ti"].iloc[0], rows["tj"].iloc[0]
        lists = [np.asarray(x, dtype=np.int64) for x in rows["held"]]
        columns = np.unique(np.concatenate(lists), return_inverse=True)[1]
        bits = bit_rows(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), columns, len(lists))
        ids, tile = rows["id"].to_numpy(), rows["tile"].to_numpy()
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, i in enumerate(left):
            others = right[k + 1 :] if low == high else right
            shared = np.bitwise_count(bits[i] & bits[others]).sum(axis=1, dtype=np.int64)
            often = np.flatnonzero(shared >= min_together)
            found.append((np.full(len(often), ids[i]), ids[others[often]], shared[often]))
        return _frame(group, *(np.concatenate(x) for x in zip(*found, strict=True))) if found else pd.DataFrame(columns=["grp", "a", "b", "n"])

    only = squares.groupBy("grp", "ti", "tj").applyInPandas(square, _PAIRS).join(counted.select("grp", "a", "b"), ["grp", "a", "b"], "left_anti")
    return counted.unionByName(mixed).unionByName(added).unionByName(only)
