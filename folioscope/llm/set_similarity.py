"""All pairs of records whose sets overlap strongly, found by recursive chosen-path splitting.

Records of equal sets are made one class first.  Each tree then branches its records on randomly chosen values they hold: a
value of a record x is chosen at the root with probability 1 / need, need = ceil(threshold * |x|), by a hash of node and value, so
two similar records choose the same values and go down together.  Nodes of at most `small` records are compared pair by pair;
larger ones branch again on other values, each chosen with probability 2 / (need - values on the path), 1 at most.

Similar sets share at least the larger one's need, so they choose at least one shared value at the root and two (or the one left)
in a node below it, on average.  With two a node a pair survives whatever the depth with a chance of 0.797 (1 - exp(-2q) = q), from
the root with 1 - exp(-0.797) = 0.549, from which the number of trees follows that brings the chance of a
miss below 1 - `target_recall`.  Every pair met is verified exactly on the whole sets.

Two sets of a and b values are similar once they share threshold / (1 + threshold) * (a + b).  In a large node whose path holds
that many, those two have no further value to meet by: they are compared there, block against block.  So are all records of nodes
still large at the deepest level; none is cut short.  Sets of more than `largest`
values are compared exactly by counting shared values, since no task may hold them whole.

Cases: null records and null values are left out; repeated rows count once; records of fewer than `least_size` values are in no
pair; an empty table gives no classes and no pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.components import components
from folioscope.functions.skew import join_counted
from folioscope.runtime import durable

#: The chance that a pair at the threshold survives a tree of any depth.
_SURVIVAL = 1 - math.exp(-0.7968)
_SALTS = 32


def _overlapping(overlap: Column, a: Column, b: Column, threshold: float) -> Column:
    return overlap >= F.lit(threshold) * (a + b - overlap) - F.lit(1e-9)


def same_values(rows: DataFrame, record_col: str, key_cols: list[str]) -> DataFrame:
    """`rec`, `value` (long): values known by any of several keys, being one where any key is the same, also through others.

    `shared` tells whether another record may hold the value. A row without a key is left out; keys are compared by 64-bit hash.
    """
    keys = [F.when(F.col(c) != "", F.xxhash64(F.lit(c), F.col(c))) for c in key_cols]
    found = durable(rows.select(F.col(record_col).alias("rec"), *(k.alias(f"k{i}") for i, k in enumerate(keys))).where("rec is not null"), "value-keys")
    names = [f"k{i}" for i in range(len(keys))]
    first = F.coalesce(*names)
    links = [found.select(first.alias("u"), F.col(n).alias("v")).where("u is not null and v is not null and u <> v") for n in names[1:]]
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    group = durable(components(edges), "value-components")
    # rows that a record repeats are counted and dropped in the end, so that they aren't shuffled for it here
    held = found.select("rec", first.alias("key")).where("key is not null")
    counted = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(group.withColumnRenamed("node", "key"), "key", "left").select("key", "n", F.coalesce("component", "key").alias("value"))
    named = durable(named, "value-names")
    # a value of a great many keys is one row here, whose keys are then joined by broadcast
    spread = named.groupBy("value").agg(F.count(F.lit(1)).alias("keys"), (F.sum("n") > 1).alias("shared"))
    named = join_counted(named, spread, ["value"], "keys", named.count()).drop("keys")
    return join_counted(held, named, ["key"], "n", held.count()).select("rec", "value", "shared").distinct()


def _chosen(tokens: Column, node: Column, size: Column, passed: int, threshold: float) -> Column:
    """Values chosen in a node with `passed` values on its path, by hash: of those a similar set must still share, one at the root, two below it."""
    need = F.ceil(F.lit(threshold) * size - 1e-9) - passed
    reach = F.lit(float(1 << 30)) * (2 if passed else 1) / F.greatest(need, F.lit(1))
    return F.filter(tokens, lambda t: F.pmod(F.xxhash64(node, t), F.lit(1 << 30)) < reach)


def _within(nodes: DataFrame) -> DataFrame:
    """Pairs of class ids inside nodes given as (node, id, size)."""
    grouped = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("id", "size"))).alias("m")).where(F.size("m") > 1)
    pairs = grouped.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.size").alias("na"), F.col("y.size").alias("nb"))


def _split_by_size(nodes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """`nodes` in nodes of at most `limit` records, and those in larger ones (None if there are none)."""
    large = durable(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "large-nodes")
    if large.isEmpty():
        return nodes, None
    total = nodes.count()
    hot = F.broadcast(large.where(F.col("n") >= max(2, total // 1_000)).select("node"))
    rest = nodes.join(hot, "node", "left_anti").join(large.select("node"), "node", "left_anti")
    return rest, join_counted(nodes, large, ["node"], "n", total)


def similar_classes(values: DataFrame, *, threshold: float = 0.6, least_size: int = 5, small: int = 48, depth: int = 6, target_recall: float = 0.9999, largest: int = 20_000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and the similar pairs of classes, from distinct rows (`rec`, `value` long).

    Values marked as not `shared`, where there is such a column, are no branches: a node below one would hold a single record.

    Returns (`rec`, `class`, `copies`) for all records in question and (`a`, `b`, `overlap`, `na`, `nb`, `similarity`) with a < b.
    """
    sizes = values.groupBy("rec").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least_size)
    sizes = durable(sizes, "set-sizes")
    spark = values.sparkSession
    over = sizes.where(F.col("size") > largest)
    huge = not over.isEmpty()
    fit = values
    if huge:
        # records too large to be one array are few: at most rows / largest
        total = values.count()
        big = join_counted(values, over.withColumnRenamed("size", "n"), ["rec"], "n", total).drop("n")
        hot = F.broadcast(over.where(F.col("size") >= max(2, total // 1_000)).select("rec"))
        fit = values.join(hot, "rec", "left_anti").join(over.select("rec"), "rec", "left_anti")
    branch = F.col("value") if "shared" not in values.columns else F.when(F.col("shared"), F.col("value"))
    sets = fit.groupBy("rec").agg(F.array_sort(F.collect_list("value")).alias("tokens"), F.collect_list(branch).alias("open")).where(F.size("tokens") >= least_size)
    sets = durable(sets.withColumn("set", F.struct(F.xxhash64("tokens"), F.xxhash64(F.lit(seed), "tokens"))), "record-sets")
    classes = sets.groupBy("set").agg(F.min("rec").alias("class"), F.count(F.lit(1)).alias("copies"))
    classes = durable(classes.withColumn("id", F.monotonically_increasing_id()), "set-classes")
    members = join_counted(sets.select("rec", "set"), classes, ["set"], "copies", sets.count()).select("rec", "class", "copies")
    held = sets.select("rec", "tokens", "open").join(classes.select(F.col("class").alias("rec"), "id"), "rec")
    records = durable(held.select("id", F.col("rec").alias("class"), "tokens", "open", F.size("tokens").alias("size")), "class-sets")

    trees = math.ceil(math.log(1 - target_recall) / math.log(1 - _SURVIVAL))
    roots = records.select("id", "open", "size", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")).withColumn("node", F.xxhash64(F.lit(seed), "tree"))
    found = []
    level = roots.withColumn("path", F.array().cast("array<bigint>"))
    for step in range(depth):
        branches = level.select("id", "size", "path", "node", F.explode(_chosen(F.array_except("open", "path"), F.col("node"), F.col("size"), step, threshold)).alias("t"))
        branches = branches.select("id", "size", F.xxhash64("node", "t").alias("node"), F.array_append("path", F.col("t")).alias("path"))
        branches = durable(branches, f"tree-level-{step}")
        rest, large = _split_by_size(branches.select("node", "id", "size"), small)
        found.append(_within(rest))
        if large is None:
            break
        big_nodes = large.select("node", "n").distinct() if step + 1 == depth else None
        if big_nodes is not None:
            found.append(_blocks(large, small))
            break
        whole = (step + 1) * (1 + 1 / threshold) + 1e-9  # the path alone makes sets similar whose sizes add up to this at most
        least = max(step + 1, least_size)
        if 2 * least <= whole:
            ended = large.where(F.col("size") + least <= whole).drop("n")
            counted = durable(ended.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"ended-{step}")
            met = _blocks(join_counted(ended, counted, ["node"], "n", branches.count()), small)
            found.append(met.where(F.col("na") + F.col("nb") <= whole))
        again = join_counted(branches, large.groupBy("node").agg(F.max("n").alias("n")), ["node"], "n", branches.count()).drop("n")
        level = again.join(records.select("id", "open"), "id")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    ratio = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - F.lit(1e-9)
    pairs = pairs.where(ratio).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    left = records.select(F.col("id").alias("x"), F.col("class").alias("p"), F.col("tokens").alias("s"), F.col("size").alias("np"))
    right = records.select(F.col("id").alias("y"), F.col("class").alias("q"), F.col("tokens").alias("t"), F.col("size").alias("nq"))
    met = pairs.join(left, "x").join(right, "y").withColumn("overlap", F.size(F.array_intersect("s", "t")))
    met = met.where(_overlapping(F.col("overlap"), F.col("np"), F.col("nq"), threshold))
    swap = F.col("p") > F.col("q")
    ordered = met.select(
        F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.col("overlap").cast("long").alias("overlap"),
        F.when(swap, F.col("nq")).otherwise(F.col("np")).cast("long").alias("na"), F.when(swap, F.col("np")).otherwise(F.col("nq")).cast("long").alias("nb"),
    )
    if huge:
        more_members, more_pairs = _huge(big, values, sizes, threshold, largest)
        members, ordered = members.unionByName(more_members), ordered.unionByName(more_pairs)
    return members, ordered.withColumn("similarity", F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap")))


def _blocks(large: DataFrame, small: int) -> DataFrame:
    """Pairs inside large nodes, each cut into blocks of about `small` records and compared block against block."""
    blocks = F.ceil(F.col("n") / small).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "node"), F.col("blocks")).cast("int"))
    squares = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    squares = squares.select("node", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "size")
    return _within(squares.select(F.xxhash64("node", "bi", "bj").alias("node"), "id", "size"))


def _huge(big: DataFrame, values: DataFrame, sizes: DataFrame, threshold: float, largest: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with a record too large for an array, by counting shared values; each such record is a class of its own.

    The records that hold a value are dealt to as many tasks as it needs, the large ones among them, rows / largest at most, to each.
    """
    near = sizes.where(F.col("size") >= F.lit(threshold * largest))
    others = durable(values.join(near.select("rec"), "rec", "left_semi").withColumn("salt", F.pmod(F.xxhash64("rec"), F.lit(_SALTS)).cast("int")), "large-sets")
    salted = big.select(F.col("rec").alias("x"), "value", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    shared = salted.join(others.select(F.col("rec").alias("y"), "value", "salt"), ["value", "salt"]).where("x <> y")
    counted = shared.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "value").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    named = counted.join(sizes.select(F.col("rec").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("rec").alias("b"), F.col("size").alias("nb")), "b")
    pairs = named.where(_overlapping(F.col("overlap"), F.col("na"), F.col("nb"), threshold)).select("a", "b", "overlap", "na", "nb")
    return sizes.where(F.col("size") > largest).select("rec", F.col("rec").alias("class"), F.lit(1).cast("long").alias("copies")), pairs


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of records (`rec_a` < `rec_b`): those of similar classes and those of one class."""
    left = members.select(F.col("class").alias("a"), F.col("rec").alias("r"))
    right = members.select(F.col("class").alias("b"), F.col("rec").alias("s"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b")
    inside = left.join(members.where("copies > 1").select(F.col("class").alias("a"), F.col("rec").alias("s")), "a").where("r < s")
    both = across.select("r", "s").unionByName(inside.select("r", "s"))
    return both.select(F.least("r", "s").alias("rec_a"), F.greatest("r", "s").alias("rec_b")).distinct()


def linked(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """`members` with `links`, the number of classes that their class is similar to."""
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
    found = ends.groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(found, "class", "left").na.fill(0, ["links"])
    classes = durable(classes, "class-links")
    return join_counted(members, classes, ["class"], "n", members.count()).drop("n")
