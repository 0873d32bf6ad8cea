"""Records that are one record but for formatting, collapsed by a Bloom filter of repeats and exact grouping.

Each record gets a canonical hash that formatting and the order of a title's parts leave alone: of its title's letters and digits in
sorted order, and of its DOI's letters and digits.  Every partition marks the hashes it sees once and repeatedly; merging the
partitions' filters turns "once here and once there" into "repeatedly".  Only records whose hash may be repeated are shuffled; all
others are singletons without having been moved.

Records that may be copies are then grouped exactly.  Their titles are one if the letters of one are those of the other with its
parts, as its punctuation tells them, in some order, also through a third title: "A: B", "B – A" and "B A" are one, "Eat" and "Tea",
or "Data mining" and "Mining data", aren't.  All orders of up to MOST_PARTS parts are tried; a title of more parts is compared in
their sorted order and in their rotations.

The filter has BITS_PER_RECORD bits a record, however many records there are, so about 1 in 70 singletons passes it at any size.  It is
built and used in slices of the hash range of at most SLICE_BITS bits (64 MB), which bounds what is broadcast; the hashes are stored
in order, so that a slice reads its own part of them.

Cases: a title of no letters or digits (null, blank, punctuation) has nothing to be compared by, so the record is
a singleton; a missing DOI equals only a missing DOI; rows with a null id are left out; repeated ids count once in a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.components import components
from folioscope.functions.skew import HOT_KEYS, join_counted
from folioscope.llm.canonical import doi_key, title_parts
from folioscope.runtime import durable, ship_package

CHUNK_BITS = 1 << 21
SLICE_BITS = 1 << 29
BITS_PER_RECORD = 16
MOST_PARTS = 5
_SEP = "\x1f"


def orders(parts: list[str]) -> list[str]:
    """The letters of a title with its parts in every order; as they are and sorted where they are more than MOST_PARTS."""
    if len(parts) > MOST_PARTS:
        return ["".join(parts), "".join(sorted(parts))]
    return sorted({"".join(p) for p in permutations(parts)})


def _places(hashes: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk and two bit positions inside it of each hash."""
    h = hashes.view(np.uint64)
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    chunk = (mixed >> np.uint64(43)) % np.uint64(chunks)
    return chunk.astype(np.int64), (h & np.uint64(CHUNK_BITS - 1)).astype(np.int64), ((h >> np.uint64(21)) & np.uint64(CHUNK_BITS - 1)).astype(np.int64)


def _packed(positions: np.ndarray) -> bytes:
    """Set bits of a chunk, as their sorted positions or as a bitmap, whichever is shorter; the first byte tells."""
    if len(positions) * 4 < CHUNK_BITS // 8:
        return b"\0" + positions.astype(np.uint32).tobytes()
    bits = np.zeros(CHUNK_BITS, dtype=np.uint8)
    bits[positions] = 1
    return b"\1" + np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1)))
    return np.frombuffer(data, dtype=np.uint32, offset=1)


def _with_keys(records: DataFrame, id_col: str, title_col: str, doi_col: str) -> DataFrame:
    """(_id, _hash, _parts, _doi); `_parts` is empty where a title says nothing."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = [title_parts(t) for t in rows["_title"]]
            dois = [doi_key(d) for d in rows["_doi"]]
            hashes = np.fromiter((xxhash.xxh64_intdigest("".join(sorted("".join(p))) + "|" + d) for p, d in zip(parts, dois, strict=True)), dtype=np.uint64, count=len(parts))
            yield pd.DataFrame({"_id": rows["_id"].to_numpy(), "_hash": hashes.view(np.int64), "_parts": [_SEP.join(p) for p in parts], "_doi": dois})

    kind = records.schema[id_col].dataType
    picked = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(title_col).cast("string").alias("_title"), F.col(doi_col).cast("string").alias("_doi"))
    return picked.mapInPandas(keyed, T.StructType([T.StructField("_id", kind), T.StructField("_hash", T.LongType()), T.StructField("_parts", T.StringType()), T.StructField("_doi", T.StringType())]))


def repeat_filter(hashes: DataFrame, chunks: int) -> dict[int, bytes]:
    """Chunk number to bits of the merged filter of possibly repeated hashes; at most SLICE_BITS bits in all.

    What a partition sends is at most eight bytes a hash, so a chunk's group is bounded by its share of the hashes.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [rows["_hash"].to_numpy() for rows in batches]
        if not any(map(len, seen)):
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        chunk, first, second = _places(values, chunks)
        order = np.argsort(chunk, kind="stable")
        chunk, first, second, again = chunk[order], first[order], second[order], (counts > 1)[order]
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        for begin, end in zip(starts, [*starts[1:], len(chunk)], strict=True):
            part, more = slice(begin, end), again[begin:end]
            once = np.unique(np.r_[first[part], second[part]])
            yield pd.DataFrame({"chunk": [int(chunk[begin])], "once": [_packed(once)], "more": [_packed(np.unique(np.r_[first[part][more], second[part][more]])) if more.any() else None]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        once, more = np.zeros(CHUNK_BITS, dtype=bool), np.zeros(CHUNK_BITS, dtype=bool)
        for a, b in zip(rows["once"], rows["more"], strict=True):
            at = _unpacked(a)
            more[at[once[at]]] = True
            once[at] = True
            if b is not None:
                more[_unpacked(b)] = True
        return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "more": [_packed(np.flatnonzero(more))]}) if more.any() else pd.DataFrame({"chunk": [], "more": []})

    merged = hashes.mapInPandas(local, "chunk long, once binary, more binary").groupBy("chunk").applyInPandas(merge, "chunk long, more binary")
    return {row.chunk: bytes(row.more) for row in merged.collect()}


def marked_repeats(keyed: DataFrame, total: int) -> DataFrame:
    """The `total` rows of `keyed` with `_again`, whether the filter takes their hash for repeated; keys are kept only for those.

    Found slice by slice of the hash range.
    """
    spark = keyed.sparkSession
    slices = max(1, -(-total * BITS_PER_RECORD // SLICE_BITS))
    chunks = max(1, -(-total * BITS_PER_RECORD // slices // CHUNK_BITS))
    width = (1 << 64) // slices
    found = None
    for k in range(slices):
        low, high = -(1 << 63) + k * width, (1 << 63) - 1 if k == slices - 1 else -(1 << 63) + (k + 1) * width - 1
        part = keyed if slices == 1 else keyed.where(F.col("_hash").between(low, high))
        repeats = spark.sparkContext.broadcast(repeat_filter(part.where("_parts <> ''").select("_hash"), chunks))

        def may_repeat(hashes: pd.Series) -> pd.Series:
            chunk, first, second = _places(hashes.to_numpy(), chunks)
            out = np.zeros(len(chunk), dtype=bool)
            for c in np.unique(chunk):
                bits = repeats.value.get(int(c))
                if bits is not None:
                    at = np.flatnonzero(chunk == c)
                    on = np.zeros(CHUNK_BITS, dtype=bool)
                    on[_unpacked(bits)] = True
                    out[at] = on[first[at]] & on[second[at]]
            return pd.Series(out)

        tested = part.withColumn("_again", F.pandas_udf(may_repeat, "boolean")("_hash") & (F.col("_parts") != ""))
        tested = durable(tested.select("_id", "_again", *(F.when(F.col("_again"), F.col(c)).alias(c) for c in ("_hash", "_parts", "_doi"))), "marked-records")
        repeats.destroy()
        found = tested if found is None else found.unionByName(tested)
    return found


def _grouped(possible: DataFrame) -> DataFrame:
    """(_id, _group): the exact group of each possible repeat, two 64-bit numbers: of its titles and of its canonical form."""
    letters = F.replace("_parts", F.lit(_SEP), F.lit(""))
    node = F.xxhash64("_doi", letters)
    # spellings that differ in more than formatting of the same letter sequence are linked through the orders of their parts
    spelled = durable(possible.select("_hash", "_doi", "_parts", node.alias("_node")).distinct(), "spellings")
    several = spelled.groupBy("_hash").agg(F.countDistinct("_node").alias("n")).where("n > 1").select("_hash")

    @F.pandas_udf("array<string>")
    def every_order(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: orders(p.split(_SEP)))

    links = spelled.join(several, "_hash", "left_semi").where(F.contains("_parts", F.lit(_SEP))).withColumn("_other", F.explode(every_order("_parts")))
    links = durable(links.select(F.col("_node").alias("u"), F.xxhash64("_doi", "_other").alias("v")).where("u <> v").distinct(), "part-orders")
    rows = possible.select("_id", "_hash", node.alias("_node"))
    if links.isEmpty():
        return rows.select("_id", F.struct(F.col("_node").alias("a"), F.col("_hash").alias("b")).alias("_group"))
    named = durable(components(links), "title-groups")
    # there are as many named nodes as orders of the linked spellings; how many rows a node has is counted before they are joined
    counted = rows.groupBy("_node").agg(F.count(F.lit(1)).alias("n")).join(named.withColumnRenamed("node", "_node"), "_node", "left")
    counted = durable(counted.select("_node", "n", F.coalesce("component", "_node").alias("a")), "node-groups")
    return join_counted(rows, counted, ["_node"], "n", rows.count()).select("_id", F.struct("a", F.col("_hash").alias("b")).alias("_group"))


def collapse(records: DataFrame, id_col: str, title_col: str, doi_col: str) -> DataFrame:
    """One row per record: `id_col`, `first_id` (least id of its copies) and `copies` (how many there are)."""
    ship_package(records.sparkSession)
    keyed = durable(_with_keys(records, id_col, title_col, doi_col).sortWithinPartitions("_hash"), "record-keys")
    total = keyed.count()
    marked = marked_repeats(keyed, total)
    grouped = durable(_grouped(marked.where("_again")).distinct(), "possible-groups")
    groups = grouped.groupBy("_group").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = durable(groups, "repeat-groups")
    members = join_counted(grouped, groups, ["_group"], "copies", total).select("_id", "first_id", "copies")
    hot = F.broadcast(groups.where(F.col("copies") >= max(2, total // HOT_KEYS)).select("_group"))
    passed = grouped.join(hot, "_group", "left_anti").join(groups.select("_group"), "_group", "left_anti").select("_id")
    alone = passed.unionByName(marked.where("not _again").select("_id")).select("_id", F.col("_id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    return members.unionByName(alone).withColumnRenamed("_id", id_col)
