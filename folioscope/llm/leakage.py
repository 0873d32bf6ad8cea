"""Passages of held-out test items found in a training corpus through a positional inverted index.

The corpus is indexed once, in segments: each holds, for every term that some item uses, the sorted list of (document,
position) postings of its documents.  Terms are known by 64-bit hash; the hashes of all items' terms are sent to every executor, and
only if they are more than MOST_TERMS are the items dealt over several indexes.  Segments are written to the shared folder; nothing of
the corpus is shuffled.  From all segments come the terms' document frequencies over the whole corpus.  An item's rare terms are its
anchors: their lists are shifted by the anchor's offset in the item and intersected, so that a document is a candidate in which
enough anchors agree with another on where the item would begin: three quarters of those that `least` of the item holds on average,
`inner` of them matching.  An item whose anchors stand mostly in the part that a document lacks may so be missed; with `slack` None
anchors needn't agree, only be there, in the number that must match in the parts of the item with fewest of them, which misses
nothing that the rule admits and looks at very many more documents.  For candidates the lists of all the item's terms give
the exact stretches.  Items are looked for ITEMS_PER_PASS at a time, each pass reading the index and not the texts.

A document holds an item when one or two stretches, in the item's order, span at least `share` of it.  A stretch may leave out
or replace single words (at most `gap` in a row); the rare words inside it must mostly match, so a sentence pattern filled
with other content words is no stretch.  An opening sentence that `shared_by` or more items have verbatim is an instruction and
doesn't count as the item's text.

Cases: null, empty or one-word texts match nothing; items left without words match nothing; several rows under one document or
item id give one row; an empty corpus or item table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.canonical import words
from folioscope.llm.lookalikes import LOOKALIKES, mixed_tokens, unify
from folioscope.runtime import durable, ship_package

#: Items handled at once: what one pass broadcasts is bounded by this, larger item tables take several passes.
ITEMS_PER_PASS, TERMS_PER_PASS = 20_000, 8_000_000
#: Distinct terms of one index, of eight bytes each; what is broadcast with it is bounded by this.
MOST_TERMS = 1 << 23
_WORDS_KEPT = 1 << 20
SEGMENT_DOCS, SEGMENT_TOKENS = 1_000, 400_000
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def plain_words(text: str) -> list[str]:
    """Lower-case words of a text brought to one form, so that a disguised copy still reads the same."""
    if not text.isascii():
        text, _ = unify(text)
        for start, stop, word in reversed(list(mixed_tokens(text))):
            text = text[:start] + word + text[stop:]
    return words(text)


@dataclass(frozen=True)
class Item:
    item_id: object
    terms: np.ndarray


def term_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def item_words(text: str | None, shared: bool) -> list[str]:
    """The words of an item, without its opening sentence where that is a shared instruction."""
    parts = _SENTENCE.split((text or "").strip(), maxsplit=1)
    return plain_words(parts[1] if shared and len(parts) > 1 else (text or ""))


def item_terms(items: DataFrame) -> DataFrame:
    """`_item` and its `terms` in order, as hashes; items of fewer than two words are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            terms = [[term_hash(w) for w in item_words(t, s)] for t, s in zip(rows["_text"], rows["_shared"], strict=True)]
            yield pd.DataFrame({"_item": rows["_item"].to_numpy(), "terms": terms})

    schema = T.StructType([items.schema["_item"], T.StructField("terms", T.ArrayType(T.LongType()))])
    return items.mapInPandas(read, schema).where(F.size("terms") > 1)


def with_instructions(items: DataFrame, shared_by: int) -> DataFrame:
    """`_item`, `_text` and `_shared`: whether the item's opening sentence is that of `shared_by` items or more."""
    opened = items.withColumn("_opening", F.lower(F.element_at(F.split(F.trim("_text"), _SENTENCE.pattern, 2), 1)))
    often = opened.groupBy("_opening").agg(F.countDistinct("_item").alias("_n")).where(F.col("_n") >= shared_by)
    return opened.join(often, "_opening", "left").select("_item", "_text", F.col("_n").isNotNull().alias("_shared"))


def _pack(ids: list, terms: list[np.ndarray], places: list[np.ndarray], kind: type) -> tuple:
    docs = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(t) for t in terms])
    term = np.concatenate(terms)
    order = np.argsort(term, kind="stable")
    found, starts = np.unique(term[order], return_index=True)
    return (ids, found.astype(np.int32).tobytes(), starts.astype(np.int32).tobytes(), docs[order].tobytes(), np.concatenate(places)[order].astype(np.uint32).tobytes())


class _Numbers(dict):
    """Word to term number, -1 for words that no item has; words are looked up in the vocabulary once."""

    terms: np.ndarray

    def __missing__(self, word: str) -> int:
        value = term_hash(word)
        at = int(np.searchsorted(self.terms, value))
        self[word] = at = at if at < len(self.terms) and self.terms[at] == value else -1
        return at


def build_index(documents: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """One row per index segment: its documents' ids, the terms found, where each term's list starts, the lists.

    `vocabulary` holds the sorted hashes of the terms, a term's number being its place there.
    """
    words_of = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        numbers.terms = words_of.value
        ids, terms, places, size = [], [], [], 0
        names = ["ids", "terms", "starts", "docs", "places"]
        for rows in batches:
            for key, text in zip(rows["_id"], rows["_text"], strict=True):
                if len(numbers) > _WORDS_KEPT:
                    numbers.clear()
                term = np.array([numbers[w] for w in plain_words(text)], dtype=np.int32)
                place = np.flatnonzero(term >= 0)
                ids.append(key)
                terms.append(term[place])
                places.append(place)
                size += len(place)
                if len(ids) >= SEGMENT_DOCS or size >= SEGMENT_TOKENS:
                    yield pd.DataFrame([_pack(ids, terms, places, int)], columns=names)
                    ids, terms, places, size = [], [], [], 0
        if ids:
            yield pd.DataFrame([_pack(ids, terms, places, int)], columns=names)

    kind = documents.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *(T.StructField(n, T.BinaryType()) for n in ("terms", "starts", "docs", "places"))])
    picked = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return durable(picked.where("_id is not null and _text is not null").mapInPandas(segments, schema), "postings")


def _lists(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    terms = np.frombuffer(row.terms, dtype=np.int32)
    docs = np.frombuffer(row.docs, dtype=np.uint16)
    starts = np.append(np.frombuffer(row.starts, dtype=np.int32), len(docs))
    return terms, starts, docs, np.frombuffer(row.places, dtype=np.uint32).astype(np.int64)


def document_frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """In how many indexed documents each term stands; `terms` numbers come to the driver, whatever the corpus size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(terms, dtype=np.int64)
        for rows in batches:
            for row in rows.itertuples(index=False):
                term, starts, docs, _ = _lists(row)
                if len(docs):
                    new = np.r_[True, docs[1:] != docs[:-1]]
                    new[starts[:-1]] = True
                    total[term] += np.add.reduceat(new, starts[:-1])
        yield pd.DataFrame({"term": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(terms, dtype=np.int64)
    for row in index.mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def anchors_of(item: Item, frequency: np.ndarray, most: float) -> np.ndarray:
    """Offsets of an item's rare words, those in at most `most` documents; its rarest quarter if there are fewer."""
    order = np.lexsort((np.arange(len(item.terms)), frequency[item.terms]))
    rare = int((frequency[item.terms] <= most).sum())
    return np.sort(order[: max(2, -(-len(order) // 4), rare)])


def _mask(anchors: np.ndarray, item: Item) -> np.ndarray:
    mask = np.zeros(len(item.terms), dtype=bool)
    mask[anchors] = True
    return mask


def fewest_inside(rare: np.ndarray, length: int) -> int:
    """The fewest rare words that one or two parts of an item of `length` words in all hold."""
    total = np.r_[0, np.cumsum(rare)]
    n, length = len(rare), min(length, len(rare))
    best = int(rare.sum())
    # parts are tried in steps of at most a 64th of the length; a coarser step can only give a lower number, as each part is shortened by it
    step = max(1, length // 64)
    for first in range(0, length + 1, step):
        second = max(0, length - first - step + 1)
        one, two = total[first:] - total[: n + 1 - first], total[second:] - total[: n + 1 - second]
        # the first part ends where the second begins or before
        ahead = np.minimum.accumulate(one)[: max(0, n + 1 - first - second)]
        if len(ahead):
            best = min(best, int((ahead + two[first : first + len(ahead)]).min()))
    return best


def chain(offsets: np.ndarray, places: np.ndarray, gap: int) -> list[tuple[list[int], list[int]]]:
    """Stretches of matches that advance together, the longest first: the matched offsets and their places.

    Between two matches at most `gap` words of the item and as many of the document may be missing, and they may differ by two.
    """
    n = len(offsets)
    order = np.lexsort((offsets, places))
    off, at = offsets[order].tolist(), places[order].tolist()
    best, back = [1] * n, [-1] * n
    first = 0
    for i in range(n):
        while at[i] - at[first] > gap + 1:
            first += 1
        for j in range(first, i):
            step = off[i] - off[j]
            if 0 < step <= gap + 1 and at[j] < at[i] and abs(step - (at[i] - at[j])) <= 2 and best[j] + 1 > best[i]:
                best[i], back[i] = best[j] + 1, j
    used = [False] * n
    found = []
    for end in sorted(range(n), key=lambda k: -best[k]):
        path, k = [], end
        while k >= 0 and not used[k]:
            used[k] = True
            path.append(k)
            k = back[k]
        if len(path) >= 4:
            path.reverse()
            found.append(([off[k] for k in path], [at[k] for k in path]))
    return found


def stretches(offsets: np.ndarray, places: np.ndarray, rare: np.ndarray, size: int, gap: int, inner: float) -> tuple[float, int]:
    """The largest share of an item that one or two ordered stretches span, and how many there are.

    Each stretch is cut to its best part: a rare word inside it that matches counts for it, one that doesn't against it.
    """
    kept = []
    for path, spots in chain(offsets, places, gap):
        matched = set(path)
        inside = [o for o in range(path[0], path[-1] + 1) if rare[o]]
        # best run of rare words, a miss weighing inner/(1-inner) of a match: any run kept has more than `inner` of them matched
        top, run, begin_at, span = 0.0, 0.0, None, None
        for o in inside:
            if run <= 0:
                run, begin_at = 0.0, o
            run += 1.0 if o in matched else -inner / (1 - inner)
            if run > top:
                top, span = run, (begin_at, o)
        if span is None or top < 1.5:
            continue
        low, high = span
        a, b = bisect_left(path, low), bisect_left(path, high)
        while a > 0 and path[a - 1] >= path[a] - 2 and not rare[path[a - 1] : path[a]][1:].any():
            a -= 1
        while b + 1 < len(path) and path[b + 1] <= path[b] + 2:
            b += 1
        kept.append((path[a], path[b], spots[a], spots[b]))
    # the words just before and behind a stretch may be left out or replaced like any other
    kept = [(max(0, a - 1), min(size - 1, b + 1), p, q) for a, b, p, q in kept]
    best, count = 0, 0
    for i, (a, b, p, q) in enumerate(kept):
        if b - a + 1 > best:
            best, count = b - a + 1, 1
        for c, d, r, s in kept[:i]:
            # the later in the item must be the later in the text; words both span count once
            if (a < c and b < d and q < r) or (c < a and d < b and s < p):
                both = b - a + d - c + 2 - max(0, min(b, d) - max(a, c) + 1)
                if both > best:
                    best, count = both, 2
    return best / size, count


def find(
    documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str, *,
    share: float = 0.5, rare_share: float = 0.1, slack: int | None = 3, gap: int = 3, inner: float = 0.6, shared_by: int = 3, report_from: float | None = None,
) -> DataFrame:
    """Pairs (document id, item id) with the `coverage` of the item and the number of `stretches`.

    The columns are named as in the two tables; where both ids have one name, the item's is put behind `item_`.

    `report_from` lowers the coverage from which pairs are returned; by default it is `share`.
    """
    spark = documents.sparkSession
    ship_package(spark)
    item_name = f"item_{item_id_col}" if item_id_col == id_col else item_id_col
    clean = items.select(F.col(item_id_col).alias("_item"), F.col(item_text_col).cast("string").alias("_text")).where("_item is not null")
    # instructions are counted over all items; each pass then holds a bounded part of them
    read = durable(item_terms(with_instructions(clean, shared_by)), "item-terms")
    count, words_in_all = read.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    result = T.StructType([T.StructField(id_col, documents.schema[id_col].dataType), T.StructField(item_name, items.schema[item_id_col].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("stretches", T.IntegerType())])
    distinct = durable(read.select(F.explode("terms").alias("term")).distinct(), "item-vocabulary")
    indexes = max(1, -(-distinct.count() // MOST_TERMS))
    out = spark.createDataFrame([], result)
    for k in range(indexes if count else 0):
        dealt = F.pmod(F.xxhash64(F.lit(17), "_item"), F.lit(indexes))
        own = read if indexes == 1 else durable(read.where(dealt == k), "item-terms")
        listed = distinct if indexes == 1 else own.select(F.explode("terms").alias("term")).distinct()
        vocabulary = np.sort(listed.toPandas()["term"].to_numpy(dtype=np.int64))
        index = build_index(documents, id_col, text_col, vocabulary)
        frequency = document_frequencies(index, len(vocabulary))
        indexed = index.agg(F.sum(F.size("ids"))).first()[0] or 0
        passes = max(1, -(-count // (indexes * ITEMS_PER_PASS)), -(-words_in_all // (indexes * TERMS_PER_PASS)))
        for i in range(passes):
            part = own if passes == 1 else own.where(F.pmod(F.xxhash64("_item"), F.lit(passes)) == i)
            prepared = [Item(r._item, np.searchsorted(vocabulary, np.array(r.terms, dtype=np.int64)).astype(np.int32)) for r in part.collect()]
            out = out.unionByName(_find_items(index, prepared, frequency, rare_share * indexed, result, slack, gap, inner, share if report_from is None else report_from))
    return out.groupBy(id_col, item_name).agg(F.max("coverage").alias("coverage"), F.max_by("stretches", "coverage").alias("stretches"))


def _find_items(index: DataFrame, prepared: list[Item], frequency: np.ndarray, most: float, schema: T.StructType, slack: int | None, gap: int, inner: float, least: float) -> DataFrame:
    """The documents of `index` that hold at least `least` of an item of `prepared`."""
    spark = index.sparkSession
    if not prepared:
        return spark.createDataFrame([], schema)
    anchored = [anchors_of(item, frequency, most) for item in prepared]
    # a text that is to hold `least` of an item has `inner` of the rare words there in place, fewer where a part ends in common words
    if slack is None:
        few = [0.5 * fewest_inside(_mask(a, item), int(np.ceil(least * len(item.terms)))) for item, a in zip(prepared, anchored, strict=True)]
    else:
        few = [0.75 * inner * least * len(a) for a in anchored]
    needed = np.array([max(2, int(np.ceil(n))) for n in few])
    term = np.concatenate([item.terms[a] for item, a in zip(prepared, anchored, strict=True)])
    item_no = np.repeat(np.arange(len(prepared)), [len(a) for a in anchored])
    offset = np.concatenate(anchored)
    order = np.argsort(term, kind="stable")
    at = np.searchsorted(term[order], np.arange(len(frequency) + 1))
    shared = spark.sparkContext.broadcast((prepared, anchored, needed, at, item_no[order], offset[order]))

    def candidates(row, needed, at, item_no, offset) -> tuple[np.ndarray, np.ndarray]:
        terms, starts, docs, places = _lists(row)
        counts = at[terms + 1] - at[terms]
        use = np.flatnonzero(counts)
        sizes = (starts[1:] - starts[:-1])[use]
        # every posting of an anchor term beside every place of that term among the anchors
        posting = np.concatenate([np.arange(starts[u], starts[u + 1]) for u in use]) if len(use) else np.empty(0, dtype=np.int64)
        per = np.repeat(counts[use], sizes)
        base = np.repeat(at[terms[use]], sizes)
        where = np.repeat(base, per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        posting = np.repeat(posting, per)
        start = places[posting] - offset[where]
        key = docs[posting].astype(np.int64) * len(needed) + item_no[where]
        spot = offset[where]
        if slack is None:
            order = np.lexsort((spot, key))
            key, spot = key[order], spot[order]
            counted = np.ones(len(key), dtype=bool)
            counted[1:] = (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])
        else:
            order = np.lexsort((start, key))
            key, start = key[order], start[order]
            linked = np.zeros(len(key) + 1, dtype=bool)
            linked[1:-1] = (key[1:] == key[:-1]) & (start[1:] - start[:-1] <= slack)
            counted = linked[1:] | linked[:-1]
        found, hits = np.unique(key[counted], return_counts=True)
        found = found[hits >= needed[found % len(needed)]]
        return found // len(needed), found % len(needed)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prepared, anchored, needed, at, item_no, offset = shared.value
        rare = [_mask(a, item) for item, a in zip(prepared, anchored, strict=True)]
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                terms, starts, docs, places = _lists(row)
                for doc, number in zip(*candidates(row, needed, at, item_no, offset), strict=True):
                    item = prepared[number]
                    slots = np.searchsorted(terms, item.terms)
                    off, place = [], []
                    for o, (slot, t) in enumerate(zip(slots.tolist(), item.terms.tolist(), strict=True)):
                        if slot < len(terms) and terms[slot] == t:
                            own = docs[starts[slot] : starts[slot + 1]]
                            a, b = np.searchsorted(own, [doc, doc + 1])
                            if b > a:
                                place.append(places[starts[slot] + a : starts[slot] + b])
                                off.append(np.full(b - a, o))
                    coverage, n = stretches(np.concatenate(off), np.concatenate(place), rare[number], len(item.terms), gap, inner)
                    if coverage >= least and n:
                        out.append((row.ids[doc], item.item_id, float(coverage), n))
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return index.mapInPandas(match, schema)
