"""How characteristic a term is of a record's text, by a graph of words instead of term frequency.

In a record's text every occurrence of a term is joined by an edge to each distinct word at most `window` words away; the
term's weight is its degree, the number of distinct neighbours.  A term repeated in one phrase so gains nothing, one used in many
contexts does.  The degree is multiplied by the term's rarity, ln(records / records that have the term), counted over all records.

A term is found in any letter case where it touches no ASCII letter or digit.  Terms are compared in plain form (lower case,
no outer spaces).

Cases: null or blank terms, and records without a text, give no row; a term its record's text doesn't contain has occurrences and
degree 0; of several texts under one record the one with most occurrences counts; repeated rows count once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.skew import join_counted
from folioscope.runtime import durable, ship_package

#: Terms of one record that are looked for in one go; a record with more is split into several rows.
TERMS_AT_ONCE = 512
_WORD = re.compile(r"\w+")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def occurrences(text: str, term: str) -> list[int]:
    """Where `term` starts in `text` (both lower case) without touching an ASCII letter or digit; none overlap."""
    found, at, size = [], text.find(term), len(term)
    while at >= 0:
        end = at + size
        if (at == 0 or text[at - 1] not in _ALNUM) and (end == len(text) or text[end] not in _ALNUM):
            found.append(at)
            at = text.find(term, end)
        else:
            at = text.find(term, at + 1)
    return found


def degrees(text: str, terms: list[str], window: int) -> Iterator[tuple[str, int, int]]:
    """For each term its occurrences in the text and the number of distinct words within `window` words of one."""
    text = text.lower()
    words: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for term in terms:
        found = occurrences(text, term)
        if found and not starts:
            for m in _WORD.finditer(text):
                words.append(m.group())
                starts.append(m.start())
                ends.append(m.end())
        around: set[str] = set()
        for at in found:
            first, last = bisect_right(ends, at), bisect_left(starts, at + len(term))
            around.update(words[max(0, first - window) : first])
            around.update(words[last : last + window])
        yield term, len(found), len(around)


def score_terms(terms: DataFrame, texts: DataFrame, record_col: str, term_col: str, text_col: str, *, window: int = 4, min_occurrences: int = 0) -> DataFrame:
    """One row per record and plain term: `occurrences`, `degree`, `records` having the term, `rarity` and `score`.

    `texts` holds all records, also those without a text; they count for the rarity. `min_occurrences` leaves rarer terms out.
    """
    ship_package(texts.sparkSession)
    kind = texts.schema[record_col].dataType
    outer = F.lit(" \t\n\r\x0b\x0c\x85\xa0　")
    held = terms.select(F.col(record_col).alias("rec"), F.lower(F.btrim(F.col(term_col), outer)).alias("term")).where("rec is not null and term <> ''")
    held = durable(held.distinct(), "record-terms")
    documents = texts.select(F.col(record_col).alias("rec"), F.col(text_col).cast("string").alias("text")).where("rec is not null")
    total = documents.agg(F.countDistinct("rec")).first()[0]
    # a record with very many terms is dealt over several rows; their number follows from its count, which is summed before it is shuffled
    many = held.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TERMS_AT_ONCE)
    if many.isEmpty():
        chunks = held.groupBy("rec").agg(F.collect_list("term").alias("terms"))
    else:
        many = durable(many, "term-rich-records")
        rows = held.count()
        rich = join_counted(held, many, ["rec"], "n", rows)
        hot = F.broadcast(many.where(F.col("n") >= max(2, rows // 1_000)).select("rec"))
        usual = held.join(hot, "rec", "left_anti").join(many.select("rec"), "rec", "left_anti").withColumn("part", F.lit(0).cast("long"))
        rich = rich.select("rec", "term", F.pmod(F.xxhash64("term"), F.ceil(F.col("n") / TERMS_AT_ONCE).cast("long")).alias("part"))
        chunks = usual.unionByName(rich).groupBy("rec", "part").agg(F.collect_list("term").alias("terms")).drop("part")
    beside = documents.where("text is not null").join(chunks, "rec")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(rec, *x) for rec, text, asked in zip(rows["rec"], rows["text"], rows["terms"], strict=True) for x in degrees(text, list(asked), window) if x[1] >= min_occurrences]
            yield pd.DataFrame(out, columns=["rec", "term", "occurrences", "degree"])

    schema = T.StructType([T.StructField("rec", kind), T.StructField("term", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("degree", T.LongType())])
    weighed = durable(beside.select("rec", "text", "terms").mapInPandas(weigh, schema), "weighed-terms")
    weighed = weighed.groupBy("rec", "term").agg(F.max(F.struct("occurrences", "degree")).alias("w")).select("rec", "term", "w.occurrences", "w.degree")
    spread = held.groupBy("term").agg(F.count(F.lit(1)).alias("records"))
    scored = join_counted(weighed, spread, ["term"], "records", held.count())
    rarity = F.log(F.lit(float(total)) / F.col("records"))
    return scored.select(F.col("rec").alias(record_col), F.col("term").alias(term_col), "occurrences", "degree", "records", F.lit(total).alias("of"), rarity.alias("rarity"), (F.col("degree") * rarity).alias("score"))
