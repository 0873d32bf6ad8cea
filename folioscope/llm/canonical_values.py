"""Freely typed values mapped to the entries of a reference list.

Each distinct value is looked at once.  A multi-pattern automaton over the folded names and aliases finds every mention that
stands on word borders; the longest ones that don't overlap win, and a value that mentions one entry means it.  What mentions
none goes to token-set similarity: the value's words must cover all words of some short alias, where a word of the alias is
met by the same word, by a contraction if several entries use it (N. for North), or by one that is a few edits away; the whole
value without title words, spaces dropped, is compared too, for letters set apart and spaces lost.  A value that fits several
entries equally well means none of them.

Words that entries have only in their longer forms (Republic of, Kingdom of) are titles; they are learnt from the list.

Cases: null values are left out; blank values, and values without letters or digits, match nothing; entries without a usable
name never match; a name that two entries share is ambiguous and matches nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.skew import join_counted
from folioscope.runtime import durable, ship_package

#: The reference list is sent to every executor; a longer list is refused rather than broadcast.
MOST_ENTRIES = 200_000
#: Longer words and names aren't indexed by what edits leave of them, which would be very many forms, but compared by length.
_LONG = 60
_APART = re.compile(r"[\W_]+")


def fold(value: str) -> str:
    """Case-folded words of `value` without accents, one space between them."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))
    return _APART.sub(" ", plain).strip()


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps (also around other edits) between two words, at most `most` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    big = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[big] * (len(b) + 2), [big, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [big, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            row.append(min(d[i][j] + cost, row[j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        d.append(row)
        last[x] = i
    return min(d[-1][-1], most + 1)


def allowed(word: str) -> int:
    """How many edits a word of this length may be away."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def contraction(short: str, word: str) -> bool:
    """Whether `short` is `word` with later letters left out."""
    if not 0 < len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def _deletes(word: str, most: int) -> set[str]:
    return {"".join(c for i, c in enumerate(word) if i not in gone) for n in range(min(most, len(word) - 1) + 1) for gone in combinations(range(len(word)), n)}


class Matcher:
    """Folded names of the list, their automaton and the indexes of the similarity step."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        self.owner: dict[str, str | None] = {}
        short: dict[str, list[str]] = {}
        every: dict[str, set[str]] = {}
        for key, names in entries:
            folded = [f for f in map(fold, names) if f]
            for name in folded:
                self.owner[name] = key if self.owner.get(name, key) == key else None
            if folded:
                least = min(len(f.split()) for f in folded)
                short[key] = sorted({f for f in folded if len(f.split()) == least})
                every[key] = {w for f in folded for w in f.split()}
        used = Counter(w for words in every.values() for w in words)
        core = Counter(w for names in short.values() for w in {w for f in names for w in f.split()})
        self.titles = {w for key, words in every.items() for w in words - {w for f in short[key] for w in f.split()} if not core[w]}
        # an entry whose only names are long still has its title words told by the others
        self.short: dict[str, set[str]] = {}
        for key, names in short.items():
            self.short[key] = {" ".join(w for w in f.split() if w not in self.titles) or f for f in names}
        for key, names in self.short.items():
            for name in names:
                self.owner[name] = key if self.owner.get(name, key) == key else None
        self.automaton = ahocorasick.Automaton()
        for name, key in self.owner.items():
            if key is not None:
                self.automaton.add_word(f" {name} ", (len(name), key))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.qualifiers = {w for w, n in used.items() if n > 1 and w not in self.titles}
        self.joined: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self.by_word: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self.long_joined: dict[int, set[tuple[str, str]]] = defaultdict(set)
        self.long_words: dict[int, set[tuple[str, str]]] = defaultdict(set)
        for key, names in self.short.items():
            for name in names:
                whole = name.replace(" ", "")
                self._index(whole, (whole, key), self.joined, self.long_joined)
                words = name.split()
                rare = [w for w in words if w not in self.qualifiers] or words
                for word in rare:
                    self._index(word, (name, key), self.by_word, self.long_words)

    @staticmethod
    def _index(word: str, entry: tuple[str, str], forms: dict[str, set], lengths: dict[int, set]) -> None:
        # long ones near the border are found either way, whichever side of it the other is on
        if len(word) <= _LONG:
            for form in _deletes(word, allowed(word)):
                forms[form].add(entry)
        if len(word) > _LONG - 2:
            lengths[len(word)].add(entry)

    @staticmethod
    def _near(word: str, forms: dict[str, set], lengths: dict[int, set]) -> Iterator[tuple[str, str]]:
        """Entries that may be as few edits away as a word of this length allows."""
        if len(word) <= _LONG:
            for form in _deletes(word, allowed(word)):
                yield from forms.get(form, ())
        if len(word) > _LONG - 2:
            for n in range(len(word) - 2, len(word) + 3):
                yield from lengths.get(n, ())

    def mentions(self, folded: str) -> list[str]:
        """Entries named in a folded value by the longest mentions that don't overlap."""
        if not len(self.automaton):
            return []
        found = [(-size, end - size, key) for end, (size, key) in self.automaton.iter(f" {folded} ")]
        taken: list[tuple[int, int]] = []
        keys = []
        for size, start, key in sorted(found):
            stop = start - size
            if all(stop <= a or start >= b for a, b in taken):
                taken.append((start, stop))
                keys.append(key)
        return keys

    def _covers(self, words: list[str], name: str) -> int | None:
        """Edits needed for `words` to cover every word of `name`, or None."""
        left, total = list(words), 0
        for word in name.split():
            best = None
            for w in left:
                if w == word:
                    cost = 0
                elif word in self.qualifiers and contraction(w, word):
                    cost = 0
                else:
                    most = min(allowed(word), 1) if word in self.qualifiers else allowed(word)
                    if w in self.titles or w in self.qualifiers or (cost := edits(w, word, most)) > most:
                        continue
                if best is None or cost < best[0]:
                    best = (cost, w)
            if best is None:
                return None
            left.remove(best[1])
            total += best[0]
        return total

    def similar(self, folded: str) -> tuple[str | None, float]:
        """The entry nearest to a folded value, if one is near enough and no other is as near."""
        words = folded.split()
        own = [w for w in words if w not in self.titles]
        costs: dict[str, int] = {}
        whole = "".join(own)
        for name, key in self._near(whole, self.joined, self.long_joined) if len(whole) > 3 else ():
            if (cost := edits(whole, name, allowed(name))) <= allowed(name):
                costs[key] = min(cost, costs.get(key, cost))
        for name, key in {e for w in set(own) for e in self._near(w, self.by_word, self.long_words)}:
            cost = self._covers(own, name)
            if cost is not None:
                costs[key] = min(cost, costs.get(key, cost))
        if not costs:
            return None, 0.0
        least = min(costs.values())
        nearest = [k for k, c in costs.items() if c == least]
        return (nearest[0], 1.0 - least / max(1, len(whole))) if len(nearest) == 1 else (None, 0.0)

    def match(self, value: str) -> tuple[str | None, str, float]:
        folded = fold(value)
        if not folded:
            return None, "none", 0.0
        if self.owner.get(folded):
            return self.owner[folded], "name", 1.0
        keys = set(self.mentions(folded))
        if len(keys) == 1:
            return keys.pop(), "mention", 1.0
        if keys:
            return None, "ambiguous", 0.0
        key, score = self.similar(folded)
        return key, "similar" if key else "none", score


def map_values(values: DataFrame, value_col: str, entries: DataFrame, key_col: str, name_cols: list[str]) -> DataFrame:
    """One row per distinct value that isn't null: `value_col`, `n` rows, `key` (null if no entry is meant), `how`, `score`."""
    spark = values.sparkSession
    ship_package(spark)
    listed = entries.where(F.col(key_col).isNotNull()).select(F.col(key_col).cast("string").alias("key"), *(F.col(c).cast("string").alias(f"n{i}") for i, c in enumerate(name_cols)))
    rows = listed.limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    shared = spark.sparkContext.broadcast(sorted((r[0], [v for v in r[1:] if v]) for r in rows))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for frame in batches:
            found = [matcher.match(v) for v in frame["value"]]
            yield pd.DataFrame({"value": frame["value"], "n": frame["n"], "key": [f[0] for f in found], "how": [f[1] for f in found], "score": [f[2] for f in found]})

    distinct = values.select(F.col(value_col).cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    matched = distinct.mapInPandas(look, "value string, n long, key string, how string, score double")
    return matched.withColumnRenamed("value", value_col)


def map_rows(rows: DataFrame, value_col: str, entries: DataFrame, key_col: str, name_cols: list[str]) -> DataFrame:
    """`rows` whose value isn't null, with `key`, `how` and `score` of the entry their value means; columns of these names are replaced."""
    valued = rows.withColumn("_value", F.col(value_col).cast("string")).where("_value is not null").drop("key", "how", "score", "_rows")
    matched = durable(map_values(valued, "_value", entries, key_col, name_cols), "value-matches")
    total = matched.agg(F.sum("n")).first()[0] or 0
    return join_counted(valued, matched.withColumnRenamed("n", "_rows"), ["_value"], "_rows", total).drop("_rows", "_value")
