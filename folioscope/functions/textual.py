"""Text functions on columns: folding, DOIs, tokens and n-grams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English stop words, and words of scientific writing that say nothing of a subject.
_ENGLISH = """
a about above after again against all also am an and any are as at be because been before being below between both but by can cannot
could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in
into is it its itself just me more most my myself no nor not now of off on once only or other others ought our ours ourselves out over
own same she should so some such than that the their theirs them themselves then there these they this those through to too under until
up very was we were what when where which while who whom why will with would you your yours yourself yourselves
"""
_SCIENTIFIC = """
paper article study studies research researches propose proposed proposes present presented presents result results show shows shown
using use used uses approach approaches method methods methodology based obtain obtained new novel different various several many much
high low large small case cases work works find found analysis analyze analyzed data dataset datasets model models performance
experiment experiments experimental evaluate evaluated evaluation conclusion conclusions introduction discussion aim aims objective
objectives provide provides provided consider considered considering compare compared comparison significant significantly respectively
however therefore thus moreover furthermore additionally finally overall given due within among across per via one two three first
second third best better good well may might must need needs value values number numbers time times year years type types term terms
level levels order set sets part parts problem problems solution solutions
"""
STOPWORDS = sorted(set((_ENGLISH + _SCIENTIFIC).split()))


@F.pandas_udf(T.StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    def plain(text: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return texts.map(plain, na_action="ignore")


def unaccented(column: Column) -> Column:
    """`column` in compatibility decomposition without accents.

    Spark has no such function; texts that aren't ASCII cross to Python in Arrow batches, all others stay where they are.
    """
    ascii_only = F.length(column) == F.octet_length(column)
    return F.when(ascii_only, column).otherwise(_decompose(F.when(~ascii_only, column)))


def plain_title(column: Column) -> Column:
    """Lower-case letters, digits and single spaces of an unaccented text; null where nothing is left."""
    out = F.trim(F.regexp_replace(F.lower(unaccented(column)), "[^a-z0-9]+", " "))
    return F.nullif(out, F.lit(""))


def plain_doi(column: Column) -> Column:
    """The DOI inside a cell, lower case, without closing punctuation; null where there is none."""
    out = F.rtrim(F.lower(F.regexp_extract(column, r"(10\.\d{4,9}/\S+)", 1)), F.lit(".,;)"))
    return F.nullif(out, F.lit(""))


def without_copyright(column: Column) -> Column:
    """A text cut where its copyright line begins."""
    return F.trim(F.regexp_replace(column, r"(?is)(\bcopyright\s*)?[©ⓒ].*", ""))


def tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(unaccented(column)), F.lit(r"[a-z][a-z0-9\-]+"), F.lit(0))


def ngrams(words: Column, size: int, extra: list[str]) -> Column:
    """n-grams of tokens that begin and end with content words, hold two of them and no word under three letters; for
    single words, content words of more than two letters. An n-gram with a word of `extra` is left out."""
    content = lambda w: ~w.isin(*STOPWORDS)
    allowed = lambda w: ~w.isin(*extra) if extra else F.lit(True)
    if size == 1:
        return F.filter(words, lambda w: content(w) & (F.length(w) > 2) & allowed(w))
    count = F.size(words) - size + 1
    windows = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(words, i, size))).otherwise(F.array().cast("array<array<string>>"))
    good = lambda w: content(w[0]) & content(w[size - 1]) & F.forall(w, lambda x: (F.length(x) > 2) & allowed(x))
    return F.transform(F.filter(windows, good), lambda w: F.array_join(w, " "))
