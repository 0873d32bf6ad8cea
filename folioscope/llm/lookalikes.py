"""Text in one consistent form: stand-in characters found and replaced, look-alike letters repaired by script.

Full-width forms, joined letters, separate accents, invisible characters and unusual spaces are rewritten wherever they
stand.  Look-alike letters are handled token by token: the dominant script of a token is that of most of its letters, Latin where
that is a tie (phonetic letters and small capitals count for it); only tokens of mixed script are touched.  A token is rewritten in its
dominant script, or else in Latin, when every foreign letter has a look-alike there and the result is a word of the corpus vocabulary
(words written wholly in one script), counted over all texts.
A token of mixed script that isn't rewritten is reported, if it is a Latin word at heart: its letters all have a Latin look-alike or most
are Latin, and one is foreign: phonetic letters, small capitals and mathematical letters anywhere, cased letters of other scripts in a
mostly Latin token. Greek letters that `LOOKALIKES` lacks are the signs of units and formulas (μm, λmax) and aren't reported.

Cases: null text stays null and has no findings; empty text is clean; rows repeated under one id are repaired each.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.runtime import durable, ship_package

# Letters of other scripts, and phonetic letters, with the Latin letter each looks like.
LOOKALIKES = {
    "а": "a", "ә": "e", "В": "B", "в": "b", "Ь": "b", "с": "c", "С": "C", "ԁ": "d", "Ԁ": "D", "е": "e", "Е": "E", "ё": "e", "һ": "h", "Һ": "H",
    "Н": "H", "н": "h", "і": "i", "І": "I", "ї": "i", "ј": "j", "Ј": "J", "к": "k", "К": "K", "М": "M", "м": "m", "п": "n", "о": "o", "О": "O",
    "р": "p", "Р": "P", "ԛ": "q", "Ԛ": "Q", "г": "r", "ѕ": "s", "Ѕ": "S", "т": "t", "Т": "T", "ц": "u", "ѵ": "v", "Ѵ": "V", "ԝ": "w", "Ԝ": "W",
    "х": "x", "Х": "X", "у": "y", "У": "Y", "ү": "y", "Ү": "Y", "А": "A", "ӏ": "l", "Ӏ": "I", "ѡ": "w", "ɩ": "i",
    "α": "a", "Α": "A", "β": "b", "Β": "B", "ϲ": "c", "Ϲ": "C", "ε": "e", "Ε": "E", "Η": "H", "η": "n", "ι": "i", "Ι": "I", "ϳ": "j", "κ": "k", "Κ": "K",
    "Μ": "M", "Ν": "N", "ν": "v", "ο": "o", "Ο": "O", "σ": "o", "ρ": "p", "Ρ": "P", "τ": "t", "Τ": "T", "υ": "u", "Υ": "Y", "χ": "x", "Χ": "X", "γ": "y",
    "Ζ": "Z", "ω": "w", "ϱ": "p", "ί": "i", "ό": "o", "ά": "a",
    "օ": "o", "Օ": "O", "ս": "u", "Ս": "U", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "ա": "w", "ռ": "n", "յ": "j", "Տ": "S", "Լ": "L", "ք": "p",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T",
    "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ა": "a",
    "ɑ": "a", "ɐ": "a", "ɓ": "b", "ɕ": "c", "ɖ": "d", "ɗ": "d", "ə": "e", "ɛ": "e", "ɡ": "g", "ɢ": "g", "ɠ": "g", "ɦ": "h", "ɥ": "h", "ɪ": "i", "ɨ": "i", "ı": "i",
    "ʝ": "j", "ɭ": "l", "ɫ": "l", "ʟ": "l", "ɱ": "m", "ɯ": "m", "ɴ": "n", "ɲ": "n", "ɳ": "n", "ɵ": "o", "ɔ": "o", "ʀ": "r", "ɾ": "r", "ɼ": "r", "ʂ": "s", "ʃ": "s",
    "ʈ": "t", "ʊ": "u", "ʉ": "u", "ʋ": "v", "ʌ": "v", "ʍ": "w", "ʏ": "y", "ʎ": "y", "ʐ": "z", "ʑ": "z", "ɣ": "y",
}

# The characters of each kind of stand-in.
_INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff\x00-\x08\x0e-\x1b\x7f"
_SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_ACCENTS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\ufe20-\ufe2f"
_WIDE_SIGNS = "\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff5e\uffe0-\uffe6"
_WIDE = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a"
_JOINED = "\ufb00-\ufb06"
_CJK = "\u2e80-\u2fff\u3001-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff61-\uff9f"
#: The punctuation of Chinese text that is full-width by nature, when it stands beside a Chinese character.
_HOME_SIGNS = "！（），．：；？～"
_HOME_SIGN = re.compile(rf"(?<=[{_CJK}])[{_HOME_SIGNS}]+|[{_HOME_SIGNS}]+(?=[{_CJK}])")

_KINDS = {
    "invisible": re.compile(f"[{_INVISIBLE}]"),
    "spaces": re.compile(f"[{_SPACES}]"),
    "accents": re.compile(f"[{_ACCENTS}]"),
    "wide": re.compile(f"[{_WIDE}{_WIDE_SIGNS}]"),
    "joined": re.compile(f"[{_JOINED}]"),
}
_TOKEN = re.compile(r"[^\W\d_]+")
_PLAIN_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]")
_OTHER_LETTERS = re.compile(r"[^\W\d_A-Za-zªµºÀ-ÖØ-öø-ɏḀ-ỿıɩ]|[ıɩ]")
#: Something to look at: what is neither printable ASCII, a usual break, nor a character beyond it that stands for nothing else.
_NOT_PLAIN = re.compile("[^\\t-\\r -~\u00a1-\u00ac\u00ae-\u00ff\u2010-\u2029\u2030-\u203e]")
_LATIN_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f\u0250-\u058f]+")


def unify(text: str) -> tuple[str, dict[str, int]]:
    """`text` without stand-ins other than look-alike letters, and how many of each kind there were."""
    counts = {kind: n for kind, pattern in _KINDS.items() if (n := len(pattern.findall(text)))}
    if not counts:
        return text, counts
    if "wide" in counts:
        home = {i for m in _HOME_SIGN.finditer(text) for i in range(m.start(), m.end())}
        if left := counts.pop("wide") - len(home):
            counts["wide"] = left
            text = _KINDS["wide"].sub(lambda m: m.group() if m.start() in home else unicodedata.normalize("NFKC", m.group()), text)
    if "joined" in counts:
        text = _KINDS["joined"].sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if "invisible" in counts:
        text = _KINDS["invisible"].sub("", text)
    if "spaces" in counts:
        text = _KINDS["spaces"].sub(" ", text)
    if "accents" in counts:
        text = unicodedata.normalize("NFC", text)
    return text, counts


@lru_cache(maxsize=None)
def _script(letter: str) -> str:
    """The script of a letter by the first word of its Unicode name; phonetic letters and small capitals are Latin."""
    return unicodedata.name(letter, "OTHER").split(" ", 1)[0]


#: By script, its letters by the Latin letter each looks like; of several the first in the table.
_BACK: dict[str, dict[str, str]] = {}
for _letter, _latin in LOOKALIKES.items():
    _BACK.setdefault(_script(_letter), {}).setdefault(_latin, _letter)


@lru_cache(maxsize=None)
def _foreign(letter: str) -> str:
    """'latin' for a phonetic, small-capital or mathematical form of a Latin letter, 'other' for a cased letter of another script than Greek."""
    if unicodedata.category(letter) not in ("Ll", "Lu", "Lt"):
        return ""
    name, plain = unicodedata.name(letter, ""), unicodedata.normalize("NFKC", letter)
    if name.startswith("LATIN ") or name.startswith("MATHEMATICAL ") and plain.isascii():
        return "latin"
    return "" if name.startswith(("MATHEMATICAL ", "GREEK ")) or plain != letter or not (letter.lower() != letter or letter.upper() != letter) else "other"


def dominant_script(word: str) -> str:
    """The script of most letters of `word`; Latin where it is one of several with as many."""
    counts = Counter(map(_script, word))
    most = max(counts.values())
    return "LATIN" if counts["LATIN"] == most else next(s for s, n in counts.items() if n == most)


def mixed_tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and Latin rewriting of each token that holds look-alikes inside an otherwise Latin word."""
    return ((start, stop, word) for start, stop, word, _, _ in foreign_tokens(text) if word is not None)


def foreign_tokens(text: str) -> Iterator[tuple[int, int, str | None, str | None, bool]]:
    """Each token of mixed script: start, end, its Latin rewriting, its rewriting in another dominant script (null where letters lack a
    look-alike there), and whether its dominant script is Latin."""
    if not _OTHER_LETTERS.search(text):
        return
    for token in _TOKEN.finditer(text):
        word = token.group()
        others = _OTHER_LETTERS.findall(word)
        if not others or not _PLAIN_LETTERS.search(word):
            continue
        script = dominant_script(word)
        home = script == "LATIN"
        imitating = sum(c in LOOKALIKES for c in others)
        latin = len(word) > 2 * len(others)
        back = {} if home else _BACK.get(script, {})
        letters = [c if _script(c) == script else back.get(c) for c in word]
        restored = None if home or None in letters else "".join(letters)
        if imitating == len(others) or (imitating and latin):
            yield token.start(), token.end(), "".join(LOOKALIKES.get(c, c) for c in word), restored, home
        elif restored is not None or any(_foreign(c) == "latin" or (latin and _foreign(c)) for c in others):
            yield token.start(), token.end(), None, restored, home


_REPORT = "_id {id}, _text string, _wide int, _joined int, _accents int, _invisible int, _spaces int, _tokens array<struct<start:int,stop:int,word:string,other:string,home:boolean>>"


def scan(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per text that isn't plain: unified text, counts by kind, mixed-script tokens with their rewritings."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, text in zip(rows["_id"], rows["_text"], strict=True):
                if not _NOT_PLAIN.search(text):
                    continue
                text, counts = unify(text)
                tokens = [{"start": a, "stop": b, "word": w, "other": o, "home": h} for a, b, w, o, h in foreign_tokens(text)]
                if counts or tokens:
                    out.append((key, text, *(counts.get(k, 0) for k in ("wide", "joined", "accents", "invisible", "spaces")), tokens))
            yield pd.DataFrame(out, columns=["_id", "_text", "_wide", "_joined", "_accents", "_invisible", "_spaces", "_tokens"])

    kind = texts.schema[id_col].dataType.simpleString()
    picked = texts.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.where("_text is not null").mapInPandas(look, _REPORT.format(id=kind))


def known_words(texts: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """Those of `wanted` (column word, lower case) that some text writes so; the wanted are of one script each.

    Every text is read; words are made distinct where they are read before they are shuffled, so what moves is the vocabulary and
    not the running text.
    """

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found: set[str] = set()
            for text in rows["_text"]:
                found.update(_LATIN_WORD.findall(text.lower()))
            yield pd.DataFrame({"word": sorted(found)})

    words = texts.select(F.col(text_col).cast("string").alias("_text")).where("_text is not null").mapInPandas(spoken, "word string")
    return words.distinct().join(wanted.distinct(), "word", "left_semi")


def repair(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text that holds stand-ins or tokens of mixed script: id, `clean`, counts `wide`, `joined`, `accents`, `invisible`,
    `spaces`, `repaired` (tokens rewritten in Latin), `restored` (tokens rewritten in another dominant script) and `unresolved` (Latin words
    with foreign letters that have no rewriting or whose rewriting is no known word).

    Texts that are not returned are already in the consistent form.
    """
    ship_package(texts.sparkSession)
    found = durable(scan(texts, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "stand-ins")
    tokens = found.select("_row", F.explode("_tokens").alias("t"))
    forms = tokens.select(F.explode(F.array_compact(F.array("t.word", "t.other"))).alias("form")).select(F.lower("form").alias("word"))
    known = durable(known_words(texts, text_col, forms), "known-words")
    named = lambda c, flag: known.select(F.col("word").alias(c), F.lit(True).alias(flag))
    tokens = tokens.withColumns({"word": F.lower("t.word"), "other": F.lower("t.other")}).join(named("word", "is_word"), "word", "left").join(named("other", "is_other"), "other", "left")
    back = F.col("is_other").isNotNull() & ~F.col("t.home")
    choice = F.when(back, F.col("t.other")).when(F.col("is_word").isNotNull(), F.col("t.word"))
    edit = F.when(choice.isNotNull(), F.struct(F.col("t.start").alias("start"), F.col("t.stop").alias("stop"), choice.alias("word")))
    decided = tokens.groupBy("_row").agg(
        F.array_sort(F.collect_list(edit)).alias("_fixes"), F.count(F.when(back, 1)).alias("_restored"), F.count(F.when(~back & F.col("is_word").isNotNull(), 1)).alias("_repaired"),
        F.count(F.when(choice.isNull() & F.col("t.home"), 1)).alias("_unresolved"),
    )
    joined = found.join(decided, "_row", "left")

    @F.pandas_udf("string")
    def rewritten(text: pd.Series, fixes: pd.Series) -> pd.Series:
        out = []
        for value, edits in zip(text, fixes, strict=True):
            if edits is not None:
                for edit in reversed(list(edits)):
                    value = value[: edit["start"]] + edit["word"] + value[edit["stop"] :]
            out.append(value)
        return pd.Series(out)

    return joined.select(
        F.col("_id").alias(id_col), rewritten("_text", "_fixes").alias("clean"),
        *(F.col(f"_{k}").alias(k) for k in ("wide", "joined", "accents", "invisible", "spaces")),
        *(F.coalesce(f"_{k}", F.lit(0)).cast("int").alias(k) for k in ("repaired", "restored", "unresolved")),
    )
