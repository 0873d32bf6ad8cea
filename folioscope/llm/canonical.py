"""Canonical forms of titles, DOIs and words that several operators compare by."""

from __future__ import annotations

import re
import unicodedata

_DOI = re.compile(r"10\.\d{3,9}\s*/\s*[^\s?#]+")
_WORD = re.compile(r"\w+")
_PARTING = re.compile(r"[:;.?!|/]+(?=\s|$)|(?<=\s)[:;|/~\-\u2010-\u2015\u2212]+(?=\s)|[\u2014\u2015\u2026\uff1a\uff1b\u3002]")


# What is written where a title is missing, letters only.
NO_TITLE = ("notitle", "untitled", "notitleavailable", "titlenotavailable", "notavailable", "na", "none", "null", "nan", "unknown")


def letters_and_digits(value: str) -> str:
    """Case-folded letters, digits and their marks of `value`, everything else removed."""
    if value.isascii():
        return "".join(c for c in value.lower() if c.isalnum())
    value = unicodedata.normalize("NFC", value).casefold()
    return "".join(c for c in value if c.isalnum() or unicodedata.category(c)[0] == "M")


def title_parts(title: str | None) -> list[str]:
    """The letters and digits of each part of a title, where punctuation with a space, or a long dash, sets parts apart; none for a title without any."""
    return [kept for part in _PARTING.split(title) if (kept := letters_and_digits(part))] if title else []


def title_key(title: str | None) -> str:
    """A title without case, spacing and punctuation; empty where nothing is left."""
    return letters_and_digits(title) if title else ""


def doi_key(doi: str | None) -> str:
    """A DOI without what stands before or behind it, case and punctuation; empty when missing."""
    if not doi:
        return ""
    folded = doi.casefold()
    found = _DOI.search(folded)
    return letters_and_digits(found.group(0) if found else folded)


def words(text: str) -> list[str]:
    """Lower-case words of `text`."""
    return _WORD.findall(text.lower())
