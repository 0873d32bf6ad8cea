"""The packed cells of a bibliographic export taken apart: plain functions of strings."""

from __future__ import annotations

import re
from collections import Counter

from folioscope.sources.places import place_key

# The labels of affiliation parts, in the order they are written, with their columns.
LABELS = {"subparent": "subparent", "parent 1": "parent1", "parent 2": "parent2", "city": "city", "site": "site", "region": "region", "country": "country"}
PARTS = tuple(LABELS.values())
# How the export numbers authors, counts an author's affiliations, writes identifiers, and opens and ends a reference.
_NUMBERED = re.compile(r"^\s*(\d+)\s*:\s*")
_SEVERAL = re.compile(r"^\s*\[(\d+)\s+affiliations\]\s*")
_BRACKETED = re.compile(r"^(.*?)\s*\((\d{5,})\)\s*$")
_RECONCILED = re.compile(r"^\s*ref\d+\s*\|")
_AFTER_YEAR = re.compile(r"(?<=\(\d{4}\));")


def cell(value: object) -> str:
    """A cell's text; nothing for null, blank and nan."""
    text = "" if value is None else str(value).strip()
    return "" if text.lower() == "nan" else text


def items(value: object) -> list[str]:
    return [x for x in (p.strip() for p in cell(value).split(";")) if x]


def numbered(item: str) -> tuple[int | None, str]:
    """The number an item begins with, if any, and its text."""
    m = _NUMBERED.match(item)
    return (int(m.group(1)), item[m.end() :].strip()) if m else (None, item.strip())


def in_order(value: object) -> bool:
    """Whether a cell's items are numbered 1, 2, 3 and so on."""
    return all(numbered(x)[0] == i for i, x in enumerate(items(value), 1))


def _beside(authors: list[tuple[int | None, str]], others: list[str], surnames: bool) -> list[str]:
    """For each author the item of a parallel list that is surely theirs, or nothing.

    By number when both lists are fully numbered, by place when they are equally long, by surname when it is unique on both sides.
    """
    told = [numbered(x) for x in others]
    if told and all(n is not None for n, _ in told) and all(n is not None for n, _ in authors):
        known = dict(told)
        return [known.get(n, "") for n, _ in authors]
    if len(told) == len(authors):
        return [text for _, text in told]
    out = [""] * len(authors)
    if surnames:
        short = lambda name: re.sub(r"(\s+\S*\.)+$", "", name).strip().lower()
        places = {}
        for i, (_, name) in enumerate(authors):
            places.setdefault(short(name), []).append(i)
        for _, text in told:
            found = places.get(text.partition(",")[0].strip().lower(), [])
            if len(found) == 1:
                out[found[0]] = text
    return out


def authors(names: object, full_names: object, ids: object) -> list[tuple[int, str, str | None, str | None]]:
    """(position, name, full name, id) of each author; an id in brackets behind the full name comes before the id column."""
    listed = [numbered(x) for x in items(names)]
    full, own = _beside(listed, items(full_names), True), _beside(listed, items(ids), False)
    out = []
    for rank, ((number, name), whole, key) in enumerate(zip(listed, full, own, strict=True), 1):
        if m := _BRACKETED.match(whole):
            whole, key = m.groups()
        out.append((number if number is not None else rank, name, whole or None, key or None))
    return out


def affiliation(text: str, countries: frozenset[str]) -> dict[str, object]:
    """An affiliation's parts by their labels; without labels, by place from a known country backwards."""
    text = text.strip()
    found: dict[str, object] = dict.fromkeys(PARTS) | {"raw": text, "labelled": False}
    pieces = [p.strip() for p in text.split(",") if p.strip()]
    for piece in pieces:
        label, colon, value = piece.partition(":")
        column = LABELS.get(label.strip().lower())
        if colon and column and value.strip():
            found |= {column: value.strip(), "labelled": True}
    if pieces and not found["labelled"]:
        order = ("country", "city", "parent1", "subparent") if place_key(pieces[-1]) in countries else ("parent1", "subparent")
        found |= dict(zip(order, reversed(pieces), strict=False))
    return found


def _same(found: dict[str, object]) -> tuple[str, ...]:
    return tuple(str(found[p] or "").strip().lower() for p in PARTS)


def _own_texts(pieces: list[str]) -> list[str]:
    """An author's labelled pieces cut into affiliations: a label that comes again, or too early, begins the next one."""
    order = {label: i for i, label in enumerate(LABELS)}
    texts: list[list[str]] = []
    before = len(order)
    for piece in pieces:
        label, colon, _ = piece.partition(":")
        place = order.get(label.strip().lower()) if colon else None
        if place is None:
            if texts:
                texts[-1].append(piece)
            continue
        if not texts or place <= before:
            texts.append([])
        texts[-1].append(piece)
        before = place
    return [", ".join(t) for t in texts]


def author_links(block: str, document: list[dict[str, object]], countries: frozenset[str]) -> list[tuple[int | None, str]]:
    """An author's affiliations as (position among the document's, text).

    Labelled ones are those equal in every part; of raw ones those whose text stands in the block, the longest first and none
    inside another. What is found nowhere keeps its text without a position.
    """
    text = _SEVERAL.sub("", numbered(block)[1])
    pieces = [p.strip() for p in text.split(",") if p.strip()]
    if not pieces:
        return []
    if any(p.partition(":")[0].strip().lower() in LABELS for p in pieces if ":" in p):
        known = [_same(d) for d in document]
        out: list[tuple[int | None, str]] = []
        for own in _own_texts(pieces):
            key = _same(affiliation(own, countries))
            out.append((known.index(key) + 1 if key in known else None, own))
    else:
        tail = ", ".join(pieces[1:]).lower()
        taken: list[tuple[int, int, int, str]] = []
        for at, d in sorted(enumerate(document, 1), key=lambda x: -len(str(x[1]["raw"]))):
            raw = str(d["raw"]).strip().lower()
            start = tail.find(raw) if raw else -1
            if start >= 0 and not any(a <= start and start + len(raw) <= b for a, b, _, _ in taken):
                taken.append((start, start + len(raw), at, str(d["raw"])))
        out = [(at, raw) for _, _, at, raw in sorted(taken)]
    return out or [(None, ", ".join(pieces[1:]) or text)]


def references(value: object) -> list[tuple[str | None, int | None, str | None, str | None, str]]:
    """(doi, year, authors, title, raw) of each cited reference, reconciled or as exported."""
    text = cell(value)
    if not text:
        return []
    out = []
    if _RECONCILED.match(text):
        for item in items(text):
            fields = [f.strip() for f in item.split("|")]
            if len(fields) < 5:
                out.append((None, None, None, item, item))
                continue
            year = int(fields[2]) if re.fullmatch(r"[+-]?\d+", fields[2]) else None
            out.append((fields[1] or None, year, fields[3] or None, "|".join(fields[4:]).strip() or None, item))
        return out
    for item in (p.strip() for p in _AFTER_YEAR.split(text)):
        if item:
            years = re.findall(r"\((\d{4})\)", item)
            out.append((None, int(years[-1]) if years else None, None, item, item))
    return out


def keywords(value: object) -> list[str]:
    """A cell's keywords, each once whatever its letter case, in the first spelling."""
    first: dict[str, str] = {}
    for word in items(value):
        first.setdefault(word.lower(), word)
    return list(first.values())


def most_common(values: list[str]) -> str:
    """The most frequent value, the least of equally frequent ones."""
    return min(Counter(values).items(), key=lambda x: (-x[1], x[0]))[0]
