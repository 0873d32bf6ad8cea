"""A report: tables and figures by section, as one ZIP."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from folioscope.corpus import Corpus
from folioscope.figures.catalog import entry
from folioscope.sources.workbook import workbook_bytes, zipped

#: Rows of a table that go into a workbook, as many as a sheet of this size is read; a longer table is refused.
MOST_ROWS = 100_000


def _slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "section"


class Report:
    """Collects tables and figures; `to_bytes` and `save` write them with a contents sheet and a read-me."""

    def __init__(self, title: str = "Report", filters: Mapping[str, Any] | None = None, created: str = ""):
        self.title, self.filters, self.created = title, dict(filters or {}), created
        self._tables: list[tuple[str, str, pd.DataFrame]] = []
        self._figures: list[tuple[str, str, bytes]] = []

    def __len__(self) -> int:
        return len(self._tables) + len(self._figures)

    def add_table(self, section: str, name: str, table: DataFrame | pd.DataFrame) -> Report:
        if isinstance(table, DataFrame):
            table = table.limit(MOST_ROWS + 1).toPandas()
        if len(table) > MOST_ROWS:
            raise ValueError(f"table {name!r} has more than {MOST_ROWS} rows; limit it first")
        self._tables.append((section, name, table))
        return self

    def add_indicators(self, section: str, name: str, values: Mapping[str, Any] | DataFrame) -> Report:
        """A one-row table, or a mapping, as a table of names and values."""
        if isinstance(values, DataFrame):
            values = values.first().asDict()
        return self.add_table(section, name, pd.DataFrame({"indicator": list(values), "value": [str(v) for v in values.values()]}))

    def add_figure(self, section: str, name: str, data: bytes) -> Report:
        self._figures.append((section, name, data))
        return self

    def add_corpus_figure(self, corpus: Corpus, name: str, section: str | None = None, **options: Any) -> Report:
        found = entry(name)
        return self.add_figure(section or found.page, name, corpus.figure(name, **options))

    def to_bytes(self) -> bytes:
        if not len(self):
            raise ValueError("the report has neither tables nor figures")
        sections = list(dict.fromkeys(s for s, *_ in [*self._tables, *self._figures]))
        files: dict[str, bytes] = {}
        lines = [self.title, "=" * len(self.title), *([f"Created: {self.created}"] if self.created else []), *(f"{k}: {v}" for k, v in self.filters.items()), ""]
        taken: set[str] = set()

        def put(path: str, data: bytes) -> None:
            stem, dot, end = path.rpartition(".")
            k, name = 2, path
            while name.lower() in taken:
                name, k = f"{stem}-{k}{dot}{end}", k + 1
            taken.add(name.lower())
            files[name] = data
            lines.append(f"- {name}")

        for k, section in enumerate(sections, 1):
            folder = f"{k}-{_slug(section)}"
            tables = [(n, t) for s, n, t in self._tables if s == section]
            if tables:
                contents = pd.DataFrame({"table": [n for n, _ in tables], "rows": [len(t) for _, t in tables]})
                put(f"{folder}/{_slug(section)}_tables.xlsx", workbook_bytes([("Contents", contents), *tables]))
            for s, name, data in self._figures:
                if s == section:
                    put(f"{folder}/figures/{_slug(name)}.svg", data)
        if self._tables:
            put("all_tables.xlsx", workbook_bytes([(n, t) for _, n, t in self._tables]))
        return zipped({"README.txt": ("\n".join(lines) + "\n").encode()} | files)

    def save(self, path: str) -> str:
        Path(path).write_bytes(self.to_bytes())
        return path
