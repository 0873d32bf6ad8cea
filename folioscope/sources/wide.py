"""A wide export, one row per document with packed cells, as the six tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.runtime import durable, ship_package
from folioscope.sources import fields
from folioscope.sources.places import known_countries, place_key

# The columns of the export and where they go.
HEADERS = {
    "title": "Title", "year": "Year", "source": "Source title", "source_abbr": "Abbreviated Source Title", "doc_type": "Document Type", "language": "Language of Original Document", "cited_by": "Cited by",
    "doi": "DOI", "link": "Link", "abstract": "Abstract", "open_access": "Open Access", "issn": "ISSN", "publisher": "Publisher",
}
PACKED = ("Authors", "Author full names", "Author(s) ID", "Affiliations", "Authors with affiliations", "Author Keywords", "Index Keywords", "References")
_NESTED = """eid string,
 authors array<struct<position:int,name:string,full_name:string,scopus_id:string>>,
 affiliations array<struct<aff_pos:int,raw:string,labelled:boolean,subparent:string,parent1:string,parent2:string,city:string,site:string,region:string,country:string>>,
 links array<struct<position:int,aff_pos:int,raw:string>>, keywords array<struct<keyword:string,kind:string>>,
 refs array<struct<ref_pos:int,ref_doi:string,ref_year:int,ref_authors:string,ref_title:string,ref_raw:string>>"""


class NotCleanedError(ValueError):
    """The export's author lists aren't numbered, so authors can't be told from one another."""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """An export file with every column as text; a byte order mark before the first header is dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, encoding="UTF-8", enforceSchema=False)
    return raw.toDF(*(c.lstrip("﻿") for c in raw.columns))


def check_cleaned(wide: DataFrame) -> None:
    """NotCleanedError if some author cell isn't numbered 1, 2, 3 in order; one aggregate over the file."""
    if "Authors" not in wide.columns:
        return
    listed = F.filter(F.transform(F.split("Authors", ";"), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda x: F.regexp_extract(x, r"^\s*(\d+)\s*:", 1).try_cast("int")
    good = F.forall(F.transform(listed, lambda x, i: F.coalesce(number(x) == i + 1, F.lit(False))), lambda x: x)
    cells = wide.where("trim(Authors) <> '' and lower(trim(Authors)) <> 'nan'")
    n, bad, example = cells.agg(F.count(F.lit(1)), F.count(F.when(~good, 1)), F.min(F.when(~good, F.substring("Authors", 1, 120)))).first()
    if bad:
        raise NotCleanedError(f"{bad} of {n} author cells are not numbered in order, such as {example!r}; clean the export first")


def build_tables(wide: DataFrame, countries: DataFrame | list[str] | None = None) -> dict[str, DataFrame]:
    """The six tables of a wide frame; only Title is required, other missing columns are empty.

    `countries` is a reference list, or the names, by which the last part of an unlabelled affiliation is known to be a country; without
    it the names that Java knows are used. Rows are numbered in
    input order where a document has neither EID, DOI nor title. The cells are parsed once, and the parsed rows written.
    """
    if "Title" not in wide.columns:
        raise ValueError("the export has no Title column")
    spark = wide.sparkSession
    ship_package(spark)
    have = set(wide.columns)

    def text(name: str) -> Column:
        trimmed = F.trim(F.col(f"`{name}`")) if name in have else F.lit(None).cast("string")
        return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed)

    whole = lambda name: text(name).try_cast("double").try_cast("int")
    eid = F.coalesce(text("EID"), text("DOI"), F.concat(F.lit("t:"), F.substring(F.md5(F.lower(text("Title"))), 1, 16)), F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string")))
    numeric = {"year": whole("Year"), "cited_by": F.coalesce(whole("Cited by"), F.lit(0))}
    base = durable(wide.select(eid.alias("eid"), *(numeric.get(c, text(h)).alias(c) for c, h in HEADERS.items()), *(text(h).alias(h) for h in PACKED)), "export-rows")
    known = frozenset(map(place_key, known_countries(spark, countries)))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False, name=None):
                key, names, full, ids, places, blocks, own, index, refs = r
                affs = [fields.affiliation(t, known) for t in fields.items(places)]
                links = [(i, p, t) for i, b in enumerate(fields.items(blocks), 1) for p, t in fields.author_links(b, affs, known)]
                words = [(w, k) for cell, k in ((own, "author"), (index, "index")) for w in fields.keywords(cell)]
                out.append((
                    key, fields.authors(names, full, ids), [(i, a["raw"], a["labelled"], *(a[p] for p in fields.PARTS)) for i, a in enumerate(affs, 1)],
                    links, words, [(i, *x) for i, x in enumerate(fields.references(refs), 1)],
                ))
            yield pd.DataFrame(out, columns=["eid", "authors", "affiliations", "links", "keywords", "refs"])

    nested = durable(base.select("eid", *PACKED).mapInPandas(parse, _NESTED), "export-parts")
    part = lambda c: nested.select("eid", F.inline(c))
    return {
        "documents": base.select("eid", *HEADERS), "authors": part("authors"), "affiliations": part("affiliations"), "author_affiliations": part("links"), "keywords": part("keywords"), "references": part("refs"),
    }
