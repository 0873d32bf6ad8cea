import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pytest

import folioscope.figures.catalog as catalog
import folioscope.operators  # noqa: F401
from folioscope.corpus import Corpus
from folioscope.figures.svg import FigureError, FigureSpec, Series, render
from folioscope.report import Report
from folioscope.sources.places import country_places
from folioscope.sources.workbook import sheet_name, workbook_bytes


@pytest.fixture(scope="module")
def corpus(spark):
    documents, authors, affs, links, words, refs = [], [], [], [], [], []
    for i in range(24):
        e, y = f"e{i:02d}", 2010 + i % 8
        documents.append((e, f"Document number {i} about welding and sealing of metals", y, f"Journal {i % 4}", "Article" if i % 3 else "Review", i % 7, f"10.1234/x{i}", "neural network models of metal fatigue and metal fatigue tests", "All Open Access; Gold Open Access" if i % 2 else None))
        for p in (1, 2, 3):
            authors.append((e, p, f"Author {(i * p) % 9}", None, f"{(i * p) % 9:011d}"))
            affs.append((e, p, f"raw {p}", True, f"Lab {p % 2}", f"Univ {(i + p) % 5}", None, f"City {(i + p) % 4}", None, None, f"Land {(i + p) % 3}"))
            links.append((e, p, p, None))
        words += [(e, f"word {(i * k) % 6}", "author") for k in (1, 2, 3, 5)]
        refs += [(e, k, f"10.1234/x{(i + k) % 24}" if k < 4 else f"10.9999/y{k}", y - k, f"Old {k}", f"An old work with a long title {k}", None) for k in range(1, 8)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Corpus.from_tables({
        "documents": frame(documents, "eid string, title string, year int, source string, doc_type string, cited_by int, doi string, abstract string, open_access string"), "authors": frame(authors, "eid string, position int, name string, full_name string, scopus_id string"),
        "affiliations": frame(affs, "eid string, aff_pos int, raw string, labelled boolean, subparent string, parent1 string, parent2 string, city string, site string, region string, country string"), "author_affiliations": frame(links, "eid string, position int, aff_pos int, raw string"),
        "keywords": frame(words, "eid string, keyword string, kind string"), "references": frame(refs, "eid string, ref_pos int, ref_doi string, ref_year int, ref_authors string, ref_title string, ref_raw string"),
    }, unify=False)


def test_catalogue_has_every_figure():
    assert len(catalog.CATALOG) == 86


@pytest.mark.parametrize("name", ["document-types", "documents-per-year", "price-index", "lotka", "word-dynamics", "zipf", "thematic-map", "network-keywords", "density-countries", "historiograph", "word-cloud", "keyword-treemap", "three-fields", "dendrogram", "trend-and-projection", "citation-network-sources"])
def test_forms_draw(corpus, name):
    data = corpus.figure(name)
    assert ElementTree.fromstring(data).tag.endswith("svg") and data == corpus.figure(name)


def test_map(spark, corpus):
    places = country_places(spark.createDataFrame([(f"L{i}", f"Land {i}", None, None, None, 10.0 * i, 5.0 * i) for i in range(3)], "alpha2 string, name string, common_name string, official_name string, atlas string, lon double, lat double"))
    assert corpus.figure("collaboration-map", places=places).count(b"<circle") == 3


def test_errors(corpus, tmp_path):
    with pytest.raises(KeyError, match="document-types"):
        corpus.figure("document-type")
    with pytest.raises(TypeError):
        corpus.figure("zipf", nonsense=1)
    with pytest.raises(FigureError):
        corpus.figure("zipf", fmt="png")
    with pytest.raises(FigureError):
        corpus.figure("subject-areas")
    with pytest.raises(FigureError):
        render(FigureSpec("pie", "x", (Series("s", ("a",), (1.0,)),), style={"nope": 1}))
    corpus.figure("document-types", path=str(tmp_path / "x.svg"), style={"title": "Mine <&>"})
    assert b"Mine &lt;&amp;&gt;" in (tmp_path / "x.svg").read_bytes()
    assert corpus.figure_catalog().count() == 86


def test_report(corpus):
    report = Report("Title", {"years": "2010-2017"})
    with pytest.raises(ValueError):
        report.to_bytes()
    report.add_table("A part", "Types", corpus.document_types()).add_table("A part", "types", pd.DataFrame({"x": [1, None], "y": ["a<b", None]}))
    report.add_indicators("Other", "Figures", corpus.impact()).add_corpus_figure(corpus, "document-types")
    data = report.to_bytes()
    assert data == report.to_bytes() and len(report) == 4
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert "README.txt" in names and "1-a-part/a-part_tables.xlsx" in names and "3-overview/figures/document-types.svg" in names and "all_tables.xlsx" in names


def test_workbook():
    taken = set()
    assert [sheet_name(n, taken) for n in ("a/b", "A b", "x" * 40, "")] == ["a b", "A b (2)", "x" * 31, "Sheet"]
    book = zipfile.ZipFile(io.BytesIO(workbook_bytes([("One", pd.DataFrame({"a": [1, 2.5, float("nan")], "b": ["x", True, None]}))])))
    sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
    assert len(list(sheet.iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}row"))) == 4


def test_pdf():
    import re
    import zlib

    from folioscope.figures.pdf import from_svg, text_width
    from folioscope.figures.svg import FigureSpec, Series, render

    assert text_width("Aa", 10) == 12.23
    for spec in (
        FigureSpec("pie", "Shares (%)", (Series("n", ("a", "b", "c"), (1.0, 2.0, 3.0)),)), FigureSpec("line", "Läufe", (Series("n", (1, 2, 3), (1.0, None, 3.0)),), "x", "y"),
        FigureSpec("flow", "F", nodes=(("a", 0.0, 0.0, 2.0, 0), ("b", 0.0, 0.0, 2.0, 1)), links=(("a", "b", 2.0),)), FigureSpec("network", "N", nodes=(("a", 0.1, 0.2, 2.0, 0), ("b", 0.9, 0.7, 2.0, 1)), links=(("a", "b", 2.0),)),
    ):
        data = from_svg(render(spec))
        assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n") and data == from_svg(render(spec))
        # every object stands where the table says
        places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data)]
        assert [data[p:].split(b" ", 1)[0] for p in places] == [b"1", b"2", b"3", b"4", b"5"]
        page = zlib.decompress(data[data.index(b"stream\n") + 7 : data.index(b"\nendstream")]).decode("latin-1")
        assert page.count("q /") == page.count(" Q") and spec.title.replace("(", "\\(").replace(")", "\\)") in page


def test_styles():
    from folioscope.figures.pdf import from_svg
    from folioscope.figures.svg import FigureError, FigureSpec, Series, gradient, render, spread

    names, values = tuple("abcdefghij"), (42.0, 31.0, 27.0, 19.0, 17.0, 15.0, 12.0, 11.0, 9.0, 8.0)
    spec = lambda form="vbar", y=values, n=1, **style: FigureSpec(form, "Top authors", tuple(Series(f"s{i}", names, y) for i in range(n)), "x", "y", style=style)
    for style in (
        {"kind": "bar", "palette": "gradient", "value_labels": True}, {"kind": "bar", "palette": "category", "orientation": "horizontal"}, {"kind": "lollipop", "orientation": "horizontal", "color": "#1baf7a"},
        {"kind": "lollipop", "value_labels": True}, {"kind": "line", "value_labels": True}, {"kind": "area", "color": "#4a3aa7"}, {"kind": "pie", "value_labels": True}, {"kind": "donut"}, {"orientation": "horizontal"},
    ):
        assert render(spec(**style)) == render(spec(**style)) != render(spec()) and from_svg(render(spec(**style))).startswith(b"%PDF")
    assert render(spec(kind="bar")) == render(spec()) and b"31" in render(spec(value_labels=True))
    titled, plain = render(spec(subtitle="Years 2010-2013")), render(spec(show_title=False, subtitle="Years 2010-2013"))
    assert b"Top authors" in titled and b"Years 2010-2013" in titled and b"Top authors" not in plain and b"Years" not in plain
    assert gradient("#2a78d6", [1, 5, 10])[-1] == "#2a78d6" and len(set(gradient("#2a78d6", [1, 5, 10]))) == 3
    assert len(set(spread(["#2a78d6", "#eb6834", "#1baf7a"], 7))) == 7
    for bad, match in ((spec(kind="pie", n=2), "single series"), (spec(kind="pie", y=(-1.0, *values[1:])), "positive"), (spec(palette="rainbow"), "palette"), (spec(kind="cube"), "kind"), (spec("network", kind="pie"), "no other kind")):
        with pytest.raises(FigureError, match=match):
            render(bad)
