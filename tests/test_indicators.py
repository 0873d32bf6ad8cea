"""Hand-computed values on small corpora, and behaviour on empty tables."""

import math

import numpy as np
import pytest

from folioscope.api import Corpus
from folioscope.functions.columns import citation_indices
from folioscope.functions.ranking import numbered, ranked
from folioscope.operators.growth import normal_quantile
from folioscope.operators.laws import kolmogorov_smirnov, lotka_exponent, zeta
from folioscope.operators.networks import normalize
from folioscope.plans.queries import EDGES, TABLES


def corpus(spark, documents=(), authors=(), affiliations=(), links=(), keywords=(), references=()):
    f = spark.createDataFrame
    return Corpus.from_tables({
        "documents": f(list(documents), "eid string, year int, cited_by int, title string, doi string, source string, doc_type string, open_access string"), "authors": f(list(authors), "eid string, position int, name string, scopus_id string"),
        "affiliations": f(list(affiliations), "eid string, aff_pos int, parent1 string, parent2 string, city string, country string"), "author_affiliations": f(list(links), "eid string, position int, aff_pos int"),
        "keywords": f(list(keywords), "eid string, keyword string, kind string"), "references": f(list(references), "eid string, ref_pos int, ref_doi string, ref_year int, ref_title string"),
    }, unify=False)


def doc(eid, year=2020, cited=0, title=None, doi=None, source=None, kind=None, access=None):
    return (eid, year, cited, title or f"title {eid}", doi, source, kind, access)


def indices(values):
    ranked = sorted(values, reverse=True)
    h = sum(c >= r for r, c in enumerate(ranked, 1))
    g = sum(sum(ranked[:r]) >= r * r for r in range(1, len(ranked) + 1))
    return h, g, sum(c >= 10 for c in values), round(math.sqrt(sum(ranked[:h]) - h * h), 2)


def test_citation_indices(spark):
    rng = np.random.default_rng(3)
    groups = {"a": [10, 8, 5, 4, 3], "b": [0, 0], "c": [100], "d": [25, 8, 5, 3, 3], **{f"r{i}": rng.integers(0, rng.integers(1, 40), rng.integers(1, 60)).tolist() for i in range(60)}}
    frame = spark.createDataFrame([(k, int(v)) for k, vs in groups.items() for v in vs], "key string, cited_by long")
    found = {r.key: (r.h_index, r.g_index, r.i10_index, r.e_index) for r in citation_indices(frame, ["key"]).collect()}
    assert found == {k: pytest.approx(indices(v)) for k, v in groups.items()}


def test_growth(spark):
    c = corpus(spark, [doc("a", 2020), doc("b", 2021), doc("c", 2021), *(doc(f"d{i}", 2022) for i in range(4))])
    assert c.cagr().first().cagr == 100.0
    assert [(r.agr, r.cumulative) for r in c.agr().collect()] == [(None, 1), (100.0, 3), (100.0, 7)]
    gap = corpus(spark, [doc("a", 2018), doc("b", 2021)])
    assert [(r.year, r.documents, r.cumulative) for r in gap.production_by_year().collect()] == [(2018, 1, 1), (2019, 0, 1), (2020, 0, 1), (2021, 1, 2)]
    assert tuple(c.cochran_sample_size().first()) == (7, 0.95, 0.05, 0.5, 1.96, 385, 7, 100.0)
    assert normal_quantile(0.975) == pytest.approx(2.2414, abs=5e-4) and normal_quantile(0.99) == 2.5758
    assert c.growth_summary().columns == ["cagr", "agr_mean", "rgr_mean", "doubling_time_mean"]
    table, fit = corpus(spark, [doc(f"{y}{i}", y) for y in range(2015, 2020) for i in range(y - 2013)]).trend_forecast(2, this_year=2030)
    f = fit.first()
    assert (f.slope, f.slope_label, f.intercept, f.years_used, f.last_year, f.last_year_partial) == (1.0, "additional documents per year", 2.0, 5, 2019, False)
    assert [r.fitted for r in table.where("kind = 'forecast'").collect()] == [7.0, 8.0]


def test_ageing(spark):
    c = corpus(spark, [doc("a", 2020)], references=[("a", i, None, y, "x") for i, y in enumerate((2019, 2018, 2017, 2000))])
    r = c.price_index().first()
    assert (r.price_index, r.median_age, r.references, r.documents_with_references, r.window) == (75.0, 2.5, 4, 1, 5)
    assert corpus(spark, [doc("a", 2020)], references=[("a", i, None, y, "x") for i, y in enumerate((2019, 2015, 2010))]).price_index().first().median_age == 5.0


def test_city_scales(spark):
    rows = [("s", 1, "A", None, "R", "K"), ("l", 1, "A", None, "R", "K"), ("l", 2, "B", None, "R", "K"), ("n", 1, "A", None, "R", "K"), ("n", 2, "B", None, "M", "K"), ("i", 1, "A", None, "R", "K"), ("i", 2, "C", None, "Z", "L")]
    c = corpus(spark, [doc(e, cited=2) for e in "slni"], affiliations=rows)
    assert [r.documents for r in c.collaboration_scale().collect()] == [1, 1, 1, 1]
    assert {r.city: r.institutions for r in c.top_cities().collect()} == {"R": 2, "M": 1, "Z": 1}


def test_local_citations(spark):
    long = "A rather long title about the matching of references"
    docs = [doc("d1", doi="10.1234/ABC"), doc("d2", title=long), doc("d3"), doc("d4", title="Short")]
    refs = [("d3", 1, "https://doi.example/10.1234/abc.", None, None), ("d3", 2, None, None, long.upper() + "!"), ("d3", 3, None, None, "Short"), ("d1", 1, "10.1234/abc", None, None)]
    c = corpus(spark, docs, [("d1", 1, "A", "1"), ("d3", 1, "A", "1"), ("d2", 1, "B", None)], references=refs)
    assert {(r.citing, r.cited, r.via) for r in c.citation_pairs().collect()} == {("d3", "d1", "doi"), ("d3", "d2", "title")}
    assert c.self_citation_rate().first().self_rate == 50.0
    nodes, edges = c.historiograph()
    assert nodes.count() == 2 and edges.count() == 0


def test_collaboration(spark):
    authors = [("a", 1, "X", "1"), ("b", 1, "X", "1"), ("b", 2, "Y", "2"), ("c", 1, "X", "1"), ("c", 2, "Y", "2"), ("c", 3, "Z", None), ("c", 3, "Z", None)]
    r = corpus(spark, [doc(x) for x in "abc"], authors).collaboration_indicators().first()
    assert (r.documents, r.single_authored, r.collaboration_index, r.authors, r.max_authors) == (3, 1, 2.0, 3, 3)
    assert r.collaborative_coefficient == pytest.approx(1 - (1 + 1 / 2 + 1 / 3) / 3, abs=1e-4) and r.modified_collaborative_coefficient == pytest.approx(1.5 * (1 - (1 + 1 / 2 + 1 / 3) / 3), abs=1e-4)


def test_lotka():
    assert zeta(2.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    weights = [k**-2.5 / zeta(2.5) for k in range(1, 20_000)]
    assert lotka_exponent(sum(p * math.log(k) for k, p in enumerate(weights, 1))) == pytest.approx(2.5, abs=0.02)
    assert lotka_exponent(0.0) == pytest.approx(6.0) and lotka_exponent(None) is None
    found = kolmogorov_smirnov([(1, 600), (2, 150), (3, 70)], 2.0)
    assert found["critical_5pct"] == round(1.36 / math.sqrt(820), 4) and found.keys() == {"d", "p_value", "critical_5pct", "follows_lotka"}
    assert kolmogorov_smirnov([], 2.0)["d"] is None


def test_lotka_table(spark):
    c = corpus(spark, [doc(x) for x in "abcd"], [("a", 1, "A", "1"), ("b", 1, "A", "1"), ("c", 1, "A", "1"), ("a", 2, "X", "2"), ("b", 2, "Y", "3"), ("c", 2, "Z", None)])
    rows = [(r.documents_written, r.n_authors, r.share_observed, r.share_lotka) for r in c.lotka_table().collect()]
    assert rows == [(1, 3, 0.75, 0.6079), (3, 1, 0.25, 0.0675)]
    fit = c.lotka_fit().first()
    assert fit.constant == pytest.approx(1 / zeta(fit.exponent), abs=1e-5) and fit.exponent_ols == pytest.approx(1.0, abs=1e-6)
    assert [r.share_fitted for r in c.lotka_table().collect()] == [pytest.approx(fit.constant * k**-fit.exponent, abs=1e-4) for k in (1, 3)]
    assert [r.law for r in c.lotka_tests().collect()] == ["fitted", "strict"]


def test_price_law_and_groups(spark):
    c = corpus(spark, [doc(x) for x in "abcd"], [*((x, 1, "A", "1") for x in "abcd"), ("a", 2, "X", "2"), ("b", 2, "Y", "3"), ("c", 2, "Z", "4")])
    assert tuple(c.price_law().first()) == (4, 7, 2, 71.4, 1)
    assert tuple(corpus(spark).price_law().first()) == (0, 0, 0, None, None)
    assert [r.group for r in c.authorship_groups().collect()] == ["1 author", "2 authors", "3 authors", "4+ authors"]


def test_affiliation_profile(spark):
    places = [("a", 1, "U", None, None, None), ("a", 2, None, None, None, None), ("b", 1, "V", None, None, None), ("b", 2, "U", None, None, None), ("c", 1, "W", None, None, None)]
    links = spark.createDataFrame([("a", 1, 1, "U"), ("a", 1, 2, "?"), ("b", 1, 1, "V"), ("b", 2, 2, "U"), ("c", 1, None, "W")], "eid string, position int, aff_pos int, raw string")
    base = corpus(spark, [doc(x) for x in "abcd"], [("a", 1, "X", "1"), ("b", 1, "X", "1"), ("b", 2, "Y", None), ("c", 1, "Y", None)], places)
    c = Corpus.from_tables({**base.tables(), "author_affiliations": links}, unify=False)
    found = {r.author: (r.scopus_id, r.documents, r.institutions, r.max_in_one_document, r.affiliations) for r in c.authors_by_affiliation_count().collect()}
    assert found == {"X": ("1", 2, 3, 2, "U; V; aff#2"), "Y": ("", 2, 2, 1, "U; aff#?")}
    r = c.affiliation_profile().first()
    assert (r.documents, r.single_author_documents, r.single_author_share, r.single_affiliation_documents, r.two_affiliation_documents, r.many_affiliation_documents) == (4, 2, 50.0, 2, 1, 0)
    assert (r.authors, r.authors_with_several_affiliations, r.authors_with_double_affiliation) == (2, 2, 1)


def test_ranked(spark):
    rows = [(f"k{i:03}", (i * 7) % 5) for i in range(200)]
    found, total = ranked(spark.createDataFrame(rows, "k string, v long").repartition(7), "v", "k")
    want, run = [], 0
    for i, (k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        run += v
        want.append((k, i, run))
    assert total == run and [(r.k, r.rank, r.cumulative) for r in found.orderBy("rank").collect()] == want
    same = numbered(spark.range(300).selectExpr("id", "if(id < 200, 'hot', concat('g', id % 3)) as g").repartition(5), "g", "id")
    groups = {}
    for r in sorted(same.collect(), key=lambda r: r.id):
        groups.setdefault(r.g, []).append(r.number)
    assert all(v == list(range(1, len(v) + 1)) for v in groups.values())


def test_networks(spark):
    words = [(e, w, "author") for e, ws in {"a": ["x", "y", "X "], "b": ["x", "y", "z"], "c": ["x"], "d": ["q"]}.items() for w in ws]
    c = corpus(spark, [doc(x) for x in "abcd"], keywords=[*words, ("a", None, "author"), ("a", " ", "author")])
    graph = c.co_word(min_weight=1)
    assert {(r.source, r.target, r.weight) for r in graph[1].collect()} == {("x", "y", 2), ("x", "z", 1), ("y", "z", 1)}
    assert {r.id: (r.occurrences, r.degree) for r in graph[0].collect()} == {"x": (3, 3), "y": (2, 3), "z": (1, 2)}
    assert {(r.source, r.target): r.weight for r in normalize(graph, "jaccard")[1].collect()}["x", "y"] == pytest.approx(2 / 3, abs=1e-6)
    nodes, _, summary = c.network("keywords", min_weight=1, overlay=True)
    assert summary["edges"] == 3 and summary["transitivity"] == 1.0 and {r.overlay_year for r in nodes.collect()} == {2020.0}
    with pytest.raises(ValueError):
        normalize(graph, "nope")


def test_access_routes(spark):
    c = corpus(spark, [doc("a", access="All Open Access; Gold Open Access; Green Open Access"), doc("b", access="All Open Access"), doc("c", access=" "), doc("d")])
    assert {r.route: r.documents for r in c.access_routes().collect()} == {"Gold": 1, "Hybrid": 0, "Bronze": 0, "Green": 1, "Unspecified": 1}
    assert [r.documents for r in c.access_status().collect()] == [2, 2]


def test_journals(spark, tmp_path):
    (tmp_path / "j.csv").write_text('Rank;Sourceid;Title;Type;Issn;SJR;SJR Best Quartile;Areas;Categories;Open Access;Open Access Diamond\n1;10;"Journal of Metal Things";journal;"15424863, 00079235";106,094;Q1;Engineering; Materials\n2;11;"Other Journal Name";journal;"-";1,5;Q2;Medicine;Oncology (Q2);Yes;No\n', encoding="utf-8")
    from folioscope.operators.journals import load_scimago

    table = load_scimago(spark, str(tmp_path / "j.csv"))
    docs = spark.createDataFrame([("a", "X", "1542-4863", 3), ("b", "Other  Journal name", None, 1), ("c", "Unknown", None, 0)], "eid string, source string, issn string, cited_by int")
    c = Corpus.from_tables({"documents": docs}, unify=False)
    found = {r.source: (r.matched_by, r.quartile) for r in c.scimago_sources(table).collect()}
    assert found["Other  Journal name"] == ("title", "Q2") and found["Unknown"] == ("", None)
    assert {r.quartile: r.documents for r in c.quartile_distribution(table).collect()}["Not indexed"] >= 1
    assert c.scimago_coverage().first().matched_sources == 0 and not c.scimago_coverage().first().available
    assert {r.access: r.sources for r in c.journal_open_access(table).collect()} == {"Open access": 1, "Subscription": 0, "Unknown": 2}
    assert c.interdisciplinarity(table).columns[5] == "top_area_share" and c.interdisciplinarity().first().coverage == 0.0


def test_filter(spark):
    c = corpus(spark, [doc("a", 2019, kind="Article"), doc("b", 2020, kind="Review"), doc("c", 2021, kind="Article")], [("a", 1, "X", None), ("c", 1, "Y", None)], [("a", 1, None, None, None, "K"), ("c", 1, None, None, None, "L")])
    assert {r.eid for r in c.filter(years=(2019, 2020)).documents.collect()} == {"a", "b"}
    assert {r.eid for r in c.filter(years=[2019, 2020, 2021], doc_types=["Article"], countries=["L"]).authors.collect()} == {"c"}
    assert len(c.filter(years=None, sources=[])) == 3


@pytest.mark.parametrize("name", sorted(TABLES))
def test_empty_corpus(spark, name):
    method, options = TABLES[name]
    getattr(corpus(spark), method)(**options).collect()


@pytest.mark.parametrize("name", sorted(EDGES))
def test_empty_networks(spark, name):
    method, options = EDGES[name]
    assert getattr(corpus(spark), method)(**options)[1].count() == 0


def test_title_groups_beside_doi_groups(spark):
    long = "a title of more than twenty five letters"
    c = corpus(spark, [doc("a", title=long, doi="10.1000/x"), doc("b", title=long.upper(), doi="10.1000/x"), doc("c", title=long, doi="10.1000/y"), doc("d", title=long), doc("e", title="short"), doc("f", title="short")])
    assert [(r.kind, r.key, r.documents) for r in c.duplicates().collect()] == [("Title", long, 4), ("DOI", "10.1000/x", 2)]


def test_all_titles_of_a_large_group(spark):
    c = corpus(spark, [doc(f"d{i}", title=f"title {i % 30:02}", doi="10.1000/x") for i in range(60)])
    assert [(r.documents, r.titles) for r in c.duplicates().collect()] == [(60, " | ".join(f"title {i:02}" for i in range(30)))]
