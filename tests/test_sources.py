import pytest

from folioscope.corpus import Corpus
from folioscope.sources import fields
from folioscope.sources.wide import NotCleanedError, check_cleaned

ROW = {
    "Authors": "1:Varela A.; 2:Okafor M.", "Author full names": "1:Varela, Ana (59990000001); 2:Okafor, Max (59990000002)", "Author(s) ID": "1:59990000001; 2:59990000002",
    "Affiliations": "subparent: LAB, parent 1: Univ X, city: C, country: K; parent 1: Univ Y, parent 2: CNRS, city: D, country: L",
    "Authors with affiliations": "Varela A., subparent: LAB, parent 1: Univ X, city: C, country: K, parent 1: Univ Y, parent 2: CNRS, city: D, country: L; Okafor M., parent 1: Other",
    "Title": "A title", "Year": "2020.0", "Cited by": "", "DOI": "10.1234/a", "EID": "", "Author Keywords": "Deep Learning; deep learning; maps", "Index Keywords": "Maps",
    "References": "ref1 | 10.9/x | 2015 | Doe J. | Old paper ; ref2 | | | | Raw ref; short | one",
}


def test_authors():
    assert fields.authors("1:A B.; 2:C D.", "2:D, Carl (12345)", "1:77777") == [(1, "A B.", None, "77777"), (2, "C D.", "D, Carl", "12345")]
    assert fields.authors("A B.; C D.", "D; E; F", "1") == [(1, "A B.", None, None), (2, "C D.", None, None)]
    assert fields.authors("Aa B.; Cc D.", "Cc, Dan", "") == [(1, "Aa B.", None, None), (2, "Cc D.", "Cc, Dan", None)]
    assert fields.authors(None, "x", "y") == []


def test_affiliations():
    known = frozenset({"morocco"})
    assert fields.affiliation("Lab, Univ, Rabat, Morocco", known)["parent1"] == "Univ"
    assert fields.affiliation("Lab, Somewhere", known)["parent1"] == "Somewhere"
    assert fields.affiliation("city: R, city: S, nonsense: x", known)["city"] == "S"


def test_links():
    docs = [fields.affiliation(t, frozenset()) for t in ("IEST Team, ENSAM, Univ M", "ENSAM, Univ M", "Other")]
    assert fields.author_links("A B., IEST Team, ENSAM, Univ M", docs, frozenset()) == [(1, "IEST Team, ENSAM, Univ M")]
    assert fields.author_links("A B., nowhere", docs, frozenset()) == [(None, "nowhere")]


def test_references_and_keywords():
    assert fields.references("Doe J. (2015); Roe K., Title (2016)") == [(None, 2015, None, "Doe J. (2015)", "Doe J. (2015)"), (None, 2016, None, "Roe K., Title (2016)", "Roe K., Title (2016)")]
    assert [r[:4] for r in fields.references(ROW["References"])] == [("10.9/x", 2015, "Doe J.", "Old paper"), (None, None, None, "Raw ref"), (None, None, None, "short | one")]
    assert fields.keywords("a; A; b; ") == ["a", "b"] and fields.keywords(None) == []


def test_wide_rows(spark):
    wide = spark.createDataFrame([ROW, {**dict.fromkeys(ROW), "Title": "Other", "EID": "e2"}], ", ".join(f"`{c}` string" for c in ROW))
    check_cleaned(wide)
    c = Corpus.from_dataframe(wide)
    assert {r.eid: (r.year, r.cited_by) for r in c.documents.collect()} == {"10.1234/a": (2020, 0), "e2": (None, 0)}
    assert [(r.position, r.scopus_id) for r in c.authors.orderBy("position").collect()] == [(1, "59990000001"), (2, "59990000002")]
    assert [(r.position, r.aff_pos) for r in c.author_affiliations.orderBy("position", "aff_pos").collect()] == [(1, 1), (1, 2), (2, None)]
    assert {(r.keyword, r.kind) for r in c.keywords.collect()} == {("Deep Learning", "author"), ("maps", "author"), ("Maps", "index")}
    assert c.references.count() == 3 and c.n_institutions() == 3 and len(c) == 2 and c.n_authors() == 2
    with pytest.raises(NotCleanedError):
        check_cleaned(spark.createDataFrame([("A B.; C D.",)], "Authors string"))
    with pytest.raises(ValueError):
        Corpus.from_dataframe(spark.createDataFrame([("x",)], "Authors string"))


def test_csv_round_trip(spark, tmp_path):
    import csv

    with open(tmp_path / "x.csv", "w", encoding="utf-8-sig", newline="") as f:
        out = csv.DictWriter(f, ROW)
        out.writeheader()
        out.writerow({**ROW, "Title": 'Two\nlines, "quoted"'})
    c = Corpus.from_csv(spark, str(tmp_path / "x.csv"))
    assert c.documents.first().title == 'Two\nlines, "quoted"'
    c.write(str(tmp_path / "out"))
    again = Corpus.read(spark, str(tmp_path / "out"))
    assert again.references.count() == 3 and again.documents.columns == c.documents.columns


def test_unify(spark):
    authors = spark.createDataFrame([("a", 1, "Doe J.", None, "1"), ("b", 1, "Doe John", None, "1"), ("c", 1, "Doe J.", None, "1"), ("d", 1, "doe j", None, None)], "eid string, position int, name string, full_name string, scopus_id string")
    affs = spark.createDataFrame([("a", 1, "Université X"), ("b", 1, "Universite X"), ("c", 1, "Université X")], "eid string, aff_pos int, parent1 string")
    words = spark.createDataFrame([("a", "Maps", "author"), ("b", "maps", "author"), ("c", "maps", "author"), ("a", "MAPS", "index")], "eid string, keyword string, kind string")
    c = Corpus.from_tables({"authors": authors, "affiliations": affs, "keywords": words})
    assert sorted(r.name for r in c.authors.collect()) == ["Doe J.", "Doe J.", "Doe J.", "doe j"]
    assert {r.parent1 for r in c.affiliations.collect()} == {"Université X"}
    assert sorted((r.keyword, r.kind) for r in c.keywords.collect()) == [("MAPS", "index"), ("maps", "author"), ("maps", "author"), ("maps", "author")]


def test_countries_of_unlabelled_affiliations(spark):
    row = {**dict.fromkeys(ROW), "Title": "A title", "Affiliations": "Lab, Univ, Rabat, Morocco; Team, ENS, Paris, FRANCE; Dept, Univ, Abidjan, Côte d'Ivoire; Dept, Univ Z; Inst, Pohang, Republic of Korea"}
    wide = spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in ROW))
    found = [(r.city, r.country, r.parent1) for r in Corpus.from_dataframe(wide).affiliations.orderBy("aff_pos").collect()]
    assert found == [("Rabat", "Morocco", "Univ"), ("Paris", "FRANCE", "ENS"), ("Abidjan", "Côte d'Ivoire", "Univ"), (None, None, "Univ Z"), ("Pohang", "Republic of Korea", "Inst")]
    listed = spark.createDataFrame([("XX", "Morocco", None, None)], "alpha2 string, name string, common_name string, official_name string")
    assert [r.country for r in Corpus.from_dataframe(wide, listed).affiliations.orderBy("aff_pos").collect()] == ["Morocco", None, None, None, None]
