from folioscope.llm import format_duplicates
from folioscope.llm.canonical import doi_key, title_key, title_parts


def test_keys():
    assert title_parts("Welding of low-cost foams: a study – of two. ") == ["weldingoflowcostfoams", "astudy", "oftwo"]
    assert title_parts("3.5 rows") == ["35rows"] and title_parts(None) == title_parts(" -- ") == []
    assert format_duplicates.orders(["b", "a"]) == ["ab", "ba"] and len(format_duplicates.orders(list("abcd"))) == 24
    assert format_duplicates.orders(list("gfedcba")) == ["gfedcba", "abcdefg"]
    assert title_key('"A  Low-Cost Thing"') == title_key("a low cost thing.") == "alowcostthing"
    assert doi_key("https://doi.example/10.1234/ABC.5;") == doi_key("doi: 10.1234/abc.5 ") == doi_key("10.1234/abc.5")
    assert doi_key(None) == doi_key("  ") == ""


def test_collapse(spark):
    rows = [
        (1, "Welding of foams: a study", "10.1234/abc.5"), (2, "A STUDY – welding of  foams", "doi:10.1234/ABC.5."), (3, "[Welding of foams. A study]", None),
        (4, "welding of foams: a study", ""), (5, "Welding of foams: a study", "10.1234/abc.6"), (6, None, "10.1234/abc.5"), (7, None, "10.1234/abc.5"),
        (8, "...", None), (9, "!!", None), (10, "热市路文", None), (11, "热市路文 .", None), (11, "热市路文 .", None), (None, "Welding of foams: a study", None),
        (12, "x" * 50_000 + " " + "y" * 50_000, None), (13, "Y" * 50_000 + ": " + "X" * 50_000, None),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, title string, doi string, copies string")
    found = {r.doc_id: (r.first_id, r.copies) for r in format_duplicates.collapse(frame, "doc_id", "title", "doi").collect()}
    assert found == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (8, 1), 9: (9, 1), 10: (10, 2), 11: (10, 2), 12: (12, 2), 13: (12, 2)}


def test_parts_in_any_order(spark):
    rows = [
        (1, "Eat", None), (2, "Tea", None), (3, "Data mining", None), (4, "Mining data", None), (5, "One thing: another thing - third thing", None), (6, "Third thing. One thing: another thing", None),
        (7, "another thing  third thing one thing", None), (8, "thing another: third thing - one thing", None), (9, "open-source maps: a study", "10.1234/x"), (10, "A STUDY   opensource maps", "10.1234/X"),
        (11, "A study: open source maps", "10.1234/y"), (12, "a b c d e f", None), (13, "F: e. d; c? b! a", None), (14, "A. b: c. d. e. f", None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, title string, doi string")
    found = {r.doc_id: r.first_id for r in format_duplicates.collapse(frame, "doc_id", "title", "doi").collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 9, 11: 11, 12: 12, 13: 12, 14: 12}


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(format_duplicates, "SLICE_BITS", 1 << 22)
    monkeypatch.setattr(format_duplicates, "BITS_PER_RECORD", 1 << 11)
    frame = spark.range(0, 6_000, 1, 5).selectExpr("id as doc_id", "concat('Title no ', if(id < 3000, id, if(id < 5000, id % 1500, 0))) as title", "cast(null as string) as doi")
    found = {r.doc_id: (r.first_id, r.copies) for r in format_duplicates.collapse(frame, "doc_id", "title", "doi").collect()}
    key = lambda i: i if i < 3_000 else i % 1_500 if i < 5_000 else 0
    count = {}
    for i in range(6_000):
        count.setdefault(key(i), []).append(i)
    assert found == {i: (count[key(i)][0], len(count[key(i)])) for i in range(6_000)}


def test_few_singletons_pass(spark):
    keyed = spark.range(0, 200_000, 1, 8).selectExpr("id as _id", "xxhash64(id) as _hash", "'x' as _parts", "'' as _doi")
    assert format_duplicates.marked_repeats(keyed, 200_000).where("_again").count() < 0.02 * 200_000


def test_large_group_and_empty(spark):
    frame = spark.range(5_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'One Title', concat('Title no ', id)) as title", "cast(null as string) as doi")
    found = format_duplicates.collapse(frame, "doc_id", "title", "doi").where("copies > 1")
    assert found.count() == 1667 and found.select("first_id").distinct().count() == 1
    empty = frame.where("false")
    assert format_duplicates.collapse(empty, "doc_id", "title", "doi").count() == 0
