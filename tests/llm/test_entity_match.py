import random
from pathlib import Path

import numpy as np

from folioscope.llm import entity_match as em

NOUNS = "rivers metals ports fuels sands vaults looms grains tunnels meshes alloys shoals herds yeasts".split()
ACTS = "welding staging coding tracing damping sealing routing pooling tuning grading".split()


def world(n=220):
    rng = random.Random(2)
    documents, authors, references, want = [], [], [], set()
    for i in range(n):
        title = f"On {rng.choice(ACTS)} of {rng.choice(NOUNS)} and {rng.choice(NOUNS)} for {rng.choice(ACTS)} in {''.join(rng.choices('abcdefgklmnoprst', k=9))}"
        names = [f"{''.join(rng.choices('bdfgklmnprst', k=6)).title()} {c}." for c in "AB"[: 1 + i % 2]]
        year, doi = 2000 + i % 20, f"10.9{i:04d}/abc.{2000 + i % 20}.{rng.randint(10**9, 10**10)}"
        documents.append((i, f"e{i}", doi if i % 7 else None, title, year))
        authors += [(f"e{i}", k + 1, a) for k, a in enumerate(names)]
        form = i % 6
        given = ", ".join(names)
        reference = [
            (doi.upper() + ".", title, year, given, None), (None, title.upper(), year + 1, given, None), (None, title.replace("o", "", 1), year, names[0] + " et al.", None),
            ("https://doi.example/" + doi, None, year, given, None), (None, f"{given} ({year}) {title}", None, None, None), (None, title[:25], year, given, f"{given} ({year}) {title[:25]}"),
        ][form]
        references.append((f"r{i}", 1, *reference))
        want.add((f"r{i}", 1, i))
        references.append((f"r{i}", 2, f"10.8{i:04d}/zzz.{year}.{rng.randint(10**9, 10**10)}", title + ", part II", year + 4, "Xyzzy Q.", None))
        references.append((f"r{i}", 3, None, f"Towards {rng.choice(ACTS)} of other {rng.choice(NOUNS)}", year, "Plugh W.", None))
    references += [("r0", 1, *references[0][2:]), ("rn", 1, None, None, None, None, None), (None, 1, None, "a title", 2000, None, None)]
    return documents, authors, references, want


def sides(spark, documents, authors, references):
    left = spark.createDataFrame(references, "eid string, ref_pos int, doi string, title string, year int, authors string, raw string")
    right = spark.createDataFrame([(*d, "x") for d in documents], "doc_id long, eid string, doi string, title string, year int, confidence string")
    names = spark.createDataFrame(authors, "eid string, position int, name string")
    return em.reference_side(left, ["eid", "ref_pos"], "doi", "title", "year", "authors", "raw"), em.document_side(right, names, "doc_id", "eid", "doi", "title", "year", "position", "name")


def test_matches(spark):
    documents, authors, references, want = world()
    left, right = sides(spark, documents, authors, references)
    found = {(r.eid, r.ref_pos, r.doc) for r in em.match(left, right).collect()}
    assert len(found - want) <= 0.02 * len(want) and len(want - found) <= 0.05 * len(want)
    assert not any(p != 1 for _, p, _ in found)


def test_few_rows_and_empty(spark):
    documents, authors, references, _ = world(3)
    left, right = sides(spark, documents, authors, references)
    found = {(r.eid, r.ref_pos, r.doc) for r in em.match(left, right).collect()}
    assert ("r1", 1, 1) in found and not any(p != 1 for _, p, _ in found)
    assert em.match(left.where("false"), right).count() == em.match(left, right.where("false")).count() == 0


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4_000, 2))
    y = (rng.random(4_000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.abs(em.fit_logistic(x, y) - [1, 2, -1]).max() < 0.25


def test_long_titles_with_many_edits(spark):
    words = [f"{a}{b}ration" for a in "bcdfg" for b in "aeiou"]
    title = " ".join(words)
    typed = " ".join(w[:3] + "x" + w[4:] if i % 5 < 3 else w for i, w in enumerate(words))
    side = "struct<doi:string,title:string,years:array<int>,names:array<string>,first:string>"
    pairs = spark.createDataFrame([(1, 2, (None, typed, [2020], ["berg"], "berg"), (None, title, [2020], ["berg"], "berg"))], f"rid long, did long, r {side}, d {side}")
    found = em._features(pairs).first()
    assert round(found.f1, 6) == 1 - 15 / 200 and found.f5 == 0


def test_all_surnames_of_a_document(spark):
    documents = spark.createDataFrame([(1, "r", None, "a title", 2020)], "doc_id long, eid string, doi string, title string, year int")
    authors = spark.createDataFrame([("r", i, f"name{i:02} A.") for i in range(80)] + [("r", 80, "name00 B.")], "eid string, position int, name string")
    found = em.document_side(documents, authors, "doc_id", "eid", "doi", "title", "year", "position", "name").first()
    assert found.names == [f"name{i:02}" for i in range(80)] and found.first == "name00"


def test_crowded_blocks(spark, monkeypatch):
    """DOIs without a dot behind the slash, and one author of a third of the documents, don't make candidates of all with all."""
    monkeypatch.setattr(em, "CROWD", 20)
    n, rng = 6_000, random.Random(4)
    made = lambda: "".join(rng.choices("abcdefghiklmnoprstu", k=7))
    titles = [f"{made()} {made()} for {made()} and {rng.choice(NOUNS)}" for _ in range(n)]
    documents = [(i, f"e{i}", f"10.1038/n{i:07d}", titles[i], 2000 + i % 20) for i in range(n)]
    authors = [(f"e{i}", 1, "Wang A." if i % 3 == 0 else f"{made()} B.") for i in range(n)]
    references = [(f"r{i}", 1, f"10.1038/n{i:07d}" if i % 2 else None, titles[i].upper(), 2000 + i % 20, authors[i][2], None) for i in range(n)]
    left, right = sides(spark, documents, authors, references)
    a, b = em._classes(left, "left")[1], em._classes(right, "right")[1]
    common = em.common_words(b)
    pairs = em._candidates(a, b, common)
    assert pairs.count() < 12 * n
    assert em._keys(b, common, False).where(em._kind() == 41).count() == 0
    found = {(r.eid, r.doc) for r in em.match(left, right).collect()}
    want = {(f"r{i}", i) for i in range(n)}
    assert len(want - found) <= 0.001 * n and len(found - want) <= 0.001 * n


def pairs_of(frame):
    return {(r.rid, r.did) for r in frame.collect()}


def test_crowded_blocks_keep_all_pairs(spark, monkeypatch):
    """One surname and one beginning, titles of one word each time mistyped, and references without a title: nothing else in common."""
    monkeypatch.setattr(em, "CROWD", 5)
    n = 12
    documents = [(i, f"e{i}", None, "Xenobiotransformation" + "abcdefghiklm"[i] * 3, 2000) for i in range(n)]
    authors = [(f"e{i}", 1, "Wang A.") for i in range(n)]
    references = [(f"r{i}", 1, None, "Xenobiotransfromation" + "abcdefghiklm"[i] * 3, 2000, "Wang A.", None) for i in range(n)]
    references += [(f"s{i}", 1, f"10.1234/{i}", None, 2000, "Wang A.", None) for i in range(n)]
    left, right = sides(spark, documents, authors, references)
    a, b = em._classes(left, "left")[1], em._classes(right, "right")[1]
    common = em.common_words(b)
    want = {(x.cls, y.cls) for x in a.collect() for y in b.collect()}
    assert pairs_of(em._whole_blocks(a, b, common)) == want
    found = {(r.eid, r.doc) for r in em.match(left, right).collect()}
    assert {(f"r{i}", i) for i in range(n)} <= found


def crowd(spark, n):
    """One surname, one beginning and one year: every reference is a candidate of every document, and their long titles tell them apart."""
    rng = random.Random(7)
    titles = ["Xenobiology " + " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=9)) for _ in range(12)) for _ in range(n)]
    documents = [(i, f"e{i}", None, titles[i], 2000) for i in range(n)]
    return sides(spark, documents, [(f"e{i}", 1, "Wang A.") for i in range(n)], [(f"r{i}", 1, None, titles[i].upper(), 2000, "Wang A.", None) for i in range(n)])


def test_references_are_sent_once_to_a_home(spark, monkeypatch):
    """Not for each of 60 x 60 candidates; and what only a step of the matching reads is removed after it."""
    files, rows = {}, {}

    def noted(frame, label, durable=em.durable):
        table = durable(frame, label)
        files[label], rows[label] = [f.removeprefix("file://") for f in table.inputFiles()], table.count()
        return table

    monkeypatch.setattr(em, "durable", noted)
    n = 60
    left, right = crowd(spark, n)
    assert {(r.eid, r.doc) for r in em.match(left, right).collect()} == {(f"r{i}", i) for i in range(n)}
    assert rows["match-features"] == n * n and rows["references-sent"] == n
    for label in ("reference-sides", "document-sides", "document-keys", "candidates", "references-sent", "match-features"):
        assert files[label] and not any(Path(f).exists() for f in files[label]), label


def test_crowded_homes_and_blocks_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(em, "CROWD", 5)
    monkeypatch.setattr(em, "_HEAVY", 100)
    n = 40
    left, right = crowd(spark, n)
    a, b = em._classes(left, "left")[1], em._classes(right, "right")[1]
    homes = em._housed(b).groupBy("by_first").count().collect()
    assert len(homes) > 4 and sum(h["count"] for h in homes) == n
    monkeypatch.setattr(em, "_features", lambda pairs: pairs)
    met = em._met(em._whole_blocks(a, b, em.common_words(b)), a, b).collect()
    titles = [{r.cls: r.title for r in side.collect()} for side in (a, b)]
    assert len(met) == n * n == len({(r.rid, r.did) for r in met})
    assert all(r.r.title == titles[0][r.rid] and r.d.title == titles[1][r.did] for r in met)
