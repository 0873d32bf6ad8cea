import random

import numpy as np

from folioscope.llm import leakage

WORDS = [f"w{i:03d}" for i in range(400)]
PATTERN = "errors in {} grew with the number of {} {} and levelled off near {} units"


def passage(rng, n=6):
    return ". ".join(PATTERN.format(*rng.sample(WORDS, 3), rng.randint(10, 999)) for _ in range(n)) + "."


def corpus():
    rng = random.Random(5)
    items = [(i, ("Read this and answer. " if i % 2 else "") + passage(rng)) for i in range(12)]
    texts = {d: passage(rng, 12) for d in range(150)}
    want = set()

    def put(d, text, *found):
        texts[d] += " " + text + " " + passage(rng, 2)
        want.update((d, i) for i in found)

    body = {i: t.removeprefix("Read this and answer. ") for i, t in items}
    put(0, body[0], 0)
    put(1, body[1].upper().replace(" ", "\n").replace(".", " ;"), 1)
    words = body[2].split()
    put(2, " ".join(words[: len(words) * 6 // 10]), 2)
    put(3, " ".join(words[: len(words) // 3]) + " " + passage(rng, 1) + " " + " ".join(words[len(words) // 3 : len(words) * 3 // 4]), 2)
    edited = [w if k % 9 else "other" for k, w in enumerate(body[3].split()) if k % 13]
    put(4, " ".join(edited), 3)
    put(5, "Read this and answer.")
    put(6, " ".join(words[:14]))
    shuffled = body[4].split()
    rng.shuffle(shuffled)
    put(7, " ".join(shuffled))
    put(8, body[5].replace("e", "е", 5).replace("r", "​r", 3), 5)
    put(9, body[6] + " " + body[7], 6, 7)
    texts[10] = body[8]
    want.add((10, 8))
    return items, texts, want


def test_finds_passages_and_nothing_else(spark):
    items, texts, want = corpus()
    documents = spark.createDataFrame([(d, t, "x") for d, t in texts.items()] + [(900, None, "x"), (901, "", "x"), (902, "one", "x"), (0, texts[0], "x")], "doc_id long, text string, coverage string")
    tests = spark.createDataFrame([*items, (50, None), (51, ""), (52, "single"), (0, items[0][1])], "item_id long, text string")
    found = leakage.find(documents, "doc_id", "text", tests, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)


def test_passes_and_long_text(spark, monkeypatch):
    items, texts, want = corpus()
    monkeypatch.setattr(leakage, "SEGMENT_DOCS", 7)
    texts[20] = " ".join(texts[d] for d in range(20, 150)) * 3 + " " + items[9][1]
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leakage.find(documents, "doc_id", "text", tests, "item_id", "text").collect()}
    assert found == want | {(20, 9)}


def test_one_name_for_both_ids(spark):
    items, texts, want = corpus()
    documents = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = leakage.find(documents, "id", "text", spark.createDataFrame(items, "id long, text string"), "id", "text")
    assert {(r.id, r.item_id) for r in found.collect()} == want


def test_empty(spark):
    documents = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "some text here now")], "item_id long, text string")
    assert leakage.find(documents.where("false"), "doc_id", "text", tests, "item_id", "text").count() == 0
    assert leakage.find(documents, "doc_id", "text", tests.where("false"), "item_id", "text").count() == 0


def test_fewest_rare_words():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(2, 12)
        rare, length = [rng.random() < 0.4 for _ in range(n)], rng.randint(1, n)
        best = min(
            sum(rare[a:b]) + sum(rare[c : c + length - b + a])
            for a in range(n + 1) for b in range(a, min(n, a + length) + 1) for c in range(b, n - length + b - a + 1)
        )
        assert leakage.fewest_inside(np.array(rare), length) == best


def test_without_agreement(spark):
    """No candidate is left out where anchors needn't agree; here that finds the same."""
    items, texts, want = corpus()
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = leakage.find(documents, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", slack=None)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_many_passes_over_one_index(spark, monkeypatch):
    items, texts, want = corpus()
    built = []
    build = leakage.build_index
    monkeypatch.setattr(leakage, "build_index", lambda *a: built.append(1) or build(*a))
    monkeypatch.setattr(leakage, "ITEMS_PER_PASS", 5)
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find(documents, "doc_id", "text", tests, "item_id", "text").collect()} == want and len(built) == 1
    monkeypatch.setattr(leakage, "MOST_TERMS", 200)
    assert {(r.doc_id, r.item_id) for r in leakage.find(documents, "doc_id", "text", tests, "item_id", "text").collect()} == want and len(built) > 2


def test_edge_words_replaced(spark):
    item = " ".join(WORDS[:40])
    cut = ["other", *WORDS[1:19], "else"]
    documents = spark.createDataFrame([(1, " ".join(cut)), (2, " ".join(WORDS[3:17])), *((i, " ".join(WORDS[i : i + 30])) for i in range(60, 120))], "doc_id long, text string")
    found = leakage.find(documents, "doc_id", "text", spark.createDataFrame([(1, item)], "item_id long, text string"), "item_id", "text")
    assert [r.doc_id for r in found.collect()] == [1]
