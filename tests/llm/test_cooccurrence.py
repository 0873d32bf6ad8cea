from itertools import combinations

import pytest

from folioscope.llm import cooccurrence


def brute(rows, together, lift):
    baskets = {}
    for g, b, i in rows:
        if g is not None and b is not None and i is not None:
            baskets.setdefault((g, b), set()).add(i)
    single, pair, number = {}, {}, {}
    for (g, _), items in baskets.items():
        number[g] = number.get(g, 0) + 1
        for i in items:
            single[g, i] = single.get((g, i), 0) + 1
        for p in combinations(sorted(items), 2):
            pair[g, *p] = pair.get((g, *p), 0) + 1
    return {(g, a, b, n) for (g, a, b), n in pair.items() if n >= together and n * number[g] >= lift * single[g, a] * single[g, b]}


def sample():
    rows = [("k", f"d{d}", f"i{(d * k) % (7 + k)}") for d in range(60) for k in range(1, 9)]
    rows += [("k", "hot", f"i{k}") for k in range(40)] + [("k", "hot2", f"i{k}") for k in range(30)]
    rows += [("a", f"d{d}", f"x{d % 3}") for d in range(40)] + [("a", f"d{d}", "y") for d in range(40)]
    return rows + rows[:50] + [("k", None, "i1"), ("k", "d1", None), (None, "d1", "i1")]


@pytest.mark.parametrize(("wide", "heavy", "tile"), [(512, 1024, 1024), (3, 1024, 4), (5, 8, 6), (512, 4, 1024)])
def test_matches_brute_force(spark, monkeypatch, wide, heavy, tile):
    monkeypatch.setattr(cooccurrence, "WIDE", wide)
    monkeypatch.setattr(cooccurrence, "HEAVY", heavy)
    monkeypatch.setattr(cooccurrence, "TILE", tile)
    rows = sample()
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "g string, b string, item string, together string")
    found = cooccurrence.count_pairs(frame, "g", "b", "item", min_together=3, min_lift=0.9)
    assert {(r.g, r.item_a, r.item_b, r.together) for r in found.collect()} == brute(rows, 3, 0.9)


def test_empty(spark):
    frame = spark.createDataFrame([], "g string, b string, item string")
    assert cooccurrence.count_pairs(frame, "g", "b", "item").collect() == []
