import random
from itertools import combinations

import pytest

from folioscope.llm import set_similarity as ss


def brute(sets, threshold, least):
    kept = {k: v for k, v in sets.items() if len(v) >= least}
    return {tuple(sorted((a, b))) for a, b in combinations(kept, 2) if len(kept[a] & kept[b]) >= threshold * len(kept[a] | kept[b]) - 1e-9}


def sample(n=160, seed=1):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        base = rng.sample(range(300), rng.randint(5, 14)) + ([999] if i % 3 == 0 else [])
        sets[f"r{i}"] = set(base)
        if i % 4 == 0:
            sets[f"c{i}"] = set(base)
        if i % 5 == 0:
            sets[f"n{i}"] = set(base[1:]) | {1000 + i}
    return sets


@pytest.mark.parametrize(("small", "depth", "largest"), [(48, 6, 20_000), (4, 3, 20_000), (2, 1, 20_000), (48, 6, 9)])
def test_all_pairs(spark, small, depth, largest):
    sets = sample()
    rows = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "rec string, value long")
    members, pairs = ss.similar_classes(rows, small=small, depth=depth, largest=largest)
    found = {(r.rec_a, r.rec_b) for r in ss.expand(members, pairs).collect()}
    assert found == brute(sets, 0.6, 5)


def test_many_sets_around_one_core(spark):
    sets = {f"a{i}": {1, 2, 3, 4, 1000 + i} for i in range(150)} | {f"b{i}": {11, 12, 13, 14, 15, 2000 + i} for i in range(150)}
    sets |= {f"c{i}": {11, 12, 13, 14, 15, 16, 17 + i % 2} | {3000 + i // 2} for i in range(60)}
    rows = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "rec string, value long")
    found = {(r.rec_a, r.rec_b) for r in ss.expand(*ss.similar_classes(rows)).collect()}
    assert found == brute(sets, 0.6, 5)


def test_pairs_deep_in_the_trees(spark):
    sets = {f"s{i}": set(c) for i, c in enumerate([*combinations(range(10), 8), *combinations(range(10), 5)])}
    rows = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "rec string, value long")
    found = {(r.rec_a, r.rec_b) for r in ss.expand(*ss.similar_classes(rows, small=8)).collect()}
    expected = brute(sets, 0.6, 5)
    assert found <= expected and len(found) >= 0.9999 * len(expected)


def test_values_known_by_two_keys(spark):
    rows = [("a", "d1", "t1"), ("a", "", "t2"), ("b", "d1", None), ("b", None, "t2"), ("c", "d2", "t1"), ("c", None, None), (None, "d1", "t1"), ("d", "d9", ""), ("a", "d1", "t1")]
    frame = spark.createDataFrame(rows, "rec string, doi string, title string")
    found = {}
    for r in ss.same_values(frame, "rec", ["doi", "title"]).collect():
        found.setdefault(r.rec, set()).add(r.value)
    assert found["a"] & found["b"] and len(found["a"]) == 2 and found["a"] == found["b"]
    assert found["c"] < found["a"] and len(found["d"]) == 1 and not found["d"] & found["a"]


def test_empty(spark):
    empty = spark.createDataFrame([], "rec string, doi string, title string")
    values = ss.same_values(empty, "rec", ["doi", "title"])
    members, pairs = ss.similar_classes(values)
    assert members.count() == pairs.count() == ss.expand(members, pairs).count() == 0
