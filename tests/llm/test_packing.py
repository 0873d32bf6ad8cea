import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(2, 12))
def test_nothing_overflows(sizes, classes):
    sizes = np.array(sizes, dtype=np.int64)
    where = packing.pack_sizes(sizes, 64, classes)
    used = np.unique(where)
    assert len(where) == len(sizes) and (used == np.arange(len(used))).all()
    if len(sizes):
        filled = np.bincount(where, weights=sizes)
        assert filled.max() <= 64
        # no two containers could be one, except the last of each class and the one after it
        assert (filled < 32).sum() <= classes


def test_class_counts():
    # two of class one take the twenties that fit, two of class two share a container, the last is left alone
    sizes = np.array([40, 40, 30, 30, 30, 20, 20, 20])
    where = packing.pack_sizes(sizes, 64, 4)
    assert sorted(np.bincount(where, weights=sizes).tolist()) == [50, 60, 60, 60]
    assert where[0] != where[1] and where[2] == where[3]


def test_fullness():
    rng = np.random.default_rng(1)
    for sizes in (np.clip(rng.lognormal(4.5, 1.2, 20_000).astype(np.int64), 1, 1_024), rng.integers(1, 200, 20_000), rng.integers(1, 1_025, 20_000)):
        where = packing.pack_sizes(sizes, 1_024)
        least = -(-sizes.sum() // 1_024)
        # long texts can't share a container: no packing needs fewer than these
        least = max(least, int((sizes > 512).sum()))
        assert where.max() + 1 <= 1.02 * least + packing.CLASSES


def test_pack(spark):
    rows = [(1, 10), (2, 0), (3, None), (4, 25), (5, 5), (5, 5), (6, 40), (None, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, tokens long").withColumnsRenamed({}).where("doc_id is not null")
    found = packing.pack(frame.coalesce(1), "doc_id", "tokens", 10, classes=3).collect()
    sizes = {}
    for r in found:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r["size"]
    assert sizes == {1: 10, 4: 25, 5: 10, 6: 40}
    full = {}
    for r in found:
        full[r.container] = full.get(r.container, 0) + r["size"]
    assert max(full.values()) <= 10 and sum(full.values()) == 85
    assert len({r.container for r in found if r.doc_id == 1}) == 1
    assert packing.pack(frame.where("false"), "doc_id", "tokens", 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame, "doc_id", "tokens", 0)


def test_texts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows = [(1, "some words here"), (2, ""), (3, None), (4, "word " * 3_000), (None, "lost")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, size int")
    found = packing.pack_texts(frame, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1_000).collect()
    assert {r.doc_id for r in found} == {1, 4} and sum(r["size"] for r in found if r.doc_id == 4) == 3_001
