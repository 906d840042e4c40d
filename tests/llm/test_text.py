"""Text primitives and components against plain Python."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from searchmill.llm import textbytes as B
from searchmill.llm.graph import components

TEXT = st.text(alphabet="ab é\t\n.x|本", max_size=60)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words(texts):
    column = pa.array(texts, pa.string())
    hashes, owner = B.word_hashes(column)
    plain = [w for t in texts for w in (t or "").lower().encode().split()]
    assert len(hashes) == len(plain)
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in (t or "").encode().split()]
    seen = {}
    for h, w in zip(hashes.tolist(), plain):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(deadline=None, max_examples=60)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 4))
def test_shingles(texts, k):
    column = pa.array(texts)
    found, owner = B.shingles(column, k)
    want = []
    for i, t in enumerate(texts):
        w = t.lower().encode().split()
        want += [(i, tuple(w[j : j + k])) for j in range(max(0, len(w) - k + 1))] or ([(i, tuple(w))] if w else [])
    assert owner.tolist() == [i for i, _ in want]
    seen = {}
    for h, (_, s) in zip(found.tolist(), want):
        assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_keep_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(B.slices(batch, "text", 20))
    assert pa.concat_arrays([p.column(0) for p in parts]).to_pylist() == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 2] or max(p.num_rows for p in parts) <= 3


def test_sliced_arrow_columns():
    column = pa.array(["x y", "one two", None, "three"]).slice(1, 3)
    data, offsets = B.text_bytes(column)
    assert bytes(data) == b"one twothree" and offsets.tolist() == [0, 7, 7, 12]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 650)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix_is_stable():
    assert B.mix_int(0) == int(B.mix(np.zeros(1, np.uint64))[0])
