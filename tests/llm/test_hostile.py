"""Texts made to collide, pages made to hang, ids of other types, training rows that repeat."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchmill.llm import fingerprints, hnsw, html_extract, lang_id, minhash, packing, quality, sentencepieces, token_counts, tokens, toxicity
from searchmill.llm import sentencepieces as SP
from searchmill.llm import textbytes as B
from searchmill.llm.shared import probably, sampled_texts


def thue_morse(bits: int, a: str = "a", b: str = "b") -> str:
    word = a
    for _ in range(bits):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


@pytest.fixture(scope="module")
def twins(spark):
    """Different words that any polynomial modulo 2^64 hashes alike, and different texts of them."""
    one = thue_morse(11)
    two = one.translate(str.maketrans("ab", "ba"))
    return spark.createDataFrame([(1, one), (2, two), (3, one + " x"), (4, two + " x")], "doc_id long, text string").cache()


def test_words_made_to_collide(spark, twins):
    texts = {r.doc_id: r.text for r in twins.collect()}
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(twins).collect()}
    assert prints[1] != prints[2] and prints[3] != prints[4]
    assert {r.doc_id for r in minhash.dedup(twins).collect()} == {1, 2, 3, 4}
    assert all(r.keep for r in minhash.near_copies(twins).collect())
    encode = tokens.encoding(tokens.vocabulary()).encode_ordinary
    got = {r.n_tokens: r.docs for r in token_counts.context_table(twins).collect()}
    want = [len(encode(t)) for t in texts.values()]
    assert got == {n: want.count(n) for n in want}
    back = sentencepieces.encode(twins).withColumn("back", SP.decode(F.col("pieces"))).collect()
    assert all(r.lossless and r.back == texts[r.doc_id] for r in back)


def test_names_tell_spans_apart():
    spans = [b"a", b"a\0", b"aa", b"x" * 8, b"x" * 9, b"x" * 15, b"x" * 16, b"x" * 17, b"x" * 14 + b"\0", b"\0", b"\0\0"]
    data = np.frombuffer(b"".join(spans), np.uint8)
    size = np.array([len(s) for s in spans])
    low, high = B.span_names(data, np.cumsum(size) - size, size)
    assert len(set(zip(low.tolist(), high.tolist()))) == len(spans)
    first, back = B.different(np.concatenate([low, low]), np.concatenate([high, high]))
    assert len(first) == len(spans) and (back[: len(spans)] == back[len(spans) :]).all()


def test_names_are_compared_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(B, "fold", lambda low, high: np.zeros(len(low), np.uint64))
    first, back = B.different(np.array([5, 5, 7], np.uint64), np.array([1, 2, 1], np.uint64))
    assert len(first) == 3 and sorted(back.tolist()) == [0, 1, 2]


def test_pieces_don_t_depend_on_the_batch():
    table, ranks = SP.vocabulary()
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcdefghinorst"), rng.integers(2, 14))) for _ in range(30)) for _ in range(300)]
    keys = SP.mix(np.arange(300, dtype=np.uint64))
    lattice = SP.Lattice(table, ranks, SP.ALPHA)
    out, at, _ = SP.encode_slice(lattice, keys, pa.array(texts), 1)
    for i in range(0, 300, 7):
        alone = SP.Lattice.of(table, ranks, SP.ALPHA)
        alone._clear()
        mine, _, whole = SP.encode_slice(alone, keys[i : i + 1], pa.array(texts[i : i + 1]), 1)
        assert whole.all() and mine.tolist() == out[at[i] : at[i + 1]].tolist()


def test_pieces_when_the_pool_starts_anew(monkeypatch):
    table, ranks = SP.vocabulary()
    texts = [f"considerable understanding number {i} of {i * 7919} relations" for i in range(200)]
    keys = SP.mix(np.arange(200, dtype=np.uint64))
    want = SP.encode_slice(SP.Lattice(table, ranks, SP.ALPHA), keys, pa.array(texts), 1)[0].tolist()
    monkeypatch.setattr(SP, "POOL", 100)
    lattice, got = SP.Lattice(table, ranks, SP.ALPHA), []
    for lo in range(0, 200, 10):
        got += SP.encode_slice(lattice, keys[lo : lo + 10], pa.array(texts[lo : lo + 10]), 1)[0].tolist()
    assert got == want


def test_hostile_pages(spark):
    pages = ["<a " * 350_000, '<a ">" ' * 50_000 + "'", "<div>" * 20_000 + "</x>" * 20_000, "<b>x" * 20_000, "<p><table>" + "<b>" * 10_000 + "<ul>" * 10_000, "<article>x</article>" * 20_000, "<script " * 50_000, "<!-- " * 50_000]
    began = time.perf_counter()
    rows = html_extract.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert len(rows) == len(pages) and time.perf_counter() - began < 90


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "some words here"), ("a", "other words"), (None, "x y z"), ("a", "other words")], "doc_id string, text string")
    with pytest.raises(TypeError, match="vec_id must be an integer"):
        hnsw.near_groups(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))
    assert sorted(str(r.doc_id) for r in packing.packed(docs).collect()) == ["None", "a", "a", "b"]
    pieces = sentencepieces.encode(docs)
    assert pieces.schema["doc_id"].dataType.simpleString() == "string" and pieces.count() == 4
    assert {r.doc_id for r in minhash.dedup(docs).collect()} == {"a", "b", None}
    big = spark.createDataFrame([(2**62 + 1, "one two"), (None, "one two three")], "doc_id long, text string")
    assert {r.doc_id for r in packing.packed(big).collect()} == {2**62 + 1, None}


def test_copies_of_a_row_are_spread_when_packed(spark):
    docs = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("the same text in every row").alias("text"))
    rows = packing.packed(docs, shard_docs=500).collect()
    shards = {r.bin_id.split("-")[0] for r in rows}
    assert len(rows) == 4000 and len(shards) == 8


def test_training_rows_that_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i % 6} with words") for i in range(600)] + [(9, "long " * 50_000)], "doc_id long, text string")
    sample = spark.createDataFrame([(0, 1), (1, 0), (9, 1)], "doc_id long, label int")
    got = [tuple(r) for r in sampled_texts(docs, sample).orderBy("doc_id").collect()]
    assert got == [(0, 1, "text 0 with words"), (1, 0, "text 1 with words")]
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0)] * 50, "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == toxicity.classify(docs, labels).count() == 601
    pages = spark.createDataFrame([(i % 2, f"<article>{i % 4} words</article><nav>menu</nav>") for i in range(400)], "page_id long, html string")
    assert html_extract.extract(pages).count() == 400
    assert set(lang_id.train(docs.withColumn("lang", F.lit("en")), 2)) == {"en"}


def test_dictionaries_hold_every_training_text():
    texts = ["é" * 5000 + "A", "short B", "日本" * 9000 + "C", "x" * 100_000]
    got = lang_id.shared_out([t.encode() for t in texts], 4096)
    assert 4000 < len(got) <= 4096 and b"short B" in got
    parts = got.decode().split("\n")
    assert len(parts) == 5 and all(len(p.encode()) >= 1300 for p in (parts[0], parts[2], parts[3]))
    assert lang_id.shared_out([b"one", b"two"], 4096) == b"one\ntwo\n"


def test_marks_of_ids(spark):
    ids = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id")).unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    for most in (1 << 20, 64):
        rows = probably(ids, most=most)(docs, F.col("doc_id")).collect()
        assert len(rows) == 3001 and all(r.doc_id_in for r in rows if r.doc_id is not None and r.doc_id % 3 == 0)
        chance = sum(r.doc_id_in for r in rows if r.doc_id is not None and r.doc_id % 3)
        assert chance < 400 if most > 64 else True


def test_a_given_quantile_decides(spark):
    docs = spark.createDataFrame([(i, "Plain words in a row. " * 5 + "| ~ # " * i) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    for q in (0.0, 0.25, 0.5, 1.0):
        kept = sum(r.keep for r in quality.classify(docs, labels, quantile=q).collect())
        assert abs(kept - 40 * (1 - q)) <= 1
