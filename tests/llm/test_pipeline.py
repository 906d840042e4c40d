"""The corpus pipeline against its stages done by hand, and its shape."""

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from searchmill.llm import packing, quality, tokens, toxicity

SF = "/root/testdata/sf0.01"


def shingle_set(text, k=3):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def test_stages():
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "minhash_dedup", "packing"]
    assert entry.queries()["pipeline"] is P.run
    assert sorted(n for n in entry.queries() if n.startswith("op")) == sorted(f"op{i}_{s}" for i, s in enumerate(("language_id", "quality", "fingerprints", "embedding_dedup", "minhash_dedup", "token_counts", "packing", "html_extraction", "sentencepiece", "toxicity"), 1))


def test_whole_pipeline_by_hand(spark):
    """Scores by the models' plain functions, near copies by all pairs, tokens by the tokenizer itself."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, labels)
    ids = [i for i, t in rows.items() if t and t.strip()]
    x, _ = quality.features(pa.array([rows[i] for i in ids]))
    score = dict(zip(ids, np.round(((x - model[0]) / model[1]) @ model[2], 6)))
    at = quality.threshold(spark.createDataFrame([(i, float(s)) for i, s in score.items()], "doc_id long, score double"), labels)[0]
    kept = [i for i in ids if score[i] >= at]
    m = toxicity.train(docs.where(F.col("doc_id").isin(kept)), labels)
    kept = [i for i in kept if toxicity.score_texts(m, pa.array([rows[i]], pa.large_string()))[0][0] <= 0]
    sets = {i: shingle_set(rows[i]) for i in kept}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(a, b) for members in where.values() for a in members for b in members if a < b}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    want = {find(i) for i in kept}
    got = P.run(spark, SF).collect()
    have = {r.doc_id for r in got}
    assert want <= have and len(have - want) <= 0.02 * len(want)  # banding may miss a pair, and never joins one too many
    encode = tokens.encoding(tokens.vocabulary()).encode_ordinary
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: len(encode(rows[i])) for i in have}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.n_tokens)
    assert all(sum(b) <= packing.CONTEXT and len(b) <= packing.DOCS for b in bins.values())


def odd_folder(spark, tmp_path, rows):
    d = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("score", "scored", "key", "n", "lead", "keep")})
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_cases(spark, tmp_path):
    rows = [(1, "some words here", None, None, None), (1, "some words here", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, "nameless words in a row", "en", "s", 0), (4, "long text " * 30_000, "en", "s", 0)]
    d = odd_folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns
    got = P.run(spark, d).collect()
    assert {r.doc_id for r in got} == {1, None, 4} and sum(r.doc_id == 1 for r in got) == 1


def test_no_documents(spark, tmp_path):
    assert P.run(spark, odd_folder(spark, tmp_path, [])).count() == 0


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        P.run(Session(), SF)
