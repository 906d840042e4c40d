"""MinHash near-dedup, fingerprints and embedding groups against all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchmill.llm import fingerprints as FP
from searchmill.llm import directions, hnsw, minhash, queries
from searchmill.llm.textbytes import shingles


def shingle_set(text, k=3):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_groups(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_whole_table_against_all_pairs(spark, sf_dir):
    rows = {r.doc_id: shingle_set(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    near = [(a, b) for a, b in itertools.combinations(sorted(rows), 2) if jaccard(rows[a], rows[b]) >= 0.5]
    want = brute_groups(rows, near)
    got = {r.doc_id: r.group_id for r in queries.op5_minhash_dedup(spark, sf_dir).collect()}
    together = [(a, b) for a, b in near if got[a] == got[b]]
    assert len(together) >= 0.9 * len(near)
    assert all(want[a] == want[g] for a, g in got.items())  # nothing that isn't near is joined
    assert sum(got[i] == want[i] for i in rows) >= 0.98 * len(rows)


def variants(n, seed=0):
    """Families of a base text with a share of words changed, and their similarity to the base."""
    rng = random.Random(seed)
    out = []
    for f in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        out.append((f * 10, " ".join(base)))
        for v, changes in enumerate((0, 2, 6, 60), 1):
            w = list(base)
            for i in rng.sample(range(120), changes):
                w[i] = f"z{rng.randrange(10**6)}"
            out.append((f * 10 + v, " ".join(w)))
    return out


def test_planted_copies(spark):
    rows = variants(25)
    sets = {i: shingle_set(t) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.5]
    got = {r.doc_id: r.group_id for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    want = brute_groups(sets, near)
    assert all(want[a] == want[g] for a, g in got.items())
    kept = minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def test_a_band_of_several_groups_is_split(spark):
    # texts that share three quarters pairwise with a middle one, not with each other
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 60 : i * 60 + 200])) for i in range(4)]
    sets = {i: shingle_set(t) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.5]
    got = {r.doc_id: r.group_id for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(sets, near)


def test_circulant_signature_by_definition():
    found, _ = shingles(pa.array(["a b c d e f g h i j"]), 3)
    size = 1 << 10
    sigma, pi = minhash.permutations(5, size, 16)
    got = minhash.circulant_signature(found, 16, 5, size)
    for k in range(16):
        assert got[k] == min(int(pi[(int(sigma[int(h) % size]) + k) % size]) for h in found)


def test_circulant_agreement_estimates_jaccard():
    rng = random.Random(4)
    diffs = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = base[:200] + [f"v{rng.randrange(10**6)}" for _ in range(100)]
        a, b = (minhash.circulant_signature(shingles(pa.array([" ".join(t)]), 3)[0], 160) for t in (base, other))
        diffs.append((a == b).mean() - jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(other))))
    assert abs(np.mean(diffs)) < 0.03


def test_dedup_cases(spark):
    rows = [(2, "a b c d"), (1, "A  b c d"), (1, "A  b c d"), (None, "a b c d"), (3, None), (4, ""), (5, " \n"), (6, None), (7, "q w e r " * 40_000), (8, "q w e r " * 40_000), (9, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "n", "lead", "s", "root", "band")})
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 9]
    groups = minhash.near_copies(docs).collect()
    assert len(groups) == len(rows)
    assert {(r.doc_id, r.group_id, r.keep) for r in groups} == {(2, 1, False), (1, 1, True), (None, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 7, False), (9, 9, True)}
    assert minhash.dedup(docs.limit(0)).count() == 0 and minhash.near_copies(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, "other words here")], "doc_id long, text string")
    assert minhash.dedup(nameless).count() == 2


# fingerprints


def test_fingerprints_by_definition():
    texts = ["a b c d e f g", "a b c", "", None, " ".join(f"w{i}" for i in range(3000))]
    found, owner = shingles(pa.array(texts), 3)
    least, full = FP.bin_minima(found, owner, 5, 64)
    for i in range(5):
        mine = [int(h) for h in found[owner == i]]
        for b in range(64):
            here = [h & ((1 << 58) - 1) for h in mine if h >> 58 == b]
            assert full[i, b] == bool(here)
            if here:
                assert int(least[i, b]) == min(here)
    dense = FP.densify(least, full)
    assert (dense[full] == least[full]).all()
    for i in (0, 1, 4):  # each borrowed value is one of the text's own
        assert set(dense[i].tolist()) <= set(least[i][full[i]].tolist())


def test_similarity_is_unbiased(spark):
    rng = random.Random(2)
    rows, true = [], {}
    for i in range(60):
        share = rng.choice([0, 0.3, 0.6, 0.9])
        base = [f"w{rng.randrange(10**6)}" for _ in range(500)]
        cut = int(500 * share)
        other = base[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(500 - cut)]
        rows.append((i, " ".join(base), " ".join(other)))
        true[i] = jaccard(shingle_set(rows[-1][1]), shingle_set(rows[-1][2]))
    f = FP.fingerprint_udf()
    got = spark.createDataFrame(rows, "i long, a string, b string").select("i", FP.similarity(f(F.col("a"))["fingerprint"], f(F.col("b"))["fingerprint"]).alias("s")).collect()
    errors = [r.s - true[r.i] for r in got]
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def test_fingerprint_cases(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, " "), (None, "a b c"), (4, "A b  c"), (4, "A b  c"), (5, "w " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fingerprint", "s", "shingles")})
    got = FP.fingerprints(docs).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint is by[2].fingerprint is by[3].fingerprint is None and by[1].shingles == 0
    assert by[None].fingerprint == by[4].fingerprint and len(by[5].fingerprint) == FP.BINS * FP.BITS // 8
    assert FP.fingerprints(docs.limit(0)).count() == 0
    assert queries.op3_fingerprints(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


# embeddings


def brute_embeddings(rows, threshold):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    near = [(ids[i], ids[j]) for i, j in zip(a, b)]
    return near, brute_groups(ids, near)


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_embedding_groups(spark, sf_dir, shard_rows):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    near, want = brute_embeddings({r.vec_id: r.embedding for r in e.collect()}, hnsw.THRESHOLD)
    got = {r.vec_id: r.group_id for r in hnsw.near_groups(e, shard_rows=shard_rows).collect()}
    assert set(got) == set(want)
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    assert all(want[i] == want[g] for i, g in got.items())


def test_large_groups_widen_the_beam():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 32))
    x = np.concatenate([c + 0.05 * rng.normal(size=(200, 32)) for c in centers] + [rng.normal(size=(400, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    got = {p for a, b, _ in g.near(x.astype(np.float32), 0.9, beam=16) for p in zip(a.tolist(), b.tolist())}
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.9 + 1e-4))))
    assert len(got & want) >= 0.95 * len(want)


def crowded(rng, n, dim=128, spread=0.27, noise=0.29, copies=300):
    """Vectors around one direction, nearly as near to each other as near copies are, and near copies of the first of them."""
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(unit(rng.normal(size=(1, dim))) + spread * rng.normal(size=(n, dim)) / np.sqrt(dim))
    return x, unit(x[:copies] + noise * rng.normal(size=(copies, dim)) / np.sqrt(dim))


def test_beam_is_settled_without_pairs_to_audit():
    """Of a task's queries only some that its sample leaves out have near copies in the graph; they are found all the same."""
    rng = np.random.default_rng(4)
    x, copies = crowded(rng, 3000)
    g = hnsw.Graph(x)
    q = rng.normal(size=(1000, 128))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    audit = np.argsort(hnsw.mix(np.arange(len(q), dtype=np.uint64)), kind="stable")[: -(-len(q) // hnsw.AUDIT_SHARE)]
    q[np.setdiff1d(np.arange(len(q)), audit)[: len(copies)]] = copies
    got = {p for a, b, _ in g.near(q.astype(np.float32), hnsw.THRESHOLD, g.settled(hnsw.THRESHOLD)) for p in zip(a.tolist(), b.tolist())}
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(q @ x.T >= hnsw.THRESHOLD))))
    assert len(want) > 200 and not (q[audit] @ x.T >= hnsw.THRESHOLD).any()
    assert len(got & want) >= 0.95 * len(want)


def test_near_copies_between_shards(spark):
    """Near copies planted over eight shards, pairs in a crowd and one group of two thousand, against all pairs."""
    rng = np.random.default_rng(6)
    x, copies = crowded(rng, 3000, spread=0.3, noise=0.28)
    group = rng.normal(size=(1, 128)) + 0.1 * rng.normal(size=(2000, 128))
    rows = np.concatenate([x, copies, group])
    ids = rng.permutation(len(rows)).tolist()
    near, want = brute_embeddings(dict(zip(ids, rows.tolist())), hnsw.THRESHOLD)
    e = spark.createDataFrame(list(zip(ids, rows.tolist())), "vec_id long, embedding array<double>")
    shards = -(-len(rows) // 700)
    shard = {r.vec_id: r.s for r in e.select("vec_id", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards)).alias("s")).collect()}
    got = {r.vec_id: r.group_id for r in hnsw.near_groups(e, shard_rows=700).collect()}
    grouped = set(ids[-2000:])
    pairs = [p for p in near if not grouped & set(p) and shard[p[0]] != shard[p[1]]]
    large = [p for p in near if grouped >= set(p) and shard[p[0]] != shard[p[1]]]
    assert shards == 8 and len(pairs) > 200 and len(large) > 1_000_000
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert sum(got[a] == got[b] for a, b in large) >= 0.95 * len(large)
    assert all(want[i] == want[g] for i, g in got.items())  # nothing that isn't near is joined



def test_embedding_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (11, [float("inf"), 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("rep", "fine", "shard", "dim", "group_id")})
    got = sorted(((r.vec_id, r.group_id) for r in hnsw.near_groups(v).collect()), key=str)
    want = [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (10, 10), (11, 11), (None, None)]
    assert got == sorted(want, key=str)
    assert hnsw.near_groups(v.limit(0)).count() == 0


def test_recall_over_twenty_thousand_vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    x[18_000:] = x[:2000] + 0.25 * np.linalg.norm(x[:2000], axis=1, keepdims=True) * rng.normal(size=(2000, 64)) / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    beam = g.settled(hnsw.THRESHOLD)
    q = x[16_000:].astype(np.float32)
    got = {p for lo in range(0, len(q), hnsw.BLOCK) for a, b, _ in g.near(q[lo : lo + hnsw.BLOCK], hnsw.THRESHOLD, beam) for p in zip((a + lo).tolist(), b.tolist())}
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(q @ g.x.T >= hnsw.THRESHOLD))))
    assert len(want) >= 6000 and len(got & want) >= 0.97 * len(want)


def unit_rows(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_work_for_a_row_hardly_grows():
    """Sixteen times the rows take at most 48 times the comparisons (numbers of cells are powers of two); by all pairs 256 times."""
    x = unit_rows(np.random.default_rng(9).normal(size=(320_000, 64))).astype(np.float32)
    compared = []
    for n in (20_000, 320_000):
        cells = directions.routes(64, n, hnsw.THRESHOLD, 1024, mean=512).of(x[:n])
        compared.append(int((np.bincount(cells.ravel()).astype(np.int64) ** 2).sum()))
    assert compared[0] < 0.5 * 20_000**2 and compared[1] < 48 * compared[0]
    for n in (10**5, 10**6, 10**7, 5 * 10**7):
        route = directions.routes(64, n, hnsw.THRESHOLD, directions.READ_ROWS)
        assert n * route.posts / route.cells < hnsw.SHARD_ROWS and route.posts <= 6


@pytest.mark.parametrize("dim", [3, 24, 64, 300])
def test_pairs_at_the_threshold_meet(dim):
    """In a crowd around one direction too: what pairs meet doesn't depend on where the data lie."""
    rng = np.random.default_rng(dim)
    x = unit_rows(rng.normal(size=(1, dim)) + 0.3 * rng.normal(size=(3000, dim)) / np.sqrt(dim))
    aside = rng.normal(size=x.shape)
    aside = unit_rows(aside - (aside * x).sum(1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * aside
    for n in (50_000, 2_000_000):
        route = directions.routes(dim, n, hnsw.THRESHOLD, directions.READ_ROWS)
        met = (route.of(x.astype(np.float32))[:, :, None] == route.of(y.astype(np.float32))[:, None]).any((1, 2))
        assert route.cells > 1 and met.mean() >= 0.95


def test_shards_by_direction_against_all_pairs(spark):
    rng = np.random.default_rng(12)
    x = unit_rows(rng.normal(size=(10_000, 64)))
    copies = unit_rows(x[:1500] + rng.uniform(0.1, 0.33, size=(1500, 1)) * rng.normal(size=(1500, 64)) / 8)
    group = rng.normal(size=(1, 64)) + 0.15 * rng.normal(size=(600, 64))
    rows = np.concatenate([x, copies, group, group[:1].repeat(900, 0)]).astype(np.float32)
    ids = rng.permutation(len(rows)).tolist()
    near, want = brute_embeddings(dict(zip(ids, rows.tolist())), hnsw.THRESHOLD)
    e = spark.createDataFrame(list(zip(ids, rows.tolist())), "vec_id long, embedding array<float>")
    planted = set(ids[:11_500])
    pairs = [p for p in near if planted >= set(p)]
    assert len(pairs) > 1200
    for shard_rows in (hnsw.SHARD_ROWS, 2000):  # with 2,000 the repeated vectors crowd their shards
        got = {r.vec_id: r.group_id for r in hnsw.near_groups(e, shard_rows=shard_rows).collect()}
        assert set(got) == set(want)
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
        assert len({got[i] for i in ids[11_500:]}) == 1
        assert all(want[i] == want[g] for i, g in got.items())  # nothing that isn't near is joined


def test_pairs_that_codes_leave_open(spark):
    """Cosines closer to the threshold than 16-bit numbers tell."""
    rng = np.random.default_rng(13)
    x = unit_rows(rng.normal(size=(300, 64)))
    aside = rng.normal(size=x.shape)
    aside = unit_rows(aside - (aside * x).sum(1, keepdims=True) * x)
    cosine = hnsw.THRESHOLD + np.linspace(-1e-4, 1e-4, 300)[:, None]
    rows = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * aside]).astype(np.float32)
    code, off = directions.unpacked(directions.packed(rows.astype(float)))
    assert np.abs(code @ code.T - unit_rows(rows.astype(float)) @ unit_rows(rows.astype(float)).T).max() <= off
    a, b, sure = directions.shard_pairs(np.arange(600), directions.packed(rows.astype(float)), hnsw.THRESHOLD, hnsw.SLACK, 0)
    assert (~sure).sum() > 200
    near, want = brute_embeddings(dict(enumerate(rows.tolist())), hnsw.THRESHOLD)
    e = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<float>")
    assert 100 < len(near) < 200
    assert {r.vec_id: r.group_id for r in hnsw.near_groups(e).collect()} == want
