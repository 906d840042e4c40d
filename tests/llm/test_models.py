"""Trained operators: definitions by brute force, held-out accuracy, and cases."""

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchmill.llm import html_extract as H
from searchmill.llm import lang_id, quality, queries, toxicity

SF = "/root/testdata/sf0.01"  # enough labelled rows to learn from
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a plain sentence of some words here."), (4, "twice the same row"), (4, "twice the same row"), (5, "long words " * 60_000), (6, "\x00|~`^ !!! ??? ###"), (7, "x" * 50_000)]
CLASH = ("score", "scored", "keep", "s", "has", "label", "toxic", "quality", "lang_", "margin", "bytes", "x", "n", "bin", "q")


@pytest.fixture(scope="module")
def tables(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return d.cache(), lab.where(half == 0).cache(), lab.where(half == 1).cache()


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})


def odd_labels(spark, name):
    return spark.createDataFrame([(None, 1), (4, None), (1, 1), (4, 0), (4, 1), (99, 0), (5, 7)], f"doc_id long, {name} int")


# language


def test_languages_held_out(spark, tables):
    docs = tables[0]
    seen = docs.where(F.pmod("doc_id", F.lit(2)) == 0)
    f = lang_id.classify_udf(lang_id.train(seen))
    got = docs.where(F.pmod("doc_id", F.lit(2)) == 1).select("lang", f(F.col("text")).alias("s")).select("lang", F.col("s.lang").alias("said")).collect()
    told = [r for r in got if r.said is not None]
    assert len(told) > 0.75 * len(got)
    assert sum(r.said == r.lang for r in told) > 0.97 * len(told)


def test_languages_by_definition(spark, tables):
    import zstandard as z

    docs = tables[0].limit(60).collect()
    dictionaries = lang_id.train(tables[0])
    assert lang_id.train(tables[0]) == dictionaries
    f = lang_id.classify_udf(dictionaries)
    got = {r.doc_id: r.s for r in spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id long, text string").select("doc_id", f(F.col("text")).alias("s")).collect()}
    for r in docs:
        if not (r.text or "").strip():
            continue
        data, sizes = r.text.encode(), {}
        for name, d in dictionaries.items():
            zd = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)
            zd.precompute_compress(level=lang_id.LEVEL)
            c = z.ZstdCompressor(level=lang_id.LEVEL, dict_data=zd, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(data[i : i + lang_id.BLOCK])) for i in range(0, len(data), lang_id.BLOCK))
        best, second = sorted(sizes.values())[:2]
        assert got[r.doc_id].bytes == best
        assert got[r.doc_id].margin == pytest.approx((second - best) / len(data), abs=1e-5)
        assert (got[r.doc_id].lang is None) == (got[r.doc_id].margin < lang_id.MARGIN)


def test_language_cases(spark):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") == 4, "en").when(F.col("doc_id") == 5, "xx"))
    got = lang_id.identify(docs).collect()
    assert len(got) == len(ODD)
    assert all(r.lang is None and r.bytes is None for r in got if r.doc_id in (1, 2, 3))
    assert lang_id.identify(docs.limit(0)).count() == 0
    none = lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(ODD) and all(r.lang is None for r in none)
    one = {r.doc_id: r for r in lang_id.identify(docs.withColumn("lang", F.lit("en"))).collect()}
    assert one[7].lang == "en" and one[7].margin == 1.0 and one[2].lang is None


def test_a_tie_is_rejected(spark):
    f = lang_id.classify_udf({"a": b"some words in common", "b": b"some words in common"})
    assert spark.createDataFrame([("some words",)], "t string").select(f(F.col("t")).alias("s")).first().s.lang is None


# quality


def test_quality_held_out(tables):
    docs, seen, held = tables
    got = quality.classify(docs, seen).join(held, "doc_id").where("quality is not null").collect()
    good, poor = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.97 * len(good)
    assert sum(not r.keep for r in poor) >= 0.9 * len(poor)


def test_bradley_terry_is_at_its_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    good = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=300) > 0).astype(int)
    mean, scale, w = quality.fit(x, good, pairs=4000)
    z = (x - mean) / scale
    again = np.random.default_rng(7)
    a, b = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    d = z[again.choice(a, 4000)] - z[again.choice(b, 4000)]
    loss = lambda v: np.mean(np.log1p(np.exp(-(d @ v)))) + 1e-3 * (v @ v) / 2
    assert all(loss(w) <= loss(w + e) for e in 0.01 * np.concatenate([np.eye(3), -np.eye(3)]))
    assert w[0] > 0 > w[1] and quality.fit(x, np.ones(300)) is None


def test_quality_features_by_definition():
    texts = ["The cat sat. THE CAT 42 | x", "", None, "a b " * 30, "é | ~ Wort\nzwei"]
    x, has = quality.features(pa.array(texts))
    assert has.tolist() == [True, False, False, True, True]
    names = quality.FEATURES
    for t, row in zip(texts, x):
        data = (t or "").encode()
        size = max(1, len(data))
        f = dict(zip(names, row))
        assert f["upper"] == pytest.approx(sum(65 <= b < 91 for b in data) / size)
        assert f["digit"] == pytest.approx(sum(48 <= b < 58 for b in data) / size)
        words = (t or "").lower().split()
        threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] or ([tuple(words)] if words else [])
        assert f["repeat3"] == pytest.approx(len(set(threes)) / len(threes) if threes else 1)


def test_quality_threshold_by_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(np.round(rng.normal(1.5 * (i % 3 > 0)), 2))) for i in range(400)]
    lab = {i: int(i % 3 > 0) for i in range(0, 400, 2)}
    s = spark.createDataFrame(rows, "doc_id long, score double")
    labels = spark.createDataFrame(list(lab.items()), "doc_id long, quality int")
    cut, share = quality.threshold(s, labels)

    def loss(c):
        kept = np.mean([sc >= c for i, sc in rows if lab.get(i) == 0])
        lost = np.mean([sc < c for i, sc in rows if lab.get(i) == 1])
        return kept + 5 * lost

    assert loss(cut) <= min(loss(b / quality.BINS) for b in range(-500, 500)) + 1e-9
    assert share == pytest.approx(np.mean([sc < cut for _, sc in rows]))


def test_quality_cases(spark):
    docs, labels = odd(spark), odd_labels(spark, "quality")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ODD)
    assert all(r.score is None and not r.keep for r in got if r.doc_id in (1, 2, 3))
    assert quality.keep_good(docs, labels).columns == docs.columns
    for none in (labels.limit(0), labels.where("quality = 1")):
        kept = quality.keep_good(docs, none)
        assert kept.columns == docs.columns and kept.count() == len(ODD) - 3
        assert sum(r.keep for r in quality.classify(docs, none).collect()) == len(ODD) - 3
    assert quality.classify(docs.limit(0), labels).count() == quality.keep_good(docs.limit(0), labels).count() == 0


def test_keep_good_follows_classify(tables):
    docs, seen, _ = tables
    kept = {r.doc_id for r in quality.keep_good(docs, seen).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, seen).where("keep").collect()}


# toxicity


def kernel(s, t):
    def weights(u):
        out = {}
        for at in combinations(range(len(u)), 3):
            k = tuple(u[i] for i in at)
            out[k] = out.get(k, 0.0) + toxicity.DECAY ** (at[2] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def symbols(word):
    return toxicity._SYMBOL[np.frombuffer(word.encode(), np.uint8)]


def test_kernel_by_definition():
    words = ["idiot", "idxiot", "stupid", "banana", "idi"]
    strings = [symbols(w) for w in words]
    k = toxicity.Kernel(strings).rows(strings)
    for i, j in product(range(5), repeat=2):
        assert k[i, j] == pytest.approx(kernel(strings[i].tolist(), strings[j].tolist()), abs=1e-4)
    assert k[0, 1] > 0.5 > k[0, 3]


def test_folded_model_is_the_support_vector_machine():
    words = ["idiot", "idiots", "moron", "table", "window", "garden", "idioma", "morning"]
    strings = [symbols(w) for w in words]
    y = np.array([1, 1, 1, 0, 0, 0, 0, 0], bool)
    m = toxicity.train_words(strings, y, np.ones(8), np.arange(8))
    f = [float(m.margins(s[None])[0]) for s in strings]
    assert all((v > 0) == t for v, t in zip(f, y))


def test_toxicity_held_out(tables):
    docs, seen, held = tables
    got = toxicity.classify(docs, seen).withColumnRenamed("toxic", "said").join(held, "doc_id").where("toxic is not null").collect()
    bad, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(not r.said for r in clean) >= 0.97 * len(clean)
    assert sum(r.said for r in bad) >= 0.6 * len(bad)  # some labelled rows are junk without any insult, others use words rare in this small table


def test_gapped_insults(spark, tables):
    model = toxicity.train(tables[0], tables[1].unionByName(tables[2]))
    text = ["You are an idiot.", "You are an i-d-i-o-t.", "You are an idxiot, he said.", "Such a mo.ron!", "you s t u p i d man", "The cat sat on the mat."]
    score = toxicity.score_texts(model, pa.array(text, pa.large_string()))[0]
    assert (score[:5] > 0).all() and score[5] < 0


def test_insults_split_by_spaces(tables):
    model = toxicity.train(tables[0], tables[1].unionByName(tables[2]))
    text = ["You are an idi ot.", "You are an i di ot, he said.", "A st upid idea!", "what a stup id man", "The quiet gar den is o pen.", "The cat sat on the mat."]
    score, _, bad, _ = toxicity.score_texts(model, pa.array(text, pa.large_string()))
    assert (score[:4] > 0).all() and (bad[:4] == 1).all() and (score[4:] < 0).all()


def test_sentences_without_a_telling_word_teach():
    """Both pieces are as frequent in clean texts; only their join tells."""
    rng = np.random.default_rng(0)
    filler = ["table", "window", "garden", "river", "letter", "market"]
    some = lambda k: " ".join(rng.choice(filler, k))
    bad = [f"{some(3)} zor gak {some(2)}." for _ in range(60)]
    clean = [f"{some(2)} {'zor' if i % 2 else 'gak'} {some(3)}." for i in range(120)]
    model = toxicity.fit(pa.array(bad + clean, pa.large_string()), np.arange(180) < 60)
    score = toxicity.score_texts(model, pa.array(["A river zor gak market.", "A zor river.", "A gak market."], pa.large_string()))[0]
    assert score[0] > 0 and (score[1:] < 0).all()


def test_toxicity_cases(spark):
    docs, labels = odd(spark), odd_labels(spark, "toxic")
    got = toxicity.classify(docs.drop("toxic"), labels).collect()
    assert len(got) == len(ODD) and not any(r.toxic for r in got)
    assert all(r.score is None and r.sentences == 0 for r in got if r.doc_id in (1, 2, 3))
    for lab in (labels, labels.limit(0)):
        kept = toxicity.drop_toxic(docs, lab)
        assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect() if r.doc_id == 4} == {-1.0}


def test_a_long_document_is_read_to_its_end(tables):
    model = toxicity.train(tables[0], tables[1].unionByName(tables[2]))
    text = "the quiet garden. " * 60_000 + "You stupid idiot."
    score, total, bad, _ = toxicity.score_texts(model, pa.array([text], pa.large_string()))
    assert score[0] > 0 and total[0] == 60_001 and bad[0] == 1


# pages


def test_marginals_by_enumeration():
    page = H.Page("<div><p>a<b>c</b></p><ul><li>x<li>y</ul></div>")
    forest = H.Forest([page])
    n = len(page.tag)
    rng = np.random.default_rng(0)
    unary, pair = rng.normal(size=n), rng.normal(size=(2, 2))
    p, both, log_z = forest.marginals(unary, pair)
    total, mine, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(u for u, v in zip(unary, y) if v) + sum(pair[y[forest.parent[i]], y[i]] for i in range(1, n)))
        total += w
        mine += w * np.array(y)
        for i in range(1, n):
            joint[i, y[forest.parent[i]], y[i]] += w
    assert np.allclose(p, mine / total) and np.allclose(both[1:], joint[1:] / total) and log_z == pytest.approx(np.log(total))


def test_several_pages_are_independent():
    pages = [H.Page("<p>a"), H.Page("<div><p>b</p></div>")]
    unary = np.arange(5) / 5
    pair = np.array([[0.3, -0.2], [0.1, 0.4]])
    whole = H.Forest(pages).marginals(unary, pair)[0]
    parts = np.concatenate([H.Forest([pages[0]]).marginals(unary[:2], pair)[0], H.Forest([pages[1]]).marginals(unary[2:], pair)[0]])
    assert np.allclose(whole, parts)


def test_pages_held_out(spark):
    """Trained on half of the pages, on the others the marked element's words are found and the rest left, the mark itself hidden."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    model = H.fit([r.html for r in rows if r.page_id % 2 == 0])
    right = found = wanted = 0
    for r in (r for r in rows if r.page_id % 2):
        page = H.Page(r.html)
        y = page.label()
        if y is None:
            continue
        want = " ".join(" ".join(t.split()) for node, t in page.chunks if y[node])
        hidden = r.html.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div")
        got = H.extract_slice(model, [hidden])[0][0]
        a, b = set(H.entities.unescape(want).split()), set(got.split())
        right, found, wanted = right + len(a & b), found + len(b), wanted + len(a)
    assert wanted and right / found > 0.95 and right / wanted > 0.95


def test_page_cases(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "no tags at all"), (None, "<p>x</p>"), (4, "<div>" * 5000 + "deep"), (5, "</p></div><b>stray"), (6, "<script>var a='<p>no</p>'</script><!-- no --><p>yes &amp; no"), (6, "<script>var a='<p>no</p>'</script><!-- no --><p>yes &amp; no"), (7, "<p>" + "word " * 200_000), (8, "<")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit(1) for c in ("content", "s", "nodes", "url")})
    got = H.extract(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].content is None and by[1].nodes is None and by[2].content == "" and by[3].content == "no tags at all"
    assert by[6].content == "yes & no" and by[4].content == "deep" and len(by[7].content.split()) == 200_000
    assert by[None].content == "x" and by[None].confidence is None
    assert H.extract(pages.limit(0)).count() == 0
    assert queries.op8_html_extraction(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_an_insult_anywhere_in_a_long_word(tables):
    model = toxicity.train(tables[0], tables[1].unionByName(tables[2]))
    text = ["qz" * 10 + "q" * at + "stupid" + "qz" * 40 for at in range(10)]
    scores = toxicity.score_texts(model, pa.array(text, pa.large_string()))[0]
    assert scores.min() > 0.5  # wherever it starts
