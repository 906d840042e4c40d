"""Whole queries against plain Python that shares no helper with them but tokenizers, hashes and trained weights."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchmill.llm import fingerprints, html_extract, lang_id, quality, queries, toxicity
from searchmill.llm.textbytes import mix, shingles


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h")).collect()


def test_op1(spark, sf_dir, docs):
    import zstandard as z

    tables = {}
    for name in sorted({r.lang for r in docs if r.lang}):
        mine = sorted((r for r in docs if r.lang == name and r.text is not None), key=lambda r: (r.h, r.doc_id))[: lang_id.FIT_ROWS]
        texts = []
        for r in sorted(mine, key=lambda r: r.doc_id):
            start = max(1, int((len(r.text) - lang_id.FIT_TEXT) / 2))
            if r.text.strip():
                texts.append(r.text[start - 1 : start - 1 + lang_id.FIT_TEXT].encode())
        share = next(s for s in range(lang_id.DICTIONARY, 0, -1) if sum(min(len(t), s) + 1 for t in texts) <= lang_id.DICTIONARY)
        cut = [t if len(t) <= share else t[(len(t) - share) // 2 :][:share] for t in texts]
        d = z.ZstdCompressionDict(b"\n".join(c.decode("utf-8", "ignore").encode() for c in cut) + b"\n", dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=lang_id.LEVEL)
        tables[name] = z.ZstdCompressor(level=lang_id.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        if not (r.text or "").strip():
            assert got[r.doc_id].lang is None and got[r.doc_id].bytes is None
            continue
        data = r.text.encode()
        size = sorted((sum(len(c.compress(data[i : i + lang_id.BLOCK])) for i in range(0, len(data), lang_id.BLOCK)), name) for name, c in tables.items())
        margin = round((size[1][0] - size[0][0]) / len(data), 6)
        assert (got[r.doc_id].bytes, got[r.doc_id].margin) == (size[0][0], pytest.approx(margin))
        assert got[r.doc_id].lang == (size[0][1] if margin >= lang_id.MARGIN else None)


def plain_features(text):
    data, words = text.encode(), text.lower().split()
    size, n = len(data), len(words)
    plain = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\n.,;:'\"()-?")
    white = {9, 10, 11, 12, 13, 28, 29, 30, 31, 32}
    stray = lambda b: b not in white and not 48 <= b < 58 and (b < 65 or b in b"|~`^_{}[]\\")
    alone = sum(stray(data[i]) and data[i - 1] in white and data[i + 1] in white for i in range(1, size - 1))
    threes = [tuple(words[i : i + 3]) for i in range(n - 2)] or [tuple(words)]
    return [
        sum(65 <= b < 91 for b in data) / size,
        math.log1p(100 * sum(b < 128 and b not in plain for b in data) / size),
        sum(48 <= b < 58 for b in data) / size,
        sum(b in white for b in data) / size,
        data.count(b"\n") / n,
        math.log(len(set(words)) / n) / math.log(max(n, 3)),
        len(set(threes)) / len(threes),
        min(size / n, 40) / 10,
        alone / n,
    ]


def test_op2(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mean, scale, w = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    score = {r.doc_id: round(float(((np.array(plain_features(r.text)) - mean) / scale) @ w), 6) if (r.text or "").strip() else None for r in docs}
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf_dir).collect()}
    assert set(got) == set(score)
    assert all((got[i].score is None) == (s is None) and (s is None or abs(got[i].score - s) < 1e-5) for i, s in score.items())
    lab = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and score.get(r.doc_id) is not None}

    def loss(keep):
        share = lambda v, k: np.mean([keep(i) == k for i in lab if lab[i] == v])
        return share(0, True) + 5 * share(1, False)

    cuts = sorted({math.floor(s * quality.BINS) / quality.BINS for s in score.values() if s is not None})
    assert loss(lambda i: got[i].keep) <= min(loss(lambda i: score[i] >= c) for c in cuts) + 1e-9
    kept = [s for i, s in score.items() if got[i].keep]
    assert min(kept) > max(s for i, s in score.items() if s is not None and not got[i].keep)


def test_op3(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, sf_dir).collect()}
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        hashes = shingles(pa.array([r.text or ""]), 3)[0].tolist()
        if not hashes:
            assert got[r.doc_id].fingerprint is None and got[r.doc_id].shingles == 0
            continue
        bins = {}
        for h in hashes:
            bins[h >> 56] = min(bins.get(h >> 56, 2**64), h & (2**56 - 1))
        bits = ""
        for b in range(256):
            attempt, at = 0, b
            while at not in bins:
                attempt += 1
                at = int(mix(np.array([(b * 0x9E3779B97F4A7C15 + attempt * 0xD1B54A32D192ED03) % 2**64], np.uint64))[0]) % 256
            low = int(mix(np.array([bins[at]], np.uint64))[0])
            bits += "".join(str(low >> k & 1) for k in range(fingerprints.BITS))
        assert bytes(got[r.doc_id].fingerprint) == int(bits, 2).to_bytes(128, "big")
        assert (got[r.doc_id].shingles, got[r.doc_id].empty_bins) == (len(hashes), 256 - len(bins))


def test_op8(spark, sf_dir):
    """Content by sum-product over each page's own tree, node by node, against the query over all pages at once."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_extract.train(pages)
    got = {r.page_id: r for r in queries.op8_html_extraction(spark, sf_dir).collect()}
    rows = pages.collect()
    assert set(got) == {r.page_id for r in rows}
    for r in rows:
        page = html_extract.Page(r.html)
        unary = html_extract.Forest([page]).x @ model.weights
        children = {}
        for i, p in enumerate(page.parent):
            children.setdefault(p, []).append(i)
        n = len(page.tag)
        up = np.zeros((n, 2))
        for i in reversed(range(n)):
            up[i] = [0, unary[i]]
            for c in children.get(i, []):
                up[i] += [np.logaddexp(model.pair[y, 0] + up[c, 0], model.pair[y, 1] + up[c, 1]) for y in (0, 1)]
        belief = up.copy()
        for i in range(1, n):
            p = page.parent[i]
            rest = belief[p] - [np.logaddexp(model.pair[y, 0] + up[i, 0], model.pair[y, 1] + up[i, 1]) for y in (0, 1)]
            belief[i] = up[i] + [np.logaddexp(rest[0] + model.pair[0, v], rest[1] + model.pair[1, v]) for v in (0, 1)]
        content = belief[:, 1] - belief[:, 0] > 0
        assert got[r.page_id].nodes == n and got[r.page_id].content_nodes == content.sum()
        words = " ".join(html_extract.entities.unescape(t) for node, t in page.chunks if content[node] and page.tag[node] not in ("head", "title", "meta", "link", "base"))
        assert sorted("".join(words.split())) == sorted("".join(got[r.page_id].content.split()))


def test_op10(spark, sf_dir, docs):
    """Scores of all but the longest documents by the kernel's own sums over words, windows, runs and joins."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    assert set(got) == {r.doc_id for r in docs}
    known = {}

    def f(s):
        if s not in known:
            own, dot = {}, 0.0
            for i, j, k in itertools.combinations(range(len(s)), 3):
                code, w = (s[i] * 40 + s[j]) * 40 + s[k], toxicity.DECAY ** (k - i + 1)
                own[code] = own.get(code, 0.0) + w
                dot += 0.0 if model.weights is None else w * float(model.weights[code])
            known[s] = model.bias + max(0.0, dot) / math.sqrt(sum(v * v for v in own.values()))
        return known[s]

    for r in docs:
        words = [(w, tuple(int(x) for x in toxicity._SYMBOL[np.frombuffer(w.encode(), np.uint8)] if x)) for w in re.findall(r"[^\s\x1c-\x1f]+", (r.text or "").lower(), re.A)]
        if len(words) > 150:
            continue
        sentences = [[]]
        for (w, s), line in zip(words, re.split(r"[^\s\x1c-\x1f]+", (r.text or "").lower(), flags=re.A)[1:]):
            sentences[-1].append(s)
            if re.search(r"[.!?]", w) or "\n" in line:
                sentences.append([])
        sentences = [s for s in sentences if s]
        scores = []
        for s in sentences:
            strings = [w for w in s if len(w) >= 3]
            for size, run in itertools.groupby(s, key=len):
                run = list(run)
                if size == 1 and len(run) >= 3:
                    strings.append(sum(run, ()))
            long = [w for w in strings if len(w) > 20]
            strings = [w for w in strings if len(w) <= 20] + [w[i : i + k] for w in long for k in toxicity.WINDOWS for i in range(len(w) - k + 1)]
            full = [w for w in s if w]
            if model.weights is not None:
                for i in range(len(full)):
                    joined = full[i]
                    for w in full[i + 1 :]:
                        joined += w
                        if len(joined) > model.longest:
                            break
                        if len(joined) >= 3:
                            strings.append(joined)
            least = toxicity._MIN_SCORE if model.weights is None else model.bias
            scores.append(max([least, *(map(f, strings) if model.weights is not None else ())]))
        mine = got[r.doc_id]
        assert mine.sentences == len(sentences)
        if scores:
            assert mine.score == pytest.approx(max(scores), abs=2e-3)
            assert abs(mine.toxic_sentences - sum(x > 0 for x in scores)) <= sum(abs(x) < 2e-3 for x in scores)
        else:
            assert mine.score is None
