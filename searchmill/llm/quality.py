"""Quality classifier: Bradley-Terry ranking of documents, cut at a score quantile.

A document's score is a weighted sum of FEATURES. Training asks of pairs of a good
and a poor labelled document that the good one score higher. The cut is a quantile of
the scores of all documents: the one given, or the one that parts the labels best.

Cases. A null, empty or white text has no score (null) and isn't kept. A null
doc_id is scored like any other and never trains. Repeated rows get equal scores
each. Ties at the threshold are kept. Without labels of both classes nothing can
be ranked: scores are null and every document with a word is kept. Columns other
than doc_id and text are ignored here and carried along by `keep_good`. Very long
texts are scored whole, and train up to FIT_CHARS characters. Rows that repeat an id
train once. No documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, cut, free, label_sample, sampled_texts, text_udf
from .textbytes import WHITE, shingle_hashes, text_bytes, word_hashes

FIT_ROWS = 2000  # labelled documents of each class that training reads, at most
PAIRS = 20000  # preference pairs drawn from them
BINS = 100  # score histogram bins for each unit of score

FEATURES = ("upper", "symbol", "digit", "space", "line", "repeat1", "repeat3", "word_length", "loner")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, bool)  # letters, digits, white space, every byte of a non-ASCII character, prose punctuation
_PLAIN[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\n.,;:'\"()-?":
    _PLAIN[_c] = True


_STRAY = ~WHITE & ~_DIGIT & ((np.arange(256) < 65) | np.isin(np.arange(256), list(b"|~`^_{}[]\\")))
_CLASSES = np.stack([_UPPER, ~_PLAIN, _DIGIT, WHITE, np.arange(256) == 10], 1)
_LANES = (_CLASSES.astype(np.int64) << np.array([0, 21, 42, 0, 21])).astype(np.int64)
_LOW, _HIGH = _LANES[:, :3].sum(1), _LANES[:, 3:].sum(1)


def _class_counts(data: np.ndarray, offsets: np.ndarray, loner: np.ndarray) -> np.ndarray:
    """Bytes of each class in each text: upper, symbol, digit, white, line, loner.

    Three counters of 21 bits go through one prefix sum, in runs too short to overflow one.
    """
    out = np.zeros((len(offsets) - 1, 6), np.int64)
    step = (1 << 21) - 1
    for start in range(0, len(data), step):
        part = data[start : start + step]
        at = np.clip(offsets - start, 0, len(part))
        for column, lanes in ((0, _LOW[part]), (3, _HIGH[part] + (loner[start : start + step].astype(np.int64) << 42))):
            sums = np.zeros(len(part) + 1, np.int64)
            np.cumsum(lanes, out=sums[1:])
            found = sums[at[1:]] - sums[at[:-1]]
            for k in range(3):
                out[:, column + k] += (found >> (21 * k)) & step
    return out


def _distinct_share(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each text's items, the share that is a first occurrence; 1 for none."""
    if not len(hashes):
        return np.ones(n)
    # one sort of a key that keeps owner in front: hashes are already uniform
    with np.errstate(over="ignore"):
        key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    first = np.concatenate([[True], key[1:] != key[:-1]])
    total = np.bincount(owner, minlength=n)
    unique = np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=n)
    return np.where(total > 0, unique / np.maximum(total, 1), 1.0)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of FEATURES for each text, and whether it has a word. All are shares or means, so that length alone decides nothing."""
    n = len(column)
    data, offsets = text_bytes(column)
    size = np.maximum(np.diff(offsets), 1)
    hashes, owner = word_hashes(column)
    words = np.bincount(owner, minlength=n)
    threes, three_owner = shingle_hashes(hashes, owner, n, 3)
    # words of one byte that isn't a letter, digit or part of a longer character: bars, bullets, stray signs
    loner = np.zeros(len(data), bool)
    loner[1:-1] = _STRAY[data[1:-1]] & WHITE[data[:-2]] & WHITE[data[2:]]
    upper, symbol, digit, white, line, alone = _class_counts(data, offsets, loner).T
    x = np.stack(
        [
            upper / size,
            np.log1p(100 * symbol / size),
            digit / size,
            white / size,
            line / np.maximum(words, 1),
            np.log(_distinct_share(hashes, owner, n)) / np.log(np.maximum(words, 3)),
            _distinct_share(threes, three_owner, n),
            np.minimum(np.diff(offsets) / np.maximum(words, 1), 40) / 10,
            alone / np.maximum(words, 1),
        ],
        axis=1,
    )
    return x, words > 0


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(mean, scale, weights) of the Bradley-Terry model; None unless both classes occur.

    Each pair is a good document i and a poor one j. With score s = w.x, the
    chance that i is preferred is 1 / (1 + exp(s_j - s_i)): logistic loss on the
    difference of their features, minimised by Newton steps.
    """
    a, b = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(a) or not len(b):
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    rng = np.random.default_rng(7)
    d = z[rng.choice(a, pairs)] - z[rng.choice(b, pairs)]
    w = np.zeros(x.shape[1])

    def loss(v):
        return np.mean(np.logaddexp(0, -(d @ v))) + ridge * (v @ v) / 2

    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        g = -(d * p[:, None]).mean(0) + ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        move, rate = np.linalg.solve(h, g), 1.0
        while rate > 1e-4 and loss(w - rate * move) > loss(w):
            rate /= 2
        w = w - rate * move
        if np.abs(rate * move).max() < 1e-7:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """The model from at most fit_rows labelled documents of each class."""

    def run(column: pa.Array) -> pa.Array:
        x, has = features(column)
        return pa.array([row if ok else None for row, ok in zip(x.tolist(), has)], pa.list_(pa.float64()))

    sample = sampled_texts(docs, label_sample(docs, labels, "quality", fit_rows))
    rows = sample.select("doc_id", "label", text_udf(run, "array<double>")(F.col("text")).alias("x")).collect()
    rows = sorted((r for r in rows if r.x is not None), key=lambda r: (r.doc_id, r.x))  # here, as a filter on x would be moved under the join, and computed for every document
    if not rows:
        return None
    return fit(np.array([r.x for r in rows]), np.array([r.label for r in rows]))


def scorer(model):
    """Column function: text to score, null for a text without words."""

    def run(column: pa.Array) -> pa.Array:
        if model is None:
            return pa.nulls(len(column), pa.float64())
        mean, scale, w = model
        x, has = features(column)
        return pa.array(np.round(((x - mean) / scale) @ w, 6), mask=~has)

    return text_udf(run, "double")


class Scores:
    """A histogram of all documents' scores in bins of 1/BINS, split by label; as many bins as the range of scores needs, whatever the number of documents."""

    def __init__(self, scored: DataFrame, labels: DataFrame):
        lab = labels.select("doc_id", F.col("quality").cast("int").alias("q")).where("doc_id is not null and q in (0, 1)").groupBy("doc_id").agg(F.max("q").alias("q"))
        binned = scored.where("score is not null").select("doc_id", F.floor(F.greatest(F.least("score", F.lit(1000.0)), F.lit(-1000.0)) * BINS).alias("bin"))
        counts = (
            binned.join(lab, "doc_id", "left")
            .groupBy("bin")
            .agg(F.count("*").alias("n"), F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("poor"))
            .orderBy("bin")
            .collect()
        )
        self.bins = np.array([r.bin for r in counts], np.int64)
        self.n, self.good, self.poor = (np.array([getattr(r, k) for r in counts], np.int64) for k in ("n", "good", "poor"))
        self.below = np.concatenate([[0], np.cumsum(self.n)])  # documents below bin i; last, all

    def quantile(self, good_weight: float = 5.0) -> float | None:
        """Of all score quantiles, the one at which the labelled rows show least loss.

        The loss is the share of poor ones kept, plus good_weight times the share of
        good ones lost; of equal ones, the middle of the widest gap in the scores.
        None without rows of both labels.
        """
        if not self.good.sum() or not self.poor.sum():
            return None
        lost = np.concatenate([[0], np.cumsum(self.good)]) / self.good.sum()
        kept = 1 - np.concatenate([[0], np.cumsum(self.poor)]) / self.poor.sum()
        loss = kept + good_weight * lost
        best = np.flatnonzero(np.isclose(loss, loss.min(), atol=1e-12))  # cut below bin i; len(bins) is above all
        low, high = self._gaps()
        return float(self.below[best[np.argmax((high - low)[best])]] / self.below[-1])

    def at(self, quantile: float) -> float:
        """The score below which that share of all documents is, within a bin: the middle of the gap between the bins that it parts."""
        i = int(np.searchsorted(self.below, round(quantile * self.below[-1])))
        low, high = self._gaps()
        return float((low[i] + 1 + high[i]) / 2 / BINS)

    def _gaps(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[self.bins[0] - 1], self.bins]), np.concatenate([self.bins, [self.bins[-1] + 1]])


def threshold(scored: DataFrame, labels: DataFrame, quantile: float | None = None, good_weight: float = 5.0) -> tuple[float, float] | None:
    """(score, quantile) to cut at; scored has doc_id and score of all documents.

    The quantile is the one given, or the one that the labels choose; the score is
    the scores' value at it. None without scores, or without labels to choose by.
    """
    scores = Scores(scored, labels)
    if not len(scores.bins):
        return None
    q = scores.quantile(good_weight) if quantile is None else min(1.0, max(0.0, quantile))
    return None if q is None else (scores.at(q), q)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, quantile: float | None = None) -> DataFrame:
    """(doc_id, score, keep) for each row of docs (doc_id, text); keep holds from the score quantile on, which the labels choose unless it is given."""
    docs = docs.select("doc_id", "text")
    model = train(docs, labels, fit_rows)
    scored = cut(docs.select("doc_id", scorer(model)(F.col("text")).alias("score"), F.col("text").rlike(WORD).alias("has")))
    at = threshold(scored, labels, quantile)
    keep = F.coalesce(F.col("has"), F.lit(False)) if at is None else F.coalesce(F.col("score") >= at[0], F.lit(False))
    return scored.select("doc_id", "score", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, quantile: float | None = None) -> DataFrame:
    """The rows of docs that `classify` keeps, with all their columns.

    The threshold needs every score before the first decision, so texts are
    scored once for it and once for the filter; neither pass moves a text.
    """
    slim = docs.select("doc_id", "text")
    model = train(slim, labels, fit_rows)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    score = scorer(model)
    at = threshold(slim.select("doc_id", score(F.col("text")).alias("score")), labels, quantile)
    (name,) = free(docs.columns, "score")
    kept = docs.withColumn(name, score(F.col("text")))
    return kept.where(F.col(name).isNotNull() if at is None else F.col(name) >= at[0]).select(*[F.col(f"`{c}`") for c in docs.columns])
