"""Toxicity: a subsequence-kernel support vector machine over the words of each sentence.

The kernel of two strings counts their common subsequences of three symbols, each
weighed by DECAY for every symbol it stretches over, and is normalised to 1 for
equal strings. So "idxiot" or "i-d-i-o-t" stays close to "idiot".

A support vector machine over Nystroem features of the landmarks Z is
f(x) = sum_j a_j k(x, z_j) + b. As k is an inner product of subsequence weights,
the landmarks fold into one table of weights by subsequence, and the cost of a
word doesn't depend on how many landmarks there are.

A sentence scores as its worst string, a document as its worst sentence; it is
toxic if the score is positive. The strings are the words, and every join of
neighbouring words of a sentence that is no longer than the longest insult known
with two symbols put in: an insult broken by spaces is one of these.

What trains. Labels are of documents, of which only some sentences are toxic. So the
machine isn't trained on whole sentences but on their strings: those of toxic
documents' sentences that keep to such sentences by more than chance (`telling`), with
disguises of them, against all strings of clean documents.

Cases. A null, empty or white text has no score (null), no sentences, and isn't
toxic. A score of exactly 0 isn't toxic; of equally bad sentences any is the worst.
Very long texts are scored whole, words of over WINDOW symbols in windows at every
place. Rows with a null doc_id are scored and never
train; repeated rows score alike and train once; texts of over FIT_CHARS characters
don't train. Without labels of both classes, or no string that tells them apart, all
scores are -1: nothing is toxic. No documents give no rows. Columns other than doc_id
and text are carried along by `drop_toxic`.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, label_sample, sampled_texts, text_udf
from .textbytes import WHITE, mix, slices, span_hashes, text_bytes, words

FIT_ROWS = 1500  # labelled documents of each class that training reads, at most
LANDMARKS = 512
FREQUENT, HASHED, ADDED = 1000, 1000, 1000  # clean strings that train: the most frequent, a sample by hash, and in each round those that score highest
ROUNDS = 8
PROBES = 1000  # clean strings that score highest, against which disguises are tried
NEAR = 0.6  # kernel with a clean word from which a word isn't given disguises
DECAY = 0.7
WINDOW = 20  # symbols of the longest strings
WINDOWS = (20, 10)  # longer words are scored in windows of these sizes at every place: an insult is whole in one, and not alone among many symbols
SIZE = 40  # symbols: 0 none, a-z, a digit, 13 for bytes of longer characters
NAME = f"S{WINDOW}"  # a string of symbols: millions of them as objects would outgrow the driver
_MIN_SCORE = -1.0

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[128:192] = 28 + np.arange(64) % 11  # the rest of a longer character
_SYMBOL[192:] = 39  # its first byte
_END = np.isin(np.arange(256), list(b".!?\n"))


@lru_cache(maxsize=64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of three in a string, and the weight of each by its stretch."""
    t = np.array(list(combinations(range(length), 3)), np.int64).reshape(-1, 3)
    return t, (DECAY ** (t[:, 2] - t[:, 0] + 1 if len(t) else np.zeros(0))).astype(np.float32)


def coded(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings of one length, as rows of symbols: the subsequence codes of each row, and their weights."""
    t, w = _triples(strings.shape[1])
    s = strings.astype(np.int64)
    return (s[:, t[:, 0]] * SIZE + s[:, t[:, 1]]) * SIZE + s[:, t[:, 2]], w


def norms(strings: np.ndarray) -> np.ndarray:
    """Square root of each row's kernel with itself, by the usual recursion over pairs of places."""
    n, length = strings.shape
    d = np.float32(DECAY)
    out = np.empty(n)
    for start in range(0, n, 4096):
        s = np.ascontiguousarray(strings[start : start + 4096].T)
        total = np.zeros(s.shape[1], np.float32)
        zero = np.zeros(s.shape[1], np.float32)
        # ended[p][j]: weight of matches of p symbols up to places (i, j), faded to there; by symmetry j <= i
        above = [[zero] * length, [zero] * length]
        for i in range(length):
            here = [[zero] * length, [zero] * length]
            for j in range(i + 1):
                same = (s[i] == s[j]).astype(np.float32)
                corner = [above[p][j - 1] if j else zero for p in (0, 1)]
                up = [above[p][j] if j < i else (here[p][j - 1] if j else zero) for p in (0, 1)]
                left = [here[p][j - 1] if j else zero for p in (0, 1)]
                third = same * corner[1] * (d * d)
                total += third if i == j else 2 * third
                if i < length - 1:
                    here[0][j] = same * (d * d) + d * (up[0] + left[0]) - d * d * corner[0]
                    here[1][j] = same * corner[0] * (d * d) + d * (up[1] + left[1]) - d * d * corner[1]
            above = here
        out[start : start + 4096] = total
    return np.sqrt(np.maximum(out, 1e-30))


def all_norms(strings: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(strings))
    lengths = np.array([len(s) for s in strings])
    for length in np.unique(lengths):
        mine = np.flatnonzero(lengths == length)
        out[mine] = norms(np.stack([strings[i] for i in mine]))
    return out


class Words:
    """The words of some texts in letters, digits and longer characters, all else taken out.

    Runs of single-character words count as one word more ("i d i o t").
    rows: unique strings by length; where: for each string its (text, sentence) places.
    joined(most): the same for the joins of neighbouring words of up to `most` symbols.
    """

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(pc.utf8_lower(column))
        n = len(column)
        starts, lengths, owner = words(data, offsets)
        symbols = _SYMBOL[data]
        plain = np.concatenate([[0], np.cumsum(symbols > 0)])
        size = plain[starts + lengths] - plain[starts]  # symbols of each word
        ends = np.concatenate([[0], np.cumsum(_END[data])])
        # a sentence ends after a word that holds a terminator, and with its text
        sentence = np.zeros(len(starts), np.int64)
        if len(starts):
            gap = (ends[starts[1:]] > ends[starts[:-1]]) | (owner[1:] != owner[:-1])
            sentence[1:] = np.cumsum(gap)
        self.texts = n
        self.word_owner = owner
        self.sentence = sentence
        # a key for the symbols of each sentence, the same wherever it is copied
        hashes = span_hashes(data, starts, lengths)
        self.sentence_key = np.zeros(int(sentence[-1]) + 1 if len(sentence) else 0, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(self.sentence_key, sentence, hashes)
        self.sentence_owner = owner[np.concatenate([[True], sentence[1:] != sentence[:-1]])] if len(starts) else owner
        kept = symbols[symbols > 0]
        begin = plain[starts]
        self.kept, self.begin, self.size, self.word_sentence = kept, begin, size, sentence
        runs = self._runs(size, owner, sentence)
        if len(runs):
            first, last = runs.T
            begin = np.concatenate([begin, begin[first]])
            size = np.concatenate([size, begin[last] + size[last] - begin[first]])
            sentence = np.concatenate([sentence, sentence[first]])
        self.items: list[tuple[np.ndarray, np.ndarray]] = []  # (strings, sentence of each), one for each length
        long = size > WINDOW
        if long.any():
            parts = [(begin[~long], sentence[~long], size[~long])]
            for width in WINDOWS:
                count = size[long] - width + 1
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                parts.append((np.repeat(begin[long], count) + step, np.repeat(sentence[long], count), np.full(len(step), width)))
            begin, sentence, size = (np.concatenate(x) for x in zip(*parts))
        for length in range(3, WINDOW + 1):
            mine = np.flatnonzero(size == length)
            if len(mine):
                self.items.append((np.lib.stride_tricks.sliding_window_view(kept, length)[begin[mine]], sentence[mine]))

    def joined(self, most: int):
        """(strings, sentence of each), one for each length: all of two or more neighbouring words that have 3 to `most` symbols together."""
        full = np.flatnonzero(self.size > 0)  # marks alone don't part the pieces
        begin, size, sentence = self.begin[full], self.size[full], self.word_sentence[full]
        at, total = np.arange(len(full)), size.copy()
        found = []
        for step in range(1, most):
            at, total = at[at + step < len(full)], total[: np.count_nonzero(at + step < len(full))]
            total = total + size[at + step]
            fits = (total <= most) & (sentence[at + step] == sentence[at])
            at, total = at[fits], total[fits]
            if not len(at):
                break
            found.append((begin[at], total, sentence[at]))
        if not found:
            return
        begin, total, sentence = (np.concatenate(x) for x in zip(*found))
        for length in range(3, most + 1):
            mine = np.flatnonzero(total == length)
            if len(mine):
                yield np.lib.stride_tricks.sliding_window_view(self.kept, length)[begin[mine]], sentence[mine]

    @staticmethod
    def _runs(size: np.ndarray, owner: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """First and last word of each run of three or more words of one symbol within a sentence."""
        single = size == 1
        if len(size) < 3 or not single.any():
            return np.zeros((0, 2), np.int64)
        same = np.concatenate([[False], sentence[1:] == sentence[:-1]])
        starts = np.flatnonzero(single & ~(np.concatenate([[False], single[:-1]]) & same))
        follows = np.concatenate([single[1:] & same[1:], [False]])
        ends = np.flatnonzero(single & ~follows)
        long = ends - starts >= 2
        return np.stack([starts[long], ends[long]], 1)


def _unique(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unique rows and, for each row, the number of its unique one."""
    n, length = strings.shape
    with np.errstate(over="ignore"):
        high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for j in range(length):  # 6 bits each: exact up to 20 symbols in two halves of 10
            half = high if j < 10 else low
            half *= np.uint64(64)
            half += strings[:, j]
    if length <= 10:
        _, first, back = np.unique(high, return_index=True, return_inverse=True)
    else:
        order = np.lexsort((low, high))
        new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
        back = np.empty(n, np.int64)
        back[order] = np.cumsum(new) - 1
        first = order[new]
    return strings[first], back


class Model:
    """weights: of each subsequence code; bias; longest: symbols of the longest joins to score. None as weights: nothing is toxic."""

    def __init__(self, weights: np.ndarray | None, bias: float, longest: int = WINDOW):
        self.weights, self.bias, self.longest = weights, bias, longest

    def margins(self, strings: np.ndarray) -> np.ndarray:
        """f of each string, at least the bias: what speaks against a word doesn't count below nothing in common."""
        raw = np.empty(len(strings), np.float32)
        step = max(1, 200_000 // max(1, len(_triples(strings.shape[1])[0])))
        for start in range(0, len(strings), step):
            codes, w = coded(strings[start : start + step])
            raw[start : start + step] = self.weights[codes] @ w
        out = np.full(len(strings), self.bias)
        up = np.flatnonzero(raw > 0)
        if len(up):
            out[up] += raw[up] / norms(strings[up])
        return out


class Kernel:
    """Kernel values of strings with landmarks, by one table of the landmarks' subsequence weights."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.table = np.zeros((SIZE**3, len(landmarks)), np.float32)
        for j, (s, size) in enumerate(zip(landmarks, all_norms(landmarks))):
            codes, w = coded(s[None])
            np.add.at(self.table[:, j], codes[0], w / np.float32(size))

    def rows(self, strings: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(strings), self.table.shape[1]), np.float32)
        for i, (s, size) in enumerate(zip(strings, all_norms(strings))):
            codes, w = coded(s[None])
            out[i] = w @ self.table[codes[0]] / np.float32(size)
        return out


def train_words(strings: list[np.ndarray], positive: np.ndarray, weight: np.ndarray, landmarks: np.ndarray, ridge: float = 1e-5) -> Model:
    """Squared-hinge support vector machine on Nystroem features, folded into a table by subsequence."""
    kernel = Kernel([strings[i] for i in landmarks])
    k = kernel.rows(strings).astype(np.float64)
    values, vectors = np.linalg.eigh(k[landmarks])
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.concatenate([k @ root, np.ones((len(k), 1))], 1)
    y = np.where(positive, 1.0, -1.0)
    u = np.zeros(x.shape[1])
    reg = ridge * np.eye(len(u))
    reg[-1, -1] = 1e-9
    weight = weight / weight.sum()
    for _ in range(30):  # Newton steps on the active set
        active = y * (x @ u) < 1
        h = (x[active] * weight[active, None]).T @ x[active] + reg
        new = np.linalg.solve(h, (x[active] * weight[active, None]).T @ y[active])
        if np.abs(new - u).max() < 1e-8:
            break
        u = new
    return Model(kernel.table @ (root @ u[:-1]).astype(np.float32), float(u[-1]))


def _parts(column: pa.Array):
    """Words of some texts at a time, and their rows: many texts at once would take many times their size in working arrays."""
    at = 0
    for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
        yield Words(part.column(0)), slice(at, at + part.num_rows)
        at += part.num_rows


def telling(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Words that keep to toxic texts by more than chance.

    If a word of k toxic and c clean places were spread evenly, k or more of them
    would be toxic with a chance of at most exp(-(k+c) KL(k/(k+c), p)), p the toxic
    share of texts; times the number of words, that must stay below 1/2. The odds
    must be e^3 besides.
    """
    total = np.maximum(in_toxic + in_clean, 1)
    p, q = n_toxic / (n_toxic + n_clean), in_toxic / total
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(q > 0, q * np.log(q / p), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p)), 0)
    chance = np.where(q > p, -total * kl, 0.0)
    odds = np.log((in_toxic + 0.5) / (n_toxic + 1)) - np.log((in_clean + 0.5) / (n_clean + 1))
    return (chance + np.log(len(total)) < np.log(0.5)) & (odds > 3)


def disguises(word: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The word with a symbol put in, one doubled, one as a digit, and longer words with two symbols put in."""

    def put(s: np.ndarray) -> np.ndarray:
        return np.insert(s, rng.integers(1, len(s)), rng.integers(1, 28))

    at = rng.integers(1, len(word))
    digit = word.copy()
    digit[rng.integers(1, len(word))] = 27
    out = [*(put(word) for _ in range(5)), np.insert(word, at, word[at]), digit]
    if len(word) >= 6:
        out.append(put(put(word)))
    return [w[:WINDOW] for w in out]


def _counted(parts) -> tuple[np.ndarray, np.ndarray]:
    """Of (strings, sentence keys, toxic or not): the strings in order as NAME (no symbol is 0, so none loses its end), and in how many different sentences of toxic and of clean texts each is."""
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for strings, key, bad in parts:
        by_length.setdefault(strings.shape[1], []).append((strings, key, bad))
    names, counts = [], []
    for group in by_length.values():
        strings, key, bad = (np.concatenate(x) for x in zip(*group))
        group.clear()
        unique, back = _unique(strings)
        _, first = np.unique(mix(back.astype(np.uint64)) ^ key, return_index=True)
        counts.append(np.stack([np.bincount(back[first], bad[first], len(unique)), np.bincount(back[first], ~bad[first], len(unique))], 1))
        names.append(_named(unique))
    if not names:
        return np.zeros(0, NAME), np.zeros((0, 2))
    names = np.concatenate(names)
    order = np.argsort(names, kind="stable")
    return names[order], np.concatenate(counts)[order]


def _named(strings: np.ndarray) -> np.ndarray:
    out = np.zeros((len(strings), WINDOW), np.uint8)
    out[:, : strings.shape[1]] = strings
    return out.view(NAME).ravel()


def fit(column: pa.Array, toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS, frequent: int = FREQUENT, hashed: int = HASHED, added: int = ADDED, probes: int = PROBES) -> Model:
    """The model from whole labelled texts, of which only some sentences are toxic.

    Positive are the words that `telling` finds, and the joins that it finds in the
    sentences without such a word, with disguises of those that nothing clean comes
    near (a disguise would claim that too). Places are counted by different
    sentences, so copies of one text count once. Every word or join of a clean text
    that isn't more frequent in toxic ones is a negative, and all of them are scored in
    every round: at first the `frequent` most frequent ones and `hashed` by hash train,
    then, round by round, the `added` that score highest besides.
    """
    toxic = np.asarray(toxic, bool)
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    names, count = _counted((strings, docs.sentence_key[sentence], toxic[rows][docs.sentence_owner[sentence]]) for docs, rows in _parts(column) for strings, sentence in docs.items)
    if not n_toxic or not n_clean:
        return Model(None, _MIN_SCORE)
    told = np.flatnonzero(telling(count[:, 0], count[:, 1], n_toxic, n_clean)) if len(names) else np.zeros(0, int)
    longest = min(WINDOW, max((len(names[i]) for i in told), default=WINDOW - 2) + 2)
    known = names[told]

    def joins(rest: bool):
        for docs, rows in _parts(column):
            explained = np.zeros(len(docs.sentence_owner), bool)
            for strings, sentence in docs.items if rest else ():
                unique, back = _unique(strings)
                hit = np.isin(_named(unique), known)[back]
                explained[sentence[hit]] = True
            for strings, sentence in docs.joined(longest):
                keep = ~explained[sentence]
                yield strings[keep], docs.sentence_key[sentence[keep]], toxic[rows][docs.sentence_owner[sentence[keep]]]

    # joins: those that tell where no word does are positive too; all those of clean texts can be negative
    join_names, join_count = _counted(joins(False))
    rest_names, rest_count = _counted(joins(True))
    more = rest_names[telling(rest_count[:, 0], rest_count[:, 1], n_toxic, n_clean)] if len(rest_names) else rest_names
    more = more[~np.isin(more, names)]
    fresh = ~np.isin(join_names, names)
    names, count = np.concatenate([names, join_names[fresh]]), np.concatenate([count, join_count[fresh]])
    positive = np.concatenate([told, np.flatnonzero(np.isin(names, more))])
    del join_names, join_count, rest_names, rest_count
    if not len(positive):
        return Model(None, _MIN_SCORE)
    odds = np.log((count[:, 0] + 0.5) / (n_toxic + 1)) - np.log((count[:, 1] + 0.5) / (n_clean + 1))
    positive = positive[np.argsort(-count[positive, 0], kind="stable")]
    negative = np.setdiff1d(np.flatnonzero((count[:, 1] > 0) & (odds < 1)), positive)
    rng = np.random.default_rng(11)
    every_positive = [np.frombuffer(names[i], np.uint8) for i in positive]
    hidden: list[np.ndarray] = []
    some = np.argsort(mix(hashes_of(names[negative])), kind="stable")[:hashed]
    chosen = list(dict.fromkeys([*negative[np.argsort(-count[negative, 1], kind="stable")[:frequent]], *negative[some]]))
    lengths = np.char.str_len(names[negative])
    pool = [(m := negative[lengths == length], names[m].view(np.uint8).reshape(-1, WINDOW)[:, :length]) for length in np.unique(lengths)]
    model, hard, stress = Model(None, _MIN_SCORE), [], {}
    for number in range(rounds):
        neg = [np.frombuffer(names[i], np.uint8) for i in chosen]
        every, first = [*every_positive, *hidden, *neg], len(every_positive) + len(hidden)
        weight = np.where(np.arange(len(every)) < len(every_positive), 6.0, 1.0)
        weight[:first] /= weight[:first].sum()
        weight[first:] = 4 / max(1, len(neg)) * np.array([stress.get(i, 1.0) for i in chosen])
        spot = {i: first + j for j, i in enumerate(chosen)}
        marks = [*range(min(len(every_positive), landmarks // 2)), *(spot[i] for i in hard if i in spot), *range(first, len(every), max(1, len(neg) // 64))]
        model = train_words(every, np.arange(len(every)) < first, weight, np.array(list(dict.fromkeys(marks))[:landmarks]))
        scored = sorted(((m[j], f[j]) for m, s in pool for f in [model.margins(s)] for j in np.flatnonzero(f > -0.3)), key=lambda p: (-p[1], p[0]))
        hard = list(dict.fromkeys([*(i for i, _ in scored), *hard]))
        new = [i for i, _ in scored if i not in spot]
        if number and not new and (not scored or scored[0][1] < 0):
            break
        for i, f in scored:
            stress[i] = stress.get(i, 1.0) * (4.0 if f > 0 else 1.0)  # one clean word among many toxic neighbours must count for as much as they do
        chosen += new[:added]
        if not number:
            near = Kernel(every_positive).rows([np.frombuffer(names[i], np.uint8) for i in hard[:probes]]).max(0, initial=0)
            hidden = [w for s, k in zip(every_positive, near) if k < NEAR for w in disguises(s, rng)]
    model.longest = longest
    return model


def hashes_of(names: np.ndarray) -> np.ndarray:
    out = np.zeros(len(names), np.uint64)
    for b in names.view(np.uint8).reshape(-1, WINDOW).T.astype(np.uint64):
        out = np.where(b > 0, out * np.uint64(1099511628211) + b + np.uint64(1), out)
    return out


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model from at most fit_rows labelled documents of each class, whole."""
    rows = sampled_texts(docs, label_sample(docs, labels, "toxic", fit_rows)).select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    if not rows:
        return Model(None, _MIN_SCORE)
    return calibrated(pa.array([r.text for r in rows], pa.large_string()), np.array([r.label for r in rows]))


def calibrated(column: pa.Array, toxic: np.ndarray, clean_weight: float = 5.0) -> Model:
    """A model of all texts, with the threshold that does best for a model of two thirds on the other third: a clean text lost counts clean_weight times a toxic one kept."""
    toxic = np.asarray(toxic, bool)
    held = np.zeros(len(toxic), bool)
    for c in (True, False):
        held[np.flatnonzero(toxic == c)[::3]] = True
    model = fit(column.filter(pa.array(~held)), toxic[~held])
    if model.weights is None:
        return model
    found = [score_texts(model, part.column(0)) for part in slices(pa.RecordBatch.from_arrays([column.filter(pa.array(held))], ["text"]), "text")]
    score, has = (np.concatenate([f[k] for f in found]) for k in (0, 3))
    score, y = score[has], toxic[held][has]
    order = np.argsort(score, kind="stable")
    score, y = score[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    wrong = 1 - np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum())
    loss = missed + clean_weight * wrong
    low, high = np.concatenate([[score[0] - 1], score]), np.concatenate([score, [score[-1] + 1]])
    # of the cuts that do best, the one nearest to the model's own zero, a little above the score below it
    best = np.flatnonzero(np.isclose(loss, loss.min()))
    cuts = np.clip(0.0, low[best] + np.minimum(0.2, (high - low)[best] / 2), high[best])
    final = fit(column, toxic)
    if final.weights is None:
        return model
    final.bias -= max(0.0, cuts[np.argmin(np.abs(cuts))])
    return final


def score_texts(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: worst score, sentences, toxic sentences, and whether it has a word."""
    docs = Words(column)
    n = docs.texts
    worst = np.full(len(docs.sentence_owner), _MIN_SCORE if model.weights is None else model.bias)
    if model.weights is not None:
        for strings, sentence in chain(docs.items, docs.joined(model.longest)):
            unique, back = _unique(strings)
            np.maximum.at(worst, sentence, model.margins(unique)[back])
    total = np.bincount(docs.sentence_owner, minlength=n)
    bad = np.bincount(docs.sentence_owner, worst > 0, n).astype(np.int64)
    score = np.full(n, -np.inf)
    np.maximum.at(score, docs.sentence_owner, worst)
    return np.round(score, 6), total, bad, total > 0


def scorer(model: Model):
    """Column function: text to struct<score, sentences, toxic_sentences>."""

    def run(column: pa.Array) -> pa.Array:
        score, total, bad, has = score_texts(model, column)
        return pa.StructArray.from_arrays([pa.array(score, mask=~has), pa.array(total.astype(np.int32)), pa.array(bad.astype(np.int32))], ["score", "sentences", "toxic_sentences"])

    return text_udf(run, "struct<score: double, sentences: int, toxic_sentences: int>")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, sentences, toxic_sentences, toxic) for each row of docs (doc_id, text)."""
    slim = docs.select("doc_id", "text")
    scored = slim.select("doc_id", scorer(train(slim, labels, fit_rows))(F.col("text")).alias("s"))
    return scored.select("doc_id", "s.*", F.coalesce(F.col("s.score") > 0, F.lit(False)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    (name,) = free(docs.columns, "scored")
    scored = docs.withColumn(name, scorer(train(docs.select("doc_id", "text"), labels, fit_rows))(F.col("text")))
    return scored.where(~F.coalesce(F.col(name)["score"] > 0, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])
