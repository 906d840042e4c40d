"""HTML extraction by a tree-structured graphical model over DOM nodes.

Each element is a variable: content or not. Its own features (kind of tag, text,
links, depth, place) give its potential, and each parent-child pair has a 2 x 2
potential. On a tree, one sum-product pass upward and one downward give the exact
marginal of each node. The weights maximise the conditional likelihood of
labelled pages; its gradient is what is seen less what the marginals expect.

Labelled pages are those that mark their content themselves by one `article` or
`main` element; that mark is the label, and the features don't see these tags. So
the model also serves pages without them. The extracted content is the text of the
nodes whose marginal is above 1/2, in document order, a line for each block.

Cases. A null, empty or tagless page is one root node with its text. Unclosed and
misnested tags close as browsers close them for p, li and the like; stray end
tags are ignored; from a tag on that isn't closed by the page's end, all is text.
Scripts, styles and comments have no text. Without labelled pages the marginals are
unknown (null), and the content is all visible text. A null page_id is extracted like
any other and never trains; repeated rows give equal results and train once. Very long
pages are read whole, in time in proportion to their length; beyond FIT_CHARS
characters they don't train. No pages give no rows. Columns other than page_id and
html aren't read.
"""

from __future__ import annotations

import html as entities

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchmill.functions import markup

from .shared import FIT_CHARS, text_udf

FIT_PAGES = 400  # labelled pages that training reads, at most
MARKS = ("article", "main")

_RAW = frozenset("script style noscript template textarea svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
_HEAD = frozenset(("head", "title", "meta", "link", "base"))
_KIND = {t: k for k, ts in enumerate((("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd"), ("a",), ("nav", "footer", "header", "aside", "form", "button", "menu"), ("table", "tr", "td", "th", "tbody"), tuple(_INLINE - {"a"}), ("html", "body"), tuple(_HEAD))) for t in ts}
KINDS = 10  # the last is for all other tags, div and the marks among them
FEATURES = KINDS + 9


class Page:
    """Elements in document order: parent, tag, depth, block (the nearest that isn't inline, itself included); chunks: (element, text) in document order."""

    __slots__ = ("parent", "tag", "depth", "block", "chunks", "_stack", "_where")

    def __init__(self, source: str):
        self.parent, self.tag, self.depth, self.block = [-1], ["#root"], [0], [0]
        self.chunks: list[tuple[int, str]] = []
        self._stack = [0]  # open elements
        self._where: dict[str, list[int]] = {"#block": [0]}  # places in the stack of each tag, and of all that aren't inline
        for kind, text, _ in markup.tokens(source, _RAW):
            if kind == "raw" or kind == "open" and text in _RAW:
                continue
            if kind == "text":
                if not text.isspace():
                    self.chunks.append((self._stack[-1], text))
            elif kind == "close":
                self._end(text)
            else:
                self._start(text, kind == "open")

    def _start(self, name: str, stays: bool) -> None:
        if name in _P_ENDERS:
            self._close(("p",), ("table", "td", "th", "button", "article", "section", "div"))
        if name in _CLOSES:
            self._close(_CLOSES[name], _SCOPE.get(name, ()))
        above = self._stack[-1]
        self.parent.append(above)
        self.tag.append(name)
        self.depth.append(self.depth[above] + 1)
        self.block.append(self.block[above] if name in _INLINE else len(self.tag) - 1)
        if stays and name not in _VOID:
            self._where.setdefault(name, []).append(len(self._stack))
            if name not in _INLINE:
                self._where["#block"].append(len(self._stack))
            self._stack.append(len(self.tag) - 1)

    def _last(self, names) -> int:
        """Place in the stack of the innermost of these; 0 for none."""
        return max((w[-1] for w in map(self._where.get, names) if w), default=0)

    def _pop(self, place: int) -> None:
        while len(self._stack) > place:
            name = self.tag[self._stack.pop()]
            self._where[name].pop()
            if name not in _INLINE:
                self._where["#block"].pop()

    def _close(self, names, scope) -> None:
        place = self._last(names)
        if place and place > self._last(scope):
            self._pop(place)

    def _end(self, name: str) -> None:
        place = self._last((name,))
        if place and (name not in _INLINE or place > self._where["#block"][-1]):
            self._pop(place)

    def label(self) -> np.ndarray | None:
        """1 for each element inside the one marked element, itself included; None unless there is just one."""
        inside = [-1] * len(self.tag)  # the outermost mark around each element
        for i, t in enumerate(self.tag):
            above = self.parent[i]
            inside[i] = inside[above] if above >= 0 and inside[above] >= 0 else i if t in MARKS else -1
        inside = np.array(inside)
        return (inside >= 0).astype(np.int64) if len(np.unique(inside[inside >= 0])) == 1 else None


class Forest:
    """Many pages as one forest, with features of all nodes."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.cumsum(size) - size
        self.page = np.repeat(np.arange(len(pages)), size)
        n = int(size.sum())
        base = np.repeat(self.first, size)
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, n)
        self.parent = np.where(parent >= 0, parent + base, -1)
        self.depth = np.fromiter((x for p in pages for x in p.depth), np.int64, n)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=0) + 2))
        self.levels = [order[cuts[d] : cuts[d + 1]] for d in range(len(cuts) - 1)]
        kind = np.fromiter((_KIND.get(t, KINDS - 1) for p in pages for t in p.tag), np.int64, n)
        owner = np.fromiter((f + c[0] for f, p in zip(self.first.tolist(), pages) for c in p.chunks), np.int64)
        chars = np.bincount(owner, np.fromiter((len(c[1]) for p in pages for c in p.chunks), np.float64), n)
        stops = np.bincount(owner, np.fromiter((c[1].count(".") + c[1].count(",") for p in pages for c in p.chunks), np.float64), n)
        total, links, under = chars.copy(), np.where(kind == 3, chars, 0.0), np.ones(n)
        for level in self.levels[:0:-1]:
            for values in (total, links, under):
                np.add.at(values, self.parent[level], values[level])
            inside = level[kind[level] == 3]
            links[inside] = total[inside]
        x = np.zeros((n, FEATURES))
        x[np.arange(n), kind] = 1
        x[:, KINDS] = 1
        x[:, KINDS + 1] = np.log1p(chars) / 5
        x[:, KINDS + 2] = np.log1p(total) / 5
        x[:, KINDS + 3] = links / np.maximum(total, 1)
        x[:, KINDS + 4] = 10 * stops / np.maximum(chars, 10)
        x[:, KINDS + 5] = np.minimum(self.depth, 20) / 10
        x[:, KINDS + 6] = (np.arange(n) - base) / np.repeat(np.maximum(size, 1), size)
        x[:, KINDS + 7] = np.log1p(total / under) / 5
        x[:, KINDS + 8] = total / np.maximum(total[base], 1)
        self.x = x

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(content) of each node, P(parent, child) of each node that has a parent, and the log partition sum."""
        n = len(self.x)
        up = np.zeros((n, 2))
        up[:, 1] = unary
        message = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            m = np.logaddexp(pair[:, 0] + up[level, 0, None], pair[:, 1] + up[level, 1, None])
            message[level] = m
            np.add.at(up, self.parent[level], m)
        roots = self.levels[0]
        log_z = float(np.logaddexp(up[roots, 0], up[roots, 1]).sum())
        belief = up.copy()
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - message[level]
            joint = above[:, :, None] + pair[None] + up[level][:, None, :]
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint -= np.logaddexp(belief[level, 0], belief[level, 1])[:, None, None]
            both[level] = np.exp(joint)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        return p, both, log_z


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair


def fit(sources: list[str], steps: int = 150, ridge: float = 1e-3) -> Model | None:
    """The model of the pages that carry a label; None if none does."""
    pages, labels = [], []
    for s in sources:
        page = Page(s)
        y = page.label()
        if y is not None:
            pages.append(page)
            labels.append(y)
    if not pages:
        return None
    forest, y = Forest(pages), np.concatenate(labels)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[child]], y[child]), 1)
    n = len(y)
    theta = np.zeros(FEATURES + 4)
    step, moment, square = 0.3, np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for t in range(1, steps + 1):  # Adam on the exact gradient
        p, both, _ = forest.marginals(forest.x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
        grad = np.concatenate([forest.x.T @ (p - y), (both[child].sum(0) - seen).ravel()]) / n + ridge * theta
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        theta = theta - step * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def train(pages: DataFrame, fit_pages: int = FIT_PAGES, chars: int = FIT_CHARS) -> Model | None:
    """From at most fit_pages pages of at most `chars` characters that have one of the marks, those with the least hashes of page_id; of rows with one page_id the least html."""
    slim = pages.select("page_id", "html").where(F.col("page_id").isNotNull() & (F.length("html") <= chars))
    ids = slim.where(F.lower("html").rlike("<(?:article|main)[\\s>]")).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    rows = slim.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    return fit([r.html for r in sorted(rows, key=lambda r: (r.page_id, r.html))])


def extract_slice(model: Model | None, sources: list[str | None]) -> list[tuple]:
    """(content, nodes, content_nodes, confidence) of each page; None for a null page."""
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages) if pages else None
    p = None if model is None else forest.marginals(forest.x @ model.weights, model.pair)[0]
    out = []
    for k, (source, page) in enumerate(zip(sources, pages)):
        if source is None:
            out.append((None, None, None, None))
            continue
        first, n = int(forest.first[k]), len(page.tag)
        mine = None if p is None else p[first : first + n]
        blocks: list[list[str]] = []
        last = None
        sure, size = 0.0, 0
        for node, text in page.chunks:
            if page.tag[node] in _HEAD or mine is not None and mine[node] <= 0.5:
                continue
            block = page.block[node]
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
            if mine is not None:
                sure += float(mine[node]) * len(text)
                size += len(text)
        lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
        content = "\n".join(x for x in lines if x)
        out.append((content, n, None if mine is None else int((mine > 0.5).sum()), round(sure / size, 4) if size else None))
    return out


def extract_udf(model: Model | None):
    """Column function: html to struct<content, nodes, content_nodes, confidence>."""

    def run(column: pa.Array) -> pa.Array:
        rows = extract_slice(model, column.to_pylist())
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
        null = pa.array([s is None for s in cols[1]], pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["content", "nodes", "content_nodes", "confidence"], mask=null)

    return text_udf(run, "struct<content: string, nodes: int, content_nodes: int, confidence: double>")


def extract(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(page_id, content, nodes, content_nodes, confidence) for each row of pages (page_id, html)."""
    f = extract_udf(train(pages, fit_pages))
    return pages.select("page_id", f(F.col("html")).alias("s")).select("page_id", "s.*")
