"""MinHash near-dedup by circulant MinHash, banding and exact Jaccard.

Two documents are near copies if the Jaccard similarity of their sets of
SHINGLE-word shingles (lower case, split at white space) is at least `threshold`.
Groups are the connected components of that relation over all pairs that share a
band; each group keeps its row with the least doc_id.

Cases. A text without words (null, empty, white space) is near no other, and is
kept. Texts with the same words are one text, however often they occur, before
any comparison. A null doc_id sorts after all others. A repeated row (same
doc_id, same words) is a copy: `dedup` keeps one row of it. Two different texts
with one doc_id are two documents. Extra columns are carried along by `dedup`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import WORD, cut, free, probably, text_udf
from .textbytes import bounds, fold, mix, name_digests, shingle_hashes, word_names

SHINGLE = 3  # words
BANDS, ROWS = 40, 4  # a pair at Jaccard 0.5 shares a band with chance 0.92, at 0.6 with 0.996
THRESHOLD = 0.5
UNIVERSE = 1 << 22  # places that shingles are hashed to before the two permutations
SEED = 20240611


@lru_cache(maxsize=2)
def permutations(seed: int, size: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi extended by its own start so that every circular shift is a slice."""
    rng = np.random.default_rng(seed)
    sigma = rng.permutation(size).astype(np.uint32)
    pi = rng.permutation(size).astype(np.uint32)
    return sigma, np.concatenate([pi, pi[:coordinates]])


def circulant_signature(hashes: np.ndarray, coordinates: int, seed: int = SEED, size: int = UNIVERSE) -> np.ndarray:
    """Coordinate k is the least pi(sigma(x) + k) over the shingles x: one permutation, shifted circularly."""
    sigma, pi = permutations(seed, size, coordinates)
    windows = np.lib.stride_tricks.sliding_window_view(pi, coordinates)
    places = sigma[(hashes & np.uint64(size - 1)).astype(np.int64)]
    best = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(places), 1024):
        np.minimum(best, windows[places[start : start + 1024]].min(0), out=best)
    return best


def signature_udf(bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE):
    """Text to struct<key, bands>; null for a text without words. The key is 16 bytes of a digest of the word sequence."""
    kind = pa.struct([("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(column: pa.Array) -> pa.Array:
        n = len(column)
        low, high, owner = word_names(column)
        keys = pa.array(name_digests(low, high, bounds(owner, n)), pa.binary())
        found, owner = shingle_hashes(fold(low, high), owner, n, shingle)
        at = bounds(owner, n)
        sig = np.zeros((n, bands * rows), np.uint64)
        for i in range(n):
            if at[i] < at[i + 1]:
                sig[i] = circulant_signature(found[at[i] : at[i + 1]], bands * rows)
        hashed = np.zeros((n, bands), np.uint64)
        with np.errstate(over="ignore"):
            for r in range(rows):
                hashed = mix(hashed + sig[:, r::rows] + np.uint64(r + 1))
            hashed = mix(hashed + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        values = pa.array(hashed.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands), pa.int32()), values)
        return pa.StructArray.from_arrays([keys, lists], fields=list(kind), mask=keys.is_null())

    return text_udf(run, "struct<key: binary, bands: array<bigint>>")


def set_udf(shingle: int = SHINGLE):
    """Text to struct<key, set>: all distinct shingle hashes of the text."""

    def run(column: pa.Array) -> pa.Array:
        n = len(column)
        low, high, owner = word_names(column)
        keys = pa.array(name_digests(low, high, bounds(owner, n)), pa.binary())
        found, owner = shingle_hashes(fold(low, high), owner, n, shingle)
        at = bounds(owner, n)
        sets = [np.unique(found[at[i] : at[i + 1]]) for i in range(n)]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return pa.StructArray.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["key", "set"])

    return text_udf(run, "struct<key: binary, set: array<bigint>>", pinned=True)


def key_udf():
    """Text to the key of its word sequence; null for no words."""

    def run(column: pa.Array) -> pa.Array:
        low, high, owner = word_names(column)
        return pa.array(name_digests(low, high, bounds(owner, len(column))), pa.binary())

    return text_udf(run, "binary", pinned=True)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    least, most = F.least(F.size("set_a"), F.size("set_b")), F.greatest(F.size("set_a"), F.size("set_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(least >= most * threshold)
        .where(both >= (F.size("set_a") + F.size("set_b") - both) * threshold)
        .select("a", "b")
    )


def groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(signed, roots): signed has doc_id and key of each row, key null without words; roots has (key, root) of the keys in a group of several.

    All pairs that share a band are decided, in two rounds. In the first, each
    text is held against the least key of each of its bands. Only where a band
    still holds several groups does the second round verify all pairs of texts
    across them, so a band of thousands of copies costs thousands of pairs and
    not millions. Texts don't travel; the shingle sets of those that share a band do,
    once, and of few others (`shared.probably`).
    """
    slim = docs.select("doc_id", "text")
    signed = cut(slim.select("doc_id", signature_udf(bands, rows)(F.col("text")).alias("s")).select("doc_id", "s.key", "s.bands"))
    distinct = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    by_band = Window.partitionBy("band")
    shared = cut(
        distinct.select("key", "doc_id", F.explode("bands").alias("band"))
        .withColumns({"low": F.min("key").over(by_band), "high": F.max("key").over(by_band)})
        .where("low <> high")
        .select("band", "key", "doc_id", "low")
    )
    wanted = shared.select("doc_id", "key").distinct()
    found = probably(wanted.select("doc_id"))(slim, F.col("doc_id")).where("doc_id_in")
    sets = found.select(set_udf()(F.col("text")).alias("s")).select("s.key", "s.set")
    sets = cut(sets.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("set").alias("set")))
    first = shared.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    edges = cut(_verified(first, sets, threshold))
    roots = cut(components(edges))
    placed = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "low", F.coalesce("root", "key").alias("root"))
    mixed = cut(placed.withColumns({"r1": F.min("root").over(by_band), "r2": F.max("root").over(by_band)}).where("r1 <> r2").select("band", "key", "low", "root"))
    one, two = mixed.alias("x"), mixed.alias("y")
    across = (
        one.join(two, F.expr("x.band = y.band and x.root < y.root"))
        .where("x.key <> x.low and y.key <> y.low")  # those with the least key were verified before
        .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        .distinct()
    )
    more = cut(_verified(across, sets, threshold))
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    return signed, roots.select(F.col("node").alias("key"), "root")


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, keep) for each row; group_id is the least doc_id of the row's group, its own for a row alone.

    keep holds for the rows with that doc_id and for texts without words.
    """
    signed, roots = groups(docs, threshold)
    rooted = signed.where("key is not null").select("doc_id", "key").join(roots, "key", "left").select("doc_id", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    grouped = rooted.join(least, "root").select("doc_id", "group_id")
    alone = signed.where("key is null").select("doc_id", F.col("doc_id").alias("group_id"))
    return grouped.unionByName(alone).select("doc_id", "group_id", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("keep"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without near copies, with all their columns: of each group the row with the least doc_id, one only.

    A row whose words occur once, in no group, stays where it is. Only the others
    (and few more, see `shared.probably`) are keyed and moved, by key and id, so
    copies of one text are spread; of rows alike in both one is kept, by partial
    aggregation.
    """
    signed, roots = groups(docs, threshold)
    keys = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    rooted = cut(keys.join(roots, "key", "left").where("root is not null or n > 1").select("key", "doc_id", F.coalesce("root", "key").alias("root")))
    by_root = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "key")
    best = rooted.withColumn("place", F.row_number().over(by_root)).where("place = 1").select("key", "doc_id")
    who = lambda k, i: F.concat(k, F.encode(F.coalesce(i.cast("string"), F.lit("null")), "UTF-8"))
    doubtful = signed.join(rooted.select("key"), "key", "left_semi").select("doc_id", who(F.col("key"), F.col("doc_id")).alias("who")).distinct()
    doubtful = cut(doubtful.join(best.select(who(F.col("key"), F.col("doc_id")).alias("who"), F.lit(True).alias("best")), "who", "left"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = probably(doubtful)(docs, F.col("doc_id"))
    moves = F.col(marked.columns[-1]) & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    name, key, best, row = free(marked.columns, "name", "key", "best", "row")
    keyed = marked.where(moves).select(*columns, key_udf()(F.col("text")).alias(key)).select(*columns, who(F.col(key), F.col("doc_id")).alias(name))
    known = doubtful.select(F.col("who").alias(name), F.coalesce("best", F.lit(False)).alias(best))
    # a row that isn't known passed the mark by chance: it is in no group, and its words are its own
    kept = keyed.join(known, name, "left").where(F.coalesce(F.col(best), F.lit(True)))
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not _unhashable(f.dataType.simpleString())])
    kept = kept.groupBy(name).agg(F.min_by(F.struct(*columns), tie).alias(row)).select(f"{row}.*")
    return marked.where(~moves).select(*columns).unionByName(kept)


def _unhashable(kind: str) -> bool:
    return "map<" in kind or "variant" in kind
