"""Vector best-fit packing of documents into training sequences.

An item is a document, or a piece of one that is longer than a bin takes. It asks
for its tokens, one document, and the square of its tokens (what attention within
the document costs); a bin has a capacity of each. Items come in order of falling
length, and each goes to the open bin that fits it best in all three: by the
largest weighted dot product of what it asks for and what the bin has left
("dot"), or by the smallest weighted norm of what would be left ("norm"). If none
can take it, it opens a bin.

Documents are packed within shards of about `shard_docs` each, so that work and
memory of one task are the same at any size of the corpus.

Cases. doc_id may have any type that can be compared, and keeps it. A null text, or
one without tokens, is no item and gets no row; long texts are counted whole and cut
into pieces. A null doc_id is packed like any other. Repeated rows are packed each,
and spread over the shards like other rows. Ties between bins
go to the oldest bin, ties between items to the lesser doc_id, then to any (they
are alike). No documents give no rows. Columns other than doc_id and text aren't
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .shared import TOKENIZERS
from .tokens import count_udf

CONTEXT = 4096  # tokens of a bin
DOCS = 64  # documents, or pieces, of a bin
ATTENTION = 0.75  # sum of squared lengths, as a share of CONTEXT squared
SHARD_DOCS = 4096

SCHEMA = "piece int, n_tokens bigint, bin_id string, position int"


def pack(lengths: np.ndarray, context: int = CONTEXT, docs: int = DOCS, attention: float = ATTENTION, rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and its place there. lengths must fall and each fit an empty bin."""
    cap = np.array([context, docs, int(attention * context * context)], np.float64)
    ask = np.stack([lengths, np.ones(len(lengths)), np.asarray(lengths, np.float64) ** 2], 1) / cap
    weight = ask.mean(0) / max(ask.mean(), 1e-12) if len(ask) else np.ones(3)
    left = np.empty((3, max(1, len(lengths))))  # of the open bins, in the order of opening
    name = np.empty(max(1, len(lengths)), np.int64)
    open_bins = made = 0
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int32)
    held = np.zeros(max(1, len(lengths)), np.int32)
    least = ask[-1] if len(ask) else None  # of the shortest item: a bin that can't take it is closed
    eps = 1e-12
    for i, a in enumerate(ask):
        r = left[:, :open_bins]
        fits = (r[0] >= a[0] - eps) & (r[1] >= a[1] - eps) & (r[2] >= a[2] - eps)
        if fits.any():
            if rule == "dot":
                score = (weight * a) @ r
            else:
                score = -(weight @ (r - a[:, None]) ** 2)
            j = int(np.argmax(np.where(fits, score, -np.inf)))
        else:
            j = open_bins
            left[:, j], name[j] = 1.0, made
            made, open_bins = made + 1, open_bins + 1
        left[:, j] -= a
        bins[i], places[i] = name[j], held[name[j]]
        held[name[j]] += 1
        if (left[:, j] < least - eps).any():
            left[:, j : open_bins - 1] = left[:, j + 1 : open_bins]
            name[j : open_bins - 1] = name[j + 1 : open_bins]
            open_bins -= 1
    return bins, places


def largest_piece(context: int = CONTEXT, attention: float = ATTENTION) -> int:
    """Tokens of the longest item that an empty bin takes."""
    return max(1, min(context, int(np.sqrt(int(attention * context * context)))))


def packed(docs: DataFrame, context: int = CONTEXT, max_docs: int = DOCS, attention: float = ATTENTION, rule: str = "dot", shard_docs: int = SHARD_DOCS, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, position) of each piece of each document.

    Pieces of a document longer than a bin takes are numbered from 0; all but the
    last have largest_piece tokens. Only ids and counts are shuffled, to shards.
    """
    longest = largest_piece(context, attention)
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    rows = docs.select("doc_id", "text")
    shards = max(1, -(-rows.count() // shard_docs))
    counted = rows.select("doc_id", count_udf(folder)(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    # rows alike in both are counted before they move, and numbered after: their copies must not gather in one shard
    counted = counted.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies")).select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    shard = F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(shards)).cast("int")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["n_tokens"].to_numpy(np.int64)
        ids = frame["doc_id"]
        count = -(-n // longest)
        row = np.repeat(np.arange(len(n)), count)
        piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(n[row] - piece * longest, longest)
        if whole:  # a null came as 0: among integers pandas would make all floats
            ids = pd.Series(pd.arrays.IntegerArray(ids.to_numpy(np.int64), frame["nameless"].to_numpy(bool)))
        rank = ids.rank(method="dense", na_option="bottom").fillna(0).to_numpy(np.float64)
        order = np.lexsort((piece, rank[row], -size))
        bins, places = pack(size[order], context, max_docs, attention, rule)
        return pd.DataFrame(
            {
                "doc_id": ids.iloc[row[order]].reset_index(drop=True),
                "piece": piece[order].astype(np.int32),
                "n_tokens": size[order],
                "bin_id": [f"{key[0]}-{b}" for b in bins],
                "position": places,
            }
        )

    kind = StructType([docs.schema["doc_id"], *StructType.fromDDL(SCHEMA).fields])
    name = F.coalesce("doc_id", F.lit(0)) if whole else F.col("doc_id")
    return counted.select(name.alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "n_tokens", shard.alias("shard")).groupBy("shard").applyInPandas(run, kind)
