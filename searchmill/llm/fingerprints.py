"""Document fingerprints: one-permutation MinHash, optimally densified, in packed low-order bits.

Every shingle is hashed once. The top bits of the hash choose one of BINS bins,
the rest is its value there; a bin keeps its least value. An empty bin borrows
from a full one: it tries the bins that a hash of (bin, attempt) names, in turn,
until one is full - the same for all texts, and never a neighbour by rule. Of each
bin the BITS lowest bits are kept, packed into BINS x BITS / 8 bytes.

Two unequal values agree in b bits with chance 2^-b, so of the share m of equal
bins the estimate of the Jaccard similarity is (m - 2^-b) / (1 - 2^-b).

Cases. A text without words (null, empty, white space) has no fingerprint (null)
and no shingles; an estimate against it is null. Texts with the same words have
equal fingerprints, so repeated rows do. A null doc_id is kept. Long texts are
hashed whole. Other columns aren't read; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_udf
from .textbytes import mix, shingles

SHINGLE = 3
BINS, BITS = 256, 4


def bin_minima(hashes: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(n, bins) least values, and which of them are full."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    none = np.uint64(2**64 - 1)
    least = np.full(n * bins, none)
    place = owner * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(least, place, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(n, bins)
    return least, least != none


def densify(least: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Empty bins filled from full ones; texts without a full bin are left alone."""
    n, bins = least.shape
    out = least.copy()
    rows, cols = np.nonzero(~full & full.any(1)[:, None])
    attempt = 1
    with np.errstate(over="ignore"):
        while len(rows):
            source = (mix(cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(bins)).astype(np.int64)
            good = full[rows, source]
            out[rows[good], cols[good]] = least[rows[good], source[good]]
            rows, cols = rows[~good], cols[~good]
            attempt += 1
    return out


def pack_bits(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(n, bins) values to (n, bins * bits / 8) bytes of their low bits."""
    low = (mix(values)[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(low.reshape(len(values), -1).astype(np.uint8), axis=1)


def fingerprint_udf(bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
    """Column function: text to struct<fingerprint, shingles, empty_bins>."""

    def run(column: pa.Array) -> pa.Array:
        n = len(column)
        hashes, owner = shingles(column, shingle)
        least, full = bin_minima(hashes, owner, n, bins)
        has = full.any(1)
        packed = pack_bits(densify(least, full), bits)
        width = packed.shape[1]
        size = np.where(has, width, 0)
        values = pa.py_buffer(np.ascontiguousarray(packed[has]).tobytes())
        ends = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes())
        valid = pa.py_buffer(np.packbits(has, bitorder="little").tobytes())
        prints = pa.Array.from_buffers(pa.binary(), n, [valid, ends, values])
        return pa.StructArray.from_arrays(
            [prints, pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array((~full).sum(1).astype(np.int32), mask=~has)], ["fingerprint", "shingles", "empty_bins"]
        )

    return text_udf(run, "struct<fingerprint: binary, shingles: bigint, empty_bins: int>")


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, shingles, empty_bins) for each row of docs (doc_id, text)."""
    return docs.select("doc_id", fingerprint_udf(bins, bits)(F.col("text")).alias("s")).select("doc_id", "s.*")


def similarity(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, bias taken out; within [0, 1], null if one is null."""

    def equal(x: pa.Array, y: pa.Array) -> pa.Array:
        null = np.asarray(x.is_null()) | np.asarray(y.is_null())
        here = pa.array(~null)
        p, q = (np.frombuffer(b"".join(v.filter(here).to_pylist()), np.uint8).reshape(-1, bins * bits // 8) for v in (x, y))
        apart = np.unpackbits(p ^ q, axis=1).reshape(len(p), bins, bits).any(2)
        share, chance = 1 - apart.mean(1), 2.0**-bits
        out = np.zeros(len(x))
        out[~null] = np.clip((share - chance) / (1 - chance), 0, 1)
        return pa.array(out, mask=null)

    equal.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(equal, "double")(a, b)
