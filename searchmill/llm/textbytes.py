"""Whole-batch text primitives over Arrow string buffers.

Every function works on the concatenated UTF-8 bytes of many texts at once, so
that the per-word cost is a few numpy passes and not a Python loop.  Texts are
never cut: a slice holds whole texts only, however long one of them is.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10  # working set of one numpy pass; a longer text is a slice by itself

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

# ASCII white space, with the separators that Python's str.split() knows.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WHITE_TABLE = WHITE.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits are all well mixed."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
NAMED = 15  # bytes of the longest span that is its own name
_KEY = b"spans"


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each piece holds about `limit` bytes of text."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)])
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(before, before[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def span_names(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves that tell spans of positive length apart.

    Up to NAMED bytes they are the bytes themselves and the length, so different
    spans never agree. A longer span has 120 bits of its keyed BLAKE2 digest, of
    which nobody knows how to make two agree.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    at = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    low = at[starts] & _MASK[np.minimum(lengths, 8)]
    high = lengths.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(lengths > 8)
    if len(more):
        size = lengths[more]
        high[more] |= at[starts[more] + 8] & _MASK[np.minimum(size - 8, 7)]
        long = more[size > NAMED]
        if len(long):
            whole = memoryview(np.ascontiguousarray(data))
            digests = b"".join([blake2b(whole[a : a + n], digest_size=16, key=_KEY).digest() for a, n in zip(starts[long].tolist(), lengths[long].tolist())])
            halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
            low[long], high[long] = halves[:, 0], halves[:, 1] | np.uint64(0xFF << 56)
    return low, high


def fold(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two halves."""
    with np.errstate(over="ignore"):
        return mix(mix(low + _ODD) ^ (high * _MIX2))


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each span of positive length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return fold(*span_names(data, starts, lengths))


def different(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different name, and for each name the number of its first; names are compared, not only their hashes."""
    _, first, back = np.unique(fold(low, high), return_index=True, return_inverse=True)
    if not (np.array_equal(low[first][back], low) and np.array_equal(high[first][back], high)):
        order = np.lexsort((low, high))
        new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
        back = np.empty(len(low), np.int64)
        back[order] = np.cumsum(new) - 1
        first = order[new]
    return first, back


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of each run of non-white bytes."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    white = np.frombuffer(data.tobytes().translate(_WHITE_TABLE), bool)
    turns = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        turns = np.concatenate([[0], turns])
    if len(turns) % 2:
        turns = np.append(turns, n)
    inner = offsets[(offsets > 0) & (offsets < n)]
    inner = np.unique(inner[~white[inner] & ~white[inner - 1]])  # texts that meet without white space between
    if len(inner):
        turns = np.sort(np.concatenate([turns, inner, inner]))
    starts = turns[::2]
    return starts, turns[1::2] - starts, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def word_names(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words in order, as two halves, and the text number of each."""
    data, offsets = text_bytes(pc.utf8_lower(column) if lower else column)
    starts, lengths, owner = words(data, offsets)
    return *span_names(data, starts, lengths), owner


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the text number of each."""
    low, high, owner = word_names(column, lower)
    return fold(low, high), owner


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (repeats included), and the text number of each.

    A text of fewer than k words, but at least one, has a single shingle of all of them.
    """
    return shingle_hashes(*word_hashes(column), len(column), k)


def shingle_hashes(hashes: np.ndarray, owner: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    if not n:
        return hashes, owner
    counts = np.bincount(owner, minlength=texts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the text's end
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = np.zeros(n, np.uint64)
            part[: max(0, n - j)] = hashes[j:] + np.uint64(j + 1) * _ODD
            part[left <= j] = 0
            total = mix(total ^ part)
    keep = (left >= k) | ((left == np.repeat(counts, counts)) & (left < k))
    return total[keep], owner[keep]


def name_digests(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes for the words at[i]:at[i+1] of each text, a keyed BLAKE2 digest of their names; None without words."""
    whole = memoryview(np.stack([low, high], 1).astype("<u8", copy=False)).cast("B") if len(low) else memoryview(b"")
    ends = (at * 16).tolist()
    return [blake2b(whole[a:b], digest_size=16, key=_KEY).digest() if a < b else None for a, b in zip(ends[:-1], ends[1:])]


def bounds(owner: np.ndarray, n: int) -> np.ndarray:
    """n+1 positions: the items of text i are bounds[i]:bounds[i+1]. owner must be sorted."""
    return np.searchsorted(owner, np.arange(n + 1))
