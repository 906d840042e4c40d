"""Exact token counts of whole texts by a byte-pair vocabulary.

The pattern that splits a text before byte pairs are merged never joins anything
to white space that follows it. So a text can be cut wherever white space begins
after something else, and its count is the sum over the pieces. Equal pieces are
encoded once for each worker process and then found by their names (`textbytes`),
which are compared in full.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

from .shared import TOKENIZERS, text_udf
from .textbytes import WHITE, bounds, different, fold, span_names, text_bytes

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
SLOTS = 20  # a worker remembers up to 2^SLOTS pieces, a newer one in place of an older one of the same slot

# last bytes of the longer white-space characters: after one of these nothing is cut
_WIDE_END = np.zeros(256, bool)
_WIDE_END[[0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]] = True


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


def encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the pieces; together they are the whole texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.concatenate([[False], _solid(data)[:-1]])
    cut = WHITE[data] & solid
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.append(starts, n))


def _solid(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character which isn't white space, for sure."""
    lead = np.concatenate([[32], data[:-1]])
    return (data > 32) & (data != 127) & ((data < 128) | ~_WIDE_END[data] | (lead == 0xC3))


class Counter:
    """Counts tokens of many texts; one for each worker process and vocabulary."""

    made: dict[int, Counter] = {}

    def __init__(self, data: bytes):
        self.encode = encoding(data).encode_ordinary
        ranks = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, data.splitlines())}
        self.size = np.array([ranks.get(i, 0) for i in range(max(ranks) + 1)])  # bytes of each token
        self.low, self.high, self.counted = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)

    @classmethod
    def of(cls, data: bytes) -> Counter:
        key = hash(data)
        if key not in cls.made:
            cls.made[key] = cls(data)
        return cls.made[key]

    def counts(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        starts, lengths = pieces(data, offsets)
        low, high = span_names(data, starts, lengths)
        slots = (fold(low, high) >> np.uint64(64 - SLOTS)).astype(np.int64)
        found = self.counted[slots].astype(np.int64)
        new = np.flatnonzero((self.low[slots] != low) | (self.high[slots] != high))
        if len(new):
            first, back = different(low[new], high[new])
            at = new[first]
            fresh = self._fresh(data, starts[at], lengths[at])
            found[new] = fresh[back]
            # of pieces that share a slot the last one stays, with its own count
            self.low[slots[at]], self.high[slots[at]], self.counted[slots[at]] = low[at], high[at], fresh
        sums = np.concatenate([[0], np.cumsum(found)])
        at = bounds(np.searchsorted(offsets, starts, "right") - 1, len(column))
        return sums[at[1:]] - sums[at[:-1]]

    def _fresh(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Counts of single pieces. Those that begin with white space and end with something else are encoded in one string."""
        whole = data.tobytes()
        out = np.zeros(len(starts), np.int64)
        joint = WHITE[data[starts]] & _solid(data)[starts + lengths - 1]
        for i in np.flatnonzero(~joint):
            out[i] = len(self.encode(whole[starts[i] : starts[i] + lengths[i]].decode()))
        mine = np.flatnonzero(joint)
        if len(mine):
            text = b"".join([whole[a : a + n] for a, n in zip(starts[mine].tolist(), lengths[mine].tolist())]).decode()
            ends = np.cumsum(self.size[np.array(self.encode(text), np.int64)])
            out[mine] = np.diff(np.searchsorted(ends, np.cumsum(lengths[mine]), "right"), prepend=0)
        return out


def count_udf(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """Column function: text to its number of tokens; 0 for an empty text, null for null."""
    data = vocabulary(folder, name)

    def run(column: pa.Array) -> pa.Array:
        return pa.array(Counter.of(data).counts(column), pa.int64(), mask=np.asarray(column.is_null()))

    return text_udf(run, "bigint")
