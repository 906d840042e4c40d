"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The piece lattice of a text has an edge for each vocabulary piece at each place,
and for characters that no piece covers one edge for each byte. An edge of piece
p weighs rank(p)^-alpha. The forward pass sums the weight of all paths to each
place; the backward pass draws a path from the end, each edge with its exact
share. Draws are hashes of (seed, row key, word, step), so a row's segmentation
is the same on every run, wherever it is computed.

No piece goes on after its space run has ended and another begins, so the lattice
splits at such places (and at bytes that occur in no longer piece) without losing
a path. A worker does the forward pass once for each different word, and keeps what
it found; words are told apart by their names (`textbytes`), never by a hash alone.
All sums are taken within a place, in integers, and draws are compared with integer
thresholds of 32 bits, so neither the batch nor the words seen before can change one.

Cases. A null text gives null, an empty one no pieces; decoding gives both back.
A null row key draws like a key of its own. Rows with equal key and text get equal
pieces. The row key is the doc_id where that is an integer, else a hash of it. A literal lower one eighth block, which the vocabulary uses for the space,
is encoded by its bytes, so it survives. Texts are encoded whole. Columns other
than doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import TOKENIZERS
from .textbytes import different, fold, mix, slices, span_names, text_bytes

MODEL = "piece_bpe_32k.model"
ALPHA = 1.5
SEED = 1
SLICE = 1 << 20
SLOTS = 18  # a worker finds up to 2^SLOTS words again
POOL = 5 << 20  # edges that a worker keeps before it starts anew
_BASE = np.uint64(0x100000001B3)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def vocabulary(folder: str = TOKENIZERS, name: str = MODEL) -> tuple[list[bytes], list[float]]:
    """Bytes and rank of each piece, read on the driver; a space stands for the block character. Bytes pieces have rank -1, controls b""."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")
    pieces, ranks = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
            ranks.append(0.0)
        elif sp.is_byte(i):
            pieces.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
            ranks.append(-1.0)
        else:
            pieces.append(sp.id_to_piece(i).replace("▁", " ").encode())
            ranks.append(max(0.0, -sp.get_score(i)))
    return pieces, ranks


class Lattice:
    """The vocabulary as arrays; made once for each worker process."""

    made: dict[int, Lattice] = {}

    def __init__(self, pieces: list[bytes], ranks: list[float], alpha: float):
        self.bytes_of = np.frombuffer(b"".join(pieces), np.uint8)
        self.size_of = np.array([len(p) for p in pieces])
        self.start_of = np.cumsum(self.size_of) - self.size_of
        rank = np.array(ranks)
        self.weight = -alpha * np.log(np.maximum(rank, 0) + 1)
        self.weight[rank < 0] = -alpha * np.log(len(pieces) + 1)
        self.byte_piece = np.full(256, -1)
        for i in np.flatnonzero(rank < 0):
            self.byte_piece[pieces[i][0]] = i
        plain = [i for i, p in enumerate(pieces) if p and rank[i] >= 0]
        self.longest = max((len(pieces[i]) for i in plain), default=1)
        self.solo = np.ones(256, bool)  # bytes below 128 that occur in no piece of several bytes
        self.solo[128:] = False
        for i in plain:
            if len(pieces[i]) > 1:
                self.solo[list(pieces[i])] = False
        self.solo[32] = False
        whole, begun, seen = [], set(), {b"": 0}
        for i in plain:
            for k in range(1, len(pieces[i]) + 1):
                start = pieces[i][:k]
                if start not in seen:
                    seen[start] = (seen[start[:-1]] + start[-1] + 1) * int(_BASE) & (2**64 - 1)
                begun.add(seen[start])
            whole.append(seen[pieces[i]])
        whole, begun = np.array(whole, np.uint64), np.array(sorted(begun), np.uint64)
        self.begins = np.zeros(1 << 22, bool)  # by hash: what may go on to a piece
        self.begins[self._begin(begun)] = True
        # two tables by hash: where pieces clash in the first, the later goes to the second
        self.bits = 20
        for salt in range(1, 1000):
            self.salt = np.uint64(salt * 2 + 1)
            names = [np.full(1 << self.bits, 0, np.uint64), np.full(1 << self.bits, 0, np.uint64)]
            ids = [np.full(1 << self.bits, -1, np.int32), np.full(1 << self.bits, -1, np.int32)]
            done = True
            for i, h, one, two in zip(plain, whole, *(x.tolist() for x in self._slots(whole))):
                for t, slot in ((0, one), (1, two)):
                    if ids[t][slot] < 0:
                        names[t][slot], ids[t][slot] = h, i
                        break
                else:
                    done = False
                    break
            if done:
                break
        self.names, self.ids = names, ids
        self.low, self.high = np.zeros(len(pieces), np.uint64), np.zeros(len(pieces), np.uint64)
        some = np.flatnonzero(self.size_of > 0)
        self.low[some], self.high[some] = span_names(self.bytes_of, self.start_of[some], self.size_of[some])
        self._clear()

    def _clear(self) -> None:
        """Forgets all words. From first[i] on are the edges that end in place i: how far back each goes, its piece, and the last of 2^32 draws that takes it, which for the last edge is the last of all."""
        self.places = self.held = 0
        self.first, self.back, self.piece, self.last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint32)
        self.slot_low, self.slot_high, self.slot_head = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int64)

    def heads(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The place before each word; words not known yet are put in."""
        if self.held > POOL:
            self._clear()
        low, high = span_names(data, starts, lengths)
        slots = (fold(low, high) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.slot_head[slots]
        new = np.flatnonzero((self.slot_low[slots] != low) | (self.slot_high[slots] != high))
        if len(new):
            first, back = different(low[new], high[new])
            at = new[first]
            size = lengths[at]
            begin = np.cumsum(size) - size
            flat = data[np.repeat(starts[at] - begin, size) + np.arange(size.sum())]
            made = self._add(flat, begin, size)
            out[new] = made[back]
            self.slot_low[slots[at]], self.slot_high[slots[at]], self.slot_head[slots[at]] = low[at], high[at], made
        return out

    def _add(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        first, back, piece, last = _forward(self, flat, begin, size)
        for name, extra, used in (("first", len(first), self.places), ("back", len(back), self.held), ("piece", len(back), self.held), ("last", len(back), self.held)):
            have = getattr(self, name)
            if len(have) < used + extra:
                more = np.zeros(max(used + extra, 2 * len(have)), have.dtype)
                more[:used] = have[:used]
                setattr(self, name, more)
        head = self.places + begin + np.arange(len(size))
        self.first[self.places : self.places + len(first)] = self.held + first
        for have, fresh in ((self.back, back), (self.piece, piece), (self.last, last)):
            have[self.held : self.held + len(back)] = fresh
        self.places, self.held = self.places + len(first), self.held + len(back)
        return head

    @classmethod
    def of(cls, pieces: list[bytes], ranks: list[float], alpha: float) -> Lattice:
        key = hash((alpha, len(pieces), b"\0".join(pieces)))
        if key not in cls.made:
            cls.made[key] = cls(pieces, ranks, alpha)
        return cls.made[key]

    @staticmethod
    def _begin(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * _A) >> np.uint64(42)).astype(np.int64)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return ((h * (_A + self.salt + self.salt)) >> np.uint64(64 - self.bits)).astype(np.int64), ((h * (_B + self.salt + self.salt)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        one, two = self._slots(h)
        found = np.where(self.names[0][one] == h, self.ids[0][one], -1)
        rest = np.flatnonzero(found < 0)
        two = two[rest]
        found[rest] = np.where(self.names[1][two] == h[rest], self.ids[1][two], -1)
        return found

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all edges; data is words end to end, ends the end of the word of each byte."""
        n = len(data)
        places, h = np.arange(n), np.zeros(n, np.uint64)
        starts, stops, found = [], [], []
        covered = np.zeros(n, bool)  # characters that a piece covers alone, at their first byte
        lead = (data & 0xC0) != 0x80
        width = np.ones(n, np.int64)
        width[data >= 0xC0], width[data >= 0xE0], width[data >= 0xF0] = 2, 3, 4
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                alive = places + size <= ends[places]
                places, h = places[alive], h[alive]
                if not len(places):
                    break
                h = (h + data[places + size - 1] + np.uint64(1)) * _BASE
                alive = self.begins[self._begin(h)]
                places, h = places[alive], h[alive]
                piece = self.find(h)
                hit = np.flatnonzero((piece >= 0) & lead[places])
                low, high = span_names(data, places[hit], np.full(len(hit), size))  # the bytes themselves decide
                hit = hit[(self.low[piece[hit]] == low) & (self.high[piece[hit]] == high)]
                starts.append(places[hit])
                stops.append(places[hit] + size)
                found.append(piece[hit])
                whole = places[hit][width[places[hit]] == size]
                covered[whole] = True
        first = np.flatnonzero(lead & ~covered)
        if len(first):
            count = np.minimum(width[first], ends[first] - first)
            at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts.append(at)
            stops.append(at + 1)
            found.append(self.byte_piece[data[at]])
        return np.concatenate(starts), np.concatenate(stops), np.concatenate(found)


def _forward(lattice: Lattice, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """For words end to end: the first edge into each place, and of the edges, those of a place together, how far back they go, their pieces and their last draws.

    Each word has one place more than bytes: that before its first. Weights are
    integers of 40 bits below the place's best.
    """
    words = np.repeat(np.arange(len(size)), size)
    a, b, piece = lattice.edges(data, (begin + size)[words])
    back, b = b - a, b + words[a]  # places
    head = begin + np.arange(len(size))
    relative = b - head[words[a]]
    order = np.argsort((relative * (len(data) + len(size)) + b) * 256 - np.minimum(back, 255), kind="stable")  # the longest piece of a place first: it is mostly the likeliest
    back, b, piece, relative = back[order], b[order], piece[order], relative[order]
    steps = np.searchsorted(relative, np.arange(1, int(size.max()) + 2))
    reach = np.full(len(data) + len(size), -np.inf)
    reach[head] = 0.0
    mass = np.zeros(len(b), np.int64)
    total = np.zeros(len(reach), np.int64)
    weight = lattice.weight[piece]
    for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist()):
        if lo == hi:
            continue
        place = b[lo:hi]
        value = reach[place - back[lo:hi]] + weight[lo:hi]
        at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        top = np.maximum.reduceat(value, at)
        top[~np.isfinite(top)] = 0.0
        part = np.floor(np.exp(value - np.repeat(top, np.diff(np.append(at, hi - lo)))) * 2.0**40).astype(np.int64)
        mass[lo:hi] = part
        here = np.add.reduceat(part, at)
        total[place[at]] = here
        with np.errstate(divide="ignore"):
            reach[place[at]] = top + np.log(here * 2.0**-40)
    # edges of a place lie together; places by step, not by number
    begins = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    first = np.zeros(len(reach), np.int64)
    first[b[begins]] = begins
    running = np.cumsum(mass)
    base = np.repeat(np.concatenate([[0], running])[begins], np.diff(np.append(begins, len(b))))
    last = np.floor((running - base) / np.maximum(total[b], 1) * 2.0**32) - 1
    last[np.append(begins[1:], len(b)) - 1] = 2.0**32 - 1
    return first, back, piece, np.maximum(last, 0).astype(np.uint32)


def encode_slice(lattice: Lattice, keys: np.ndarray, column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all texts end to end, the n+1 bounds of each, and whether each text decodes to itself."""
    n = len(column)
    raw, offsets = text_bytes(column)
    filled = np.diff(offsets) > 0
    # a space before each text that isn't empty
    data = np.empty(len(raw) + filled.sum(), np.uint8)
    shift = np.cumsum(filled)
    ends = offsets[1:] + shift
    heads = (offsets[:-1] + shift - 1)[filled]
    body = np.ones(len(data), bool)
    body[heads] = False
    data[heads] = 32
    data[body] = raw
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.ones(n, bool)
    before = np.concatenate([[0], data[:-1]])
    alone = lattice.solo[data]
    cut = ((data == 32) & (before != 32)) | alone | np.concatenate([[False], alone[:-1]])
    cut[heads] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, len(data)))
    per_text = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    row = np.repeat(np.arange(n), per_text)
    goal = lattice.heads(data, starts, lengths)
    place = goal + lengths
    with np.errstate(over="ignore"):
        rank = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        draw = mix(keys[row] + np.uint64(seed) * _A) + rank.astype(np.uint64) * _B
        active = np.arange(len(starts))
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(starts), np.int64)
        step = 0
        while len(active):
            u = (mix(draw[active] + np.uint64(step) * _A) >> np.uint64(32)).astype(np.uint32)
            edge = lattice.first[place]
            late = np.flatnonzero(u > lattice.last[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] > lattice.last[edge[late]]]
            drawn.append((active, lattice.piece[edge]))
            count[active] += 1
            place = place - lattice.back[edge]
            on = place > goal[active]
            active, place = active[on], place[on]
            step += 1
    stop = np.cumsum(count)
    out = np.empty(int(stop[-1]), np.int32)
    for step, (mine, ids) in enumerate(drawn):
        out[stop[mine] - 1 - step] = ids
    bounds = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(per_text)])]
    spelled, at = decode_flat(lattice, out, bounds)
    whole = np.diff(at) == np.diff(np.concatenate([[0], ends]))
    if not (len(spelled) == len(data) and np.array_equal(spelled, data)):
        for i in np.flatnonzero(whole):
            lo = 0 if i == 0 else ends[i - 1]
            whole[i] = np.array_equal(spelled[at[i] : at[i + 1]], data[lo : ends[i]])
    return out, bounds, whole


def decode_flat(lattice: Lattice, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the pieces end to end, and the bounds of each text in them; the space before each text is still there."""
    size = lattice.size_of[ids]
    stop = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(lattice.start_of[ids] - stop[:-1], size) + np.arange(int(stop[-1]))
    return lattice.bytes_of[place], stop[bounds]


def encode_udf(folder: str = TOKENIZERS, name: str = MODEL, alpha: float = ALPHA, seed: int = SEED):
    """Column function of (row key, text): struct<pieces: array<int>, lossless: boolean>, null for a null text."""
    pieces, ranks = vocabulary(folder, name)
    kind = pa.struct([("pieces", pa.list_(pa.int32())), ("lossless", pa.bool_())])

    def run(key: pa.Array, column: pa.Array) -> pa.Array:
        lattice = Lattice.of(pieces, ranks, alpha)
        batch = pa.RecordBatch.from_arrays([key, column], ["key", "text"])
        parts = []
        for part in slices(batch, "text", SLICE):
            keys = part.column(0).cast(pa.int64())
            null = np.asarray(keys.is_null())
            values = mix(np.asarray(pc.fill_null(keys, 0)).astype(np.int64).view(np.uint64) + np.uint64(1))
            values[null] = np.uint64(0x5EED)
            ids, bounds, whole = encode_slice(lattice, values, part.column(1), seed)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            parts.append(pa.StructArray.from_arrays([lists, pa.array(whole)], fields=list(kind), mask=part.column(1).is_null()))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"key": pa.Array, "column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<pieces: array<int>, lossless: boolean>")


def encode(docs: DataFrame, folder: str = TOKENIZERS, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(doc_id, pieces, n_pieces, lossless) for each row of docs; the pieces of each row were decoded and compared."""
    f = encode_udf(folder, MODEL, alpha, seed)
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    key = F.col("doc_id").cast("bigint") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    coded = docs.select("doc_id", f(key, F.col("text")).alias("s"))
    return coded.select("doc_id", "s.pieces", F.size("s.pieces").alias("n_pieces"), "s.lossless")


def decode(pieces: Column, folder: str = TOKENIZERS, name: str = MODEL) -> Column:
    """Text of an array of pieces; null for null. Controls stand for nothing; bytes that aren't UTF-8 become U+FFFD."""
    table, _ = vocabulary(folder, name)

    size = np.array([len(p) for p in table])
    start, joined = np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)

    def run(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.string())
        flat = column.flatten()
        known = np.asarray(flat.is_valid())
        ids = np.asarray(flat.fill_null(0)).astype(np.int64)
        long = np.where(known, size[ids], 0)
        stop = np.concatenate([[0], np.cumsum(long)])
        whole = memoryview(joined[np.repeat(start[ids] - stop[:-1], long) + np.arange(int(stop[-1]))]) if stop[-1] else memoryview(b"")
        ends = stop[np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))])].tolist()
        texts = [bytes(whole[a + (b > a and whole[a] == 32) : b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return pc.if_else(column.is_valid(), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(pieces)
