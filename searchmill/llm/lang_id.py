"""Language identification by compression with one dictionary for each language.

A text is cut into blocks of BLOCK bytes (all of it, none left out), each block
is encoded by zstandard with the raw-content dictionary of each language, and the
language whose blocks are smallest in sum wins. If the runner-up is closer than
MARGIN of the plain size, and always if the text is blank, the answer is null.

Cases. A null, empty or white text has no language, margin or sizes (null). A
null doc_id is classified like any other. Repeated rows are classified each.
Equal sizes are a tie, hence rejected. Training rows whose lang, text or doc_id is
null are left out, and rows that repeat an id and language train once; without any
language everything is rejected, with only one everything with words gets it, at the
full margin. Very long texts are encoded whole, block by block. No documents give no
rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_udf
from .textbytes import WHITE, text_bytes

FIT_ROWS = 64  # documents of each language that training reads, at most
DICTIONARY = 64 << 10  # bytes of each dictionary, shared out among them
FIT_TEXT = 16 << 10  # characters of each of them that training reads, at most, from the middle
BLOCK = 4096  # bytes encoded at a time
LEVEL = 3
MARGIN = 0.01

KIND = "struct<lang: string, margin: double, bytes: bigint>"


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, size: int = DICTIONARY) -> dict[str, bytes]:
    """A raw-content dictionary for each language in docs (doc_id, text, lang), from at most fit_rows documents of each.

    The documents with the least hashes are taken, by ids first, so that ranking
    moves no text; of rows with one id and language the least text. What comes to the
    driver is bounded by fit_rows and FIT_TEXT for each language. All of them are in
    the dictionary, as `shared_out` says.
    """
    ids = docs.where("doc_id is not null and lang is not null and text is not null").select("lang", "doc_id").distinct()
    ranked = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    sample = ranked.where(F.col("n") <= fit_rows).select("lang", "doc_id")
    middle = F.expr(f"substring(text, greatest(1, cast((length(text) - {FIT_TEXT}) / 2 as int)), {FIT_TEXT})")
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), ["doc_id", "lang"]).select("lang", "doc_id", middle.alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect(), key=lambda r: (r.lang, r.doc_id)):
        if r.text and r.text.strip():
            texts.setdefault(r.lang, []).append(r.text.encode())
    made = {k: shared_out(v, size) for k, v in texts.items()}
    return {k: v for k, v in made.items() if len(v) >= 8}


def shared_out(texts: list[bytes], size: int) -> bytes:
    """All texts in order, a line each, in at most `size` bytes. Longer ones are cut to the largest equal share that fits, from their middle, between characters."""
    low, high = 1, size
    while low < high:  # the largest share; the sum grows with it
        share = (low + high + 1) // 2
        low, high = (share, high) if sum(min(len(t), share) + 1 for t in texts) <= size else (low, share - 1)
    out = []
    for t in texts:
        start = (len(t) - low) // 2 if len(t) > low else 0
        out.append(t[start : start + low].decode("utf-8", "ignore").encode())
    return b"\n".join(out) + b"\n"


class Classifier:
    made: dict[int, Classifier] = {}

    def __init__(self, dictionaries: dict[str, bytes], level: int):
        import zstandard as z

        self.names = sorted(dictionaries)
        self.encoders = []
        for name in self.names:
            d = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.encoders.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    @classmethod
    def of(cls, dictionaries: dict[str, bytes], level: int) -> Classifier:
        key = hash((level, *sorted(dictionaries.items())))
        if key not in cls.made:
            cls.made[key] = cls(dictionaries, level)
        return cls.made[key]

    def sizes(self, text: memoryview) -> np.ndarray:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return np.array([sum([len(f(b)) for b in blocks]) for f in self.encoders])


def classify_udf(dictionaries: dict[str, bytes], margin: float = MARGIN, level: int = LEVEL):
    """Column function: text to struct<lang, margin, bytes>; bytes is the smallest encoded size."""

    def run(column: pa.Array) -> pa.Array:
        n = len(column)
        data, offsets = text_bytes(column)
        lang: list[str | None] = [None] * n
        gap: list[float | None] = [None] * n
        best: list[int | None] = [None] * n
        inked = np.concatenate([[0], np.cumsum(~WHITE[data])])
        has = inked[offsets[1:]] > inked[offsets[:-1]]
        if dictionaries and has.any():
            c = Classifier.of(dictionaries, level)
            whole = memoryview(np.ascontiguousarray(data))
            for i in np.flatnonzero(has):
                sizes = c.sizes(whole[offsets[i] : offsets[i + 1]])
                order = np.argsort(sizes, kind="stable")
                best[i] = int(sizes[order[0]])
                gap[i] = 1.0 if len(order) == 1 else round(float(sizes[order[1]] - sizes[order[0]]) / float(offsets[i + 1] - offsets[i]), 6)
                if gap[i] >= margin:
                    lang[i] = c.names[order[0]]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(gap, pa.float64()), pa.array(best, pa.int64())], ["lang", "margin", "bytes"])

    return text_udf(run, KIND)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, margin, bytes) for each row of docs (doc_id, text, lang); lang is the answer, null if rejected."""
    f = classify_udf(train(docs, fit_rows), margin)
    return docs.select("doc_id", f(F.col("text")).alias("s")).select("doc_id", "s.*")
