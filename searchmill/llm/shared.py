"""What the operators share: lineage cuts, free column names, whole-text UDFs, bounded label samples."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .textbytes import slices

BATCH_BYTES = 4 << 20
FIT_CHARS = 100_000  # longer texts don't train
WORD = r"[^\s\x1c-\x1f]"  # what a text with a word matches
TOKENIZERS = "/opt/tokenizers"  # read by the driver only; executors get the bytes with the closure


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a
    temporary folder serves in local mode; a cluster must name its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="searchmill-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def need_integer(df: DataFrame, name: str) -> None:
    """TypeError unless the column holds integers."""
    kind = df.schema[name].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{name} must be an integer column, not {kind.simpleString()}")


def free(taken, *wanted: str) -> list[str]:
    """Column names like the wanted ones that don't occur in `taken` (case is ignored)."""
    low = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def bound_batches() -> None:
    """Arrow batches of BATCH_BYTES, unless the session names a size of its own: ten thousand texts at a time would take what memory their lengths ask for."""
    conf = SparkSession.active().conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864"):  # Spark's default
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_udf(fn: Callable[[pa.Array], pa.Array], kind: str, pinned: bool = False) -> Callable[[Column], Column]:
    """A column function that gives fn whole texts, some half megabyte at a time.

    pinned: filters on the result stay above it and what is below stays below, so
    that it is never moved under a join which leaves it fewer rows.
    """
    bound_batches()

    def run(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [fn(part.column(0)) for part in slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else fn(column)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, kind)
    return udf.asNondeterministic() if pinned else udf


def probably(ids: DataFrame, name: str = "doc_id", most: int = 1 << 20) -> Callable[[DataFrame, Column], DataFrame]:
    """A function (df, id) that adds to df a column `name`_in: false for rows whose id isn't among `ids`, true for those that are, and for some others.

    The ids are bits of one table, 16 for each id while they fit into `most` rows of
    64, so what is broadcast never exceeds `most` rows (16 MB), however many ids there
    are; with more of them more rows pass, all in the end. What passes must be
    decided exactly; what doesn't needn't move.
    """
    n = max(1, ids.count())
    rows = min(most, max(64, 1 << (n // 4).bit_length()))
    key = lambda c: F.pmod(F.shiftrightunsigned(F.xxhash64(c, F.lit(17)), 6), F.lit(rows))
    bit = lambda c: (F.xxhash64(c, F.lit(17)).bitwiseAND(F.lit(63))).cast("int")
    c = F.col(name)
    bits = ids.select(key(c).alias("_at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(c)).alias("_bits")).groupBy("_at").agg(F.bit_or("_bits").alias("_bits"))

    def mark(df: DataFrame, column: Column) -> DataFrame:
        at, found, flag = free(df.columns, "_at", "_bits", f"{name}_in")
        table = F.broadcast(bits.select(F.col("_at").alias(at), F.col("_bits").alias(found)))
        hit = F.call_function("shiftright", F.col(found), bit(column)).bitwiseAND(F.lit(1)) == 1
        columns = [F.col(f"`{x}`") for x in df.columns]
        return df.join(table, key(column) == F.col(at), "left").select(*columns, F.coalesce(hit, F.lit(False)).alias(flag))

    return mark


def label_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label): for each of the classes 0 and 1 up to per_class ids that occur in docs.

    The ids with the smallest hashes are taken, so the sample doesn't depend on
    the order of rows. An id with contradictory labels counts as 1. Rows whose
    id or label is null are left out.
    """
    lab = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    parts = [lab.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def sampled_texts(docs: DataFrame, sample: DataFrame, text: str = "text", chars: int = FIT_CHARS) -> DataFrame:
    """(doc_id, label, text) of the sampled ids, one row each: of rows with one id the least text, of those of at most `chars` characters.

    So what a driver collects is bounded by rows and bytes, however often an id
    occurs and however long its texts are. The sample is bounded and is broadcast.
    """
    rows = docs.select("doc_id", F.col(text).alias("text")).where(F.length("text") <= chars).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
