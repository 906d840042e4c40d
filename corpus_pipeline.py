"""A corpus pipeline: poor documents go, toxic ones go, one of each near-copy group stays, the rest is packed.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and
returns a DataFrame; `run` writes each result as Parquet in the session's
spark.checkpoint.dir and gives it to the next. All but the last return the
columns of documents, whatever they are. The stages' cases (nulls, empty and
long texts, ties, repeated rows, empty tables, clashing names) are those of the
operators, in their modules: without labels nothing is rejected but texts without
words, and no documents give no rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from searchmill.llm import minhash, packing, quality, toxicity
from searchmill.llm.shared import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry score keeps."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic sentence."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, position) of all that is left."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # trained models, MinHash and packing are beyond SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="searchmill-")
    base = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
