"""Sinks: document store, index, logs. Snapshots are versions side by side; logs are appended."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import lru_cache
from typing import TypeVar
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchmill.operators import search as S

T = TypeVar("T")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of that name for intermediate tables, in the session's spark.checkpoint.dir; only in local mode a temporary one serves where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="searchmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def within(spark: SparkSession, action: Callable[[], T], seconds: float, service: str) -> T:
    """The action's result; its jobs are cancelled, and TimeoutError names the service, if it takes longer."""
    sc, tag, late = spark.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"{service} service unavailable") from None
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def write_snapshot(df: DataFrame, base: str, version: str) -> str:
    """Writes a version of a table and returns its path; an existing version isn't touched."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_documents(parsed: DataFrame, base: str, version: str) -> tuple[str, str]:
    """The two tables of the store: documents, and their content by document_id."""
    content = parsed.select(F.col("id").alias("document_id"), F.lit(None).cast("string").alias("raw_html"), F.col("body").alias("clean_text"), "headings", "links", "schema_json")
    docs = parsed.drop("body", "headings", "links", "schema_json")
    return write_snapshot(docs, f"{base}/documents", version), write_snapshot(content, f"{base}/document_content", version)


def write_index(docs: DataFrame, base: str, version: str, buckets: int = 64) -> tuple[str, str]:
    """Stored fields, and postings laid out by a hash of the term, so that a query reads the buckets of its terms only.

    Rebalanced by bucket: adaptive execution writes a bucket that is larger than its
    advisory size in several tasks, so a term of most documents isn't one task's work.
    """
    stored = write_snapshot(docs, f"{base}/docs", version)
    p = S.postings(docs.sparkSession.read.parquet(stored)).withColumn("bucket", bucket(F.col("term"), buckets))
    path = f"{base}/postings/version={version}"
    p.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "id").write.mode("errorifexists").partitionBy("bucket").parquet(path)
    return stored, path


def bucket(term: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def read_postings(postings: DataFrame, terms: list[str], buckets: int = 64) -> DataFrame:
    """Postings of exactly these terms; their buckets are known before the scan, so partitions are pruned."""
    spark = postings.sparkSession
    wanted = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t"), buckets)).collect()}) if terms else []
    return postings.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))


def append(rows: DataFrame, path: str) -> None:
    """Crawl log and event rows."""
    rows.write.mode("append").parquet(path)


@lru_cache(maxsize=128)
def _rules(text: str) -> RobotFileParser:
    """A site's parsed file; a worker parses the same file once for all batches."""
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser


def allowed_by_robots(frontier: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """frontier (url, domain, ...) with allowed; robots (domain, robots) holds each site's file.

    A file that couldn't be read (null, or no row) forbids everything, an empty one nothing.
    """

    def check(url: pa.Array, rules: pa.Array) -> pa.Array:
        return pa.array([text is not None and _rules(text).can_fetch(agent, u or "") for u, text in zip(url.to_pylist(), rules.to_pylist())], pa.bool_())

    check.__annotations__ = {"url": pa.Array, "rules": pa.Array, "return": pa.Array}
    return frontier.join(robots.select("domain", "robots"), "domain", "left").withColumn("allowed", F.arrow_udf(check, "boolean")(F.col("url"), F.col("robots"))).drop("robots")
