"""The reference-shaped tables as views over the star-schema Parquet files.

A table is read with its columns named, so scans prune and filters push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchmill.functions import columns as C

AS_OF = "2024-02-05 00:00:00"
WINDOW_DAYS = 30
CONTENT_TYPES = ("guide", "reference", "tutorial", "api", "blog")
CADENCES = (12, 48, 168, 336, 720, 1440)
QUEUE_STATUSES = ("pending", "processing", "done", "failed", "skipped")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index) -> F.Column:
    """values[index % n], with literals."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _keyed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    k = F.get_json_object("props", "$.k")
    return e.withColumn("k", k).withColumn("search_id", F.concat(F.col("user_id").cast("string"), F.lit(":"), k))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_id, session_id, query, results_count, latency_ms, created_at: the first view event of each search."""
    first = F.min_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id"))
    e = _keyed(spark, sf_dir, "view").groupBy("search_id", "user_id", "k").agg(first.alias("f"))
    return e.select(
        "search_id",
        F.col("user_id").alias("session_id"),
        F.when(F.col("k") == "0", F.lit("")).otherwise(F.concat(F.lit("q"), "k")).alias("query"),
        (F.floor("f.value").cast("bigint") % 5).alias("results_count"),
        F.col("f.value").alias("latency_ms"),
        F.col("f.ts").alias("created_at"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, "click").select(
        "event_id",
        "search_id",
        (F.col("event_id") % 200).alias("clicked_document_id"),
        (F.col("event_id") % 10 + 1).alias("result_rank"),
        F.col("ts").alias("created_at"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table of the reference's shape; body is the whole cleaned text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    body = C.clean_text(F.col("text"))
    age = F.make_dt_interval((i % 120).cast("int"))
    d = d.withColumn("body", body)
    return d.select(
        i.alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), i.cast("string")).alias("url"),
        F.concat("source", F.lit(".example.com")).alias("domain"),
        F.col("source").alias("source_slug"),
        pick(CONTENT_TYPES, i).alias("content_type"),
        F.when(i % 2 == 0, F.lit("")).otherwise(F.concat("lang", F.lit(" > "), "source")).alias("section_path"),
        F.substring("body", 1, 60).alias("title"),
        F.filter(F.array(F.substring("body", 181, 40), F.substring("body", 221, 40)), lambda h: h != "").alias("headings"),
        F.concat(F.lit("Source "), F.substring("source", 4, 10)).alias("source_name"),
        F.substring("body", 61, 120).alias("meta_description"),
        "body",
        F.col("lang").alias("language"),
        F.array("lang", F.concat(F.lit("t"), (i % 8).cast("string"))).alias("tags"),
        F.sha2("text", 256).alias("content_hash"),
        C.word_count(F.col("body")).alias("word_count"),
        (i % 3).cast("int").alias("code_block_count"),
        (F.substring("source", 4, 10).cast("int") % 11).cast("double").alias("authority"),
        (i % 4).cast("int").alias("depth"),
        F.when(i % 10 == 0, F.lit("index_failed")).otherwise(F.lit("indexed")).alias("status"),
        (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval((i % 365).cast("int"))).alias("published_at"),
        (as_of() - age).alias("last_updated_at"),
        (as_of() - age).alias("last_crawled_at"),
    )


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    score = C.boost_score(F.col("title"), F.col("meta_description"), F.col("word_count"), F.col("code_block_count"), F.col("section_path"), F.col("depth"), F.col("authority"))
    return d.withColumn("boost_score", score)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    i = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("src"), i.cast("string")).alias("slug"),
        F.col("n_name").alias("name"),
        (i % 11).cast("double").alias("authority_weight"),
        pick(CADENCES, i).alias("crawl_cadence_hours"),
        pick(("healthy", "crawling", "failing", "seeded"), i).alias("crawl_status"),
        F.concat(F.lit("about "), F.lower("n_name")).alias("description"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.col("page_id")
    at = F.lit("2024-02-04 23:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(i % 120).cast("int"))
    status = pick(QUEUE_STATUSES, i)
    return p.select(
        i.alias("id"),
        "url",
        C.normalize_url(F.col("url")).alias("normalized_url"),
        C.extract_domain(F.col("url")).alias("domain"),
        (i % 4).cast("int").alias("depth"),
        F.concat(F.lit("src"), (i % 7).cast("string")).alias("source_slug"),
        status.alias("status"),
        (i % 5 * 10).cast("int").alias("priority"),
        (i % 5).cast("int").alias("retry_count"),
        at.alias("scheduled_at"),
        F.when(i % 5 >= 2, at + F.expr("interval 5 minutes")).alias("processed_at"),
    )


def crawl_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.col("page_id")
    code = F.when(i % 5 <= 1, F.lit(200)).when(i % 5 == 2, F.lit(404)).when(i % 5 == 3, F.lit(500))
    return p.select(i.alias("id"), "url", code.alias("status_code"), (i % 400).cast("int").alias("response_time_ms"), F.when(code.isNull(), F.lit("connection reset")).alias("error_message"))
