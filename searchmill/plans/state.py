"""Queue and store transitions, from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchmill.operators import state as T
from searchmill.sources import seeds
from searchmill.sources import views as V

from .base import query

NOW = "TIMESTAMP '2024-02-05 00:00:00'"


def _queue(spark, d):
    """One row for each normalized URL, that with the least id."""
    q = V.queue(spark, d)
    names = [c for c in q.columns if c != "normalized_url"]
    first = q.groupBy("normalized_url").agg(F.min_by(F.struct(*names), "id").alias("q")).select("normalized_url", "q.*")
    return first.withColumns({"source_url": F.lit(None).cast("string"), "source_slug": F.when(F.col("id") % 3 > 0, F.col("source_slug"))})


SNAPSHOT = """, snap AS (SELECT * REPLACE (CASE WHEN id % 3 > 0 THEN source_slug END AS source_slug) FROM queue QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY id) = 1)"""


def _batch(spark, d):
    """For each page, its own URL again and a new one, with sources for some."""
    q, i = V.queue(spark, d), F.col("id")
    both = q.select("id", "domain", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("url").alias("u"), F.col("normalized_url").alias("n")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("https://"), "domain", F.lit("/new/"), (i % 10).cast("string")).alias("u"), F.concat(F.lit("https://"), "domain", F.lit("/new/"), (i % 10).cast("string")).alias("n")))).alias("s"))
    return both.select(
        F.col("s.u").alias("url"),
        F.col("s.n").alias("normalized_url"),
        "domain",
        (i % 3).cast("int").alias("depth"),
        F.concat(F.lit("from "), i.cast("string")).alias("source_url"),
        F.when(i % 2 == 0, F.concat(F.lit("src"), (i % 5).cast("string"))).alias("source_slug"),
        (i % 7 * 5).cast("int").alias("priority"),
        (i * 2 + F.col("s.k")).alias("arrival"),
    )


BATCH = """, batch AS (SELECT unnest([url, 'https://' || domain || '/new/' || id % 10]) AS url, unnest([normalized_url, 'https://' || domain || '/new/' || id % 10]) AS normalized_url, domain, id % 3 AS depth, 'from ' || id AS source_url,
CASE WHEN id % 2 = 0 THEN 'src' || id % 5 END AS source_slug, id % 7 * 5 AS priority, unnest([id * 2, id * 2 + 1]) AS arrival FROM queue),
b AS (SELECT normalized_url, arg_min(url, arrival) AS url, arg_min(domain, arrival) AS domain, arg_min(source_url, arrival) AS source_url, min(depth) AS depth, min(priority) AS priority, arg_min(source_slug, arrival) FILTER (WHERE source_slug IS NOT NULL) AS source_slug FROM batch GROUP BY 1)"""


@query(SNAPSHOT + BATCH + f""" SELECT coalesce(s.url, b.url) AS url, coalesce(s.normalized_url, b.normalized_url) AS normalized_url, coalesce(s.domain, b.domain) AS domain, CAST(least(s.depth, b.depth) AS INT) AS depth,
CASE WHEN s.id IS NULL THEN b.source_url END AS source_url, coalesce(s.source_slug, b.source_slug) AS source_slug, CASE WHEN s.id IS NULL OR (s.source_slug IS NULL AND b.source_slug IS NOT NULL) THEN 'pending' ELSE s.status END AS status,
CAST(least(s.priority, b.priority) AS INT) AS priority, CASE WHEN s.id IS NULL OR (s.source_slug IS NULL AND b.source_slug IS NOT NULL) THEN {NOW} ELSE s.scheduled_at END AS scheduled_at,
CASE WHEN s.id IS NOT NULL AND NOT (s.source_slug IS NULL AND b.source_slug IS NOT NULL) THEN s.processed_at END AS processed_at FROM snap s FULL JOIN b ON s.normalized_url = b.normalized_url""")
def enqueue_merge(spark, d):
    out = T.enqueue_merge(_queue(spark, d), _batch(spark, d), V.AS_OF)
    return out.select("url", "normalized_url", "domain", "depth", "source_url", "source_slug", "status", "priority", "scheduled_at", "processed_at")


@query("SELECT 'https://' || slug || '.example.com/docs' AS normalized_url, 'https://' || slug || '.example.com/docs' AS url, slug || '.example.com' AS domain, slug AS source_slug, 0 AS depth, CAST(CASE WHEN length(name) % 2 = 0 THEN 100 ELSE length(name) END AS INT) AS priority FROM registry")
def enqueue_seeds(spark, d):
    r = V.registry(spark, d)
    n = F.length("name")
    s = r.select(F.col("slug").alias("source_slug"), F.concat(F.lit("HTTPS://"), F.upper("slug"), F.lit(".example.com/docs/?utm_source=x#top")).alias("u"), F.when(n % 2 == 1, n).alias("priority"), F.substring("slug", 4, 9).cast("long").alias("arrival"))
    batch = seeds.seed_batch(s.withColumnRenamed("u", "url"))
    return batch.withColumn("url", F.col("normalized_url")).select("normalized_url", "url", "domain", "source_slug", "depth", "priority")


STORE = "id, url, title, word_count, status, last_crawled_at"
PARSED = "SELECT 'https://' || source_slug || '.example.com/' || language || '/' || id * 2 AS url, 'again ' || title AS title, word_count + 1 AS word_count, max(id) OVER () + id AS id FROM docs"


@query(f""", store AS (SELECT {STORE} FROM docs), fresh AS (SELECT 'https://' || source_slug || '.example.com/' || language || '/' || id * 2 AS url, 'again ' || title AS title, word_count + 1 AS word_count, 1000000000000 + id AS id FROM docs)
SELECT coalesce(s.id, f.id) AS id, coalesce(s.url, f.url) AS url, CASE WHEN f.url IS NULL THEN s.title ELSE f.title END AS title, CASE WHEN f.url IS NULL THEN s.word_count ELSE f.word_count END AS word_count,
CASE WHEN f.url IS NULL THEN s.status ELSE 'stored' END AS status, CASE WHEN f.url IS NULL THEN s.last_crawled_at ELSE {NOW} END AS last_crawled_at FROM store s FULL JOIN fresh f ON s.url = f.url""")
def upsert_documents(spark, d):
    docs = V.docs(spark, d)
    store = docs.select("id", "url", "title", "word_count", "status", "last_crawled_at")
    parsed = docs.select(
        F.concat(F.lit("https://"), "source_slug", F.lit(".example.com/"), "language", F.lit("/"), (F.col("id") * 2).cast("string")).alias("url"),
        F.concat(F.lit("again "), "title").alias("title"),
        (F.col("word_count") + 1).alias("word_count"),
        (F.col("id") + 1_000_000_000_000).alias("id"),
    )
    return T.upsert_documents(store, parsed, V.AS_OF)


@query(""", fresh AS (SELECT 'src' || (CAST(slug[4:] AS INT) + 10) AS slug, 'New ' || name AS name, authority_weight / 2 AS authority_weight FROM registry)
SELECT coalesce(r.slug, f.slug) AS slug, CASE WHEN f.slug IS NULL THEN r.name ELSE f.name END AS name, CASE WHEN f.slug IS NULL THEN r.authority_weight ELSE f.authority_weight END AS authority_weight, coalesce(r.crawl_status, 'pending') AS crawl_status FROM registry r FULL JOIN fresh f ON r.slug = f.slug""")
def upsert_sources(spark, d):
    r = V.registry(spark, d)
    config = r.select(F.concat(F.lit("src"), (F.substring("slug", 4, 9).cast("int") + 10).cast("string")).alias("slug"), F.concat(F.lit("New "), "name").alias("name"), (F.col("authority_weight") / 2).alias("authority_weight"))
    return T.upsert_sources(r.select("slug", "name", "authority_weight", "crawl_status"), config)


@query("SELECT id, domain FROM docs WHERE NOT (depth = 0 AND domain IN ('src1.example.com', 'src2.example.com', 'src4.example.com'))")
def delete_by_domain(spark, d):
    docs = V.docs(spark, d).withColumn("source_slug", F.when(F.col("depth") > 0, F.col("source_slug")))
    return T.delete_by_domain(docs, ["src1.example.com", "src2.example.com", "src4.example.com"]).select("id", "domain")


@query(f"SELECT id, 'processing' AS status, CAST(priority AS INT) AS priority FROM queue WHERE status = 'pending' AND scheduled_at <= {NOW} ORDER BY queue.priority, scheduled_at, id LIMIT 10")
def dequeue_batch(spark, d):
    return T.dequeue_batch(V.queue(spark, d), V.AS_OF).select("id", "status", "priority")


@query(f"SELECT id, CASE WHEN status = 'processing' AND scheduled_at < {NOW} - INTERVAL 30 MINUTE THEN 'pending' ELSE status END AS status FROM queue")
def requeue_stale(spark, d):
    return T.requeue_stale(V.queue(spark, d), V.AS_OF).select("id", "status")


@query(f"SELECT id, CASE WHEN retry_count = 1 THEN 'done' WHEN retry_count = 2 THEN 'failed' ELSE status END AS status, CAST(CASE WHEN retry_count = 2 THEN 3 ELSE retry_count END AS INT) AS retry_count, CASE WHEN retry_count IN (1, 2) THEN {NOW} ELSE processed_at END AS processed_at FROM queue")
def queue_transitions(spark, d):
    q = V.queue(spark, d)
    r = F.col("retry_count")
    updates = q.where(r.isin(1, 2)).select("id", F.when(r == 1, "done").otherwise("failed").alias("new_status"), F.when(r == 2, F.lit(3)).alias("new_retry_count"))
    return T.queue_transitions(q, updates, V.AS_OF).select("id", "status", "retry_count", "processed_at")


@query(f"""SELECT id, CASE WHEN again THEN 'pending' ELSE 'failed' END AS status, CAST(retry_count + CASE WHEN again THEN 1 ELSE 0 END AS INT) AS retry_count, CASE WHEN again THEN {NOW} + to_seconds(CAST(least(300, 5 * pow(2, greatest(retry_count, 0))) AS INT)) END AS scheduled_at
FROM (SELECT id, retry_count, retry_count < 3 AND (code IS NULL OR code IN (408, 425, 429) OR code >= 500) AS again FROM (SELECT id, retry_count, CASE id % 6 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 408 WHEN 4 THEN 200 END AS code FROM queue))""")
def retry_policy(spark, d):
    i = F.col("id") % 6
    code = F.when(i == 0, 500).when(i == 1, 404).when(i == 2, 429).when(i == 3, 408).when(i == 4, 200)
    return T.retry_policy(V.queue(spark, d).select("id", "retry_count", code.alias("status_code")), V.AS_OF)


@query("""SELECT q.id, q.source_slug, CAST(q.depth AS INT) AS depth, CAST(least(coalesce(m, 2), 2) AS INT) AS cap, q.depth > least(coalesce(m, 2), 2) AS skip, q.depth < least(coalesce(m, 2), 2) AS discover
FROM queue q LEFT JOIN (SELECT slug, CASE WHEN CAST(slug[4:] AS INT) % 4 < 3 THEN CAST(slug[4:] AS INT) % 4 END AS m FROM registry) r ON r.slug = q.source_slug""")
def depth_gate(spark, d):
    m = F.substring("slug", 4, 9).cast("int") % 4
    limits = V.registry(spark, d).select(F.col("slug").alias("source_slug"), F.when(m < 3, m).alias("max_depth"))
    return T.depth_gate(V.queue(spark, d), limits, 2)


@query(""", r AS (SELECT id, domain, CAST((id * 7) % 11 AS DOUBLE) AS t, row_number() OVER (PARTITION BY domain ORDER BY (id * 7) % 11, id) - 1 AS i FROM queue)
SELECT id, domain, t, i * 1.0::DOUBLE + max(t - i * 1.0::DOUBLE) OVER (PARTITION BY domain ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS slot FROM r""")
def domain_slots(spark, d):
    return T.domain_slots(V.queue(spark, d).select("id", "domain", ((F.col("id") * 7) % 11).cast("double").alias("t")), 1.0)
