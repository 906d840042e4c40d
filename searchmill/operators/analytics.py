"""Search and corpus analytics: totals, top lists, registry listings, merges, queue outcomes.

Joins carry no broadcast hints: registries are small today, but only the planner
sees their size. Exact percentiles come from `percentile`, as the reference's do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return events.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))


def rate(part: Column, whole: Column) -> Column:
    """Per cent to one decimal; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(part / whole * 1000) / 10).otherwise(F.lit(0.0))


def clicked_ids(clicks: DataFrame) -> DataFrame:
    return clicks.select("search_id").distinct()


def with_clicks(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """Searches with clicked_id, null where nobody clicked."""
    hit = clicked_ids(clicks).withColumn("clicked_id", F.col("search_id"))
    return searches.join(hit, "search_id", "left")


def insights_totals(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """One row: searches, unique queries, latency mean and percentiles, zero-result and click counts and rates."""
    t = with_clicks(searches, clicks).agg(
        F.count(F.lit(1)).alias("total_searches"),
        F.countDistinct(F.nullif(F.col("query"), F.lit(""))).alias("unique_queries"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency"),
        F.round(F.coalesce(F.expr("percentile(latency_ms, 0.5)"), F.lit(0.0)), 6).alias("p50_latency"),
        F.round(F.coalesce(F.expr("percentile(latency_ms, 0.95)"), F.lit(0.0)), 6).alias("p95_latency"),
        F.count_if(F.col("results_count") == 0).alias("zero_results"),
        F.count("clicked_id").alias("clicked_searches"),
    )
    return t.withColumn("zero_result_rate", rate(F.col("zero_results"), F.col("total_searches"))).withColumn("click_through_rate", rate(F.col("clicked_searches"), F.col("total_searches")))


def by_query(searches: DataFrame) -> DataFrame:
    """Per non-empty query: searches, rounded mean results and latency."""
    return (
        searches.where(F.col("query") != "")
        .groupBy("query")
        .agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg("results_count")).cast("bigint").alias("avg_results"), F.round(F.avg("latency_ms")).cast("bigint").alias("avg_latency"))
    )


def top_queries(searches: DataFrame, k: int = 10) -> DataFrame:
    return by_query(searches).orderBy(F.desc("searches"), "query").limit(k)


def zero_result_queries(searches: DataFrame, k: int = 10) -> DataFrame:
    return top_queries(searches.where("results_count = 0"), k)


def low_click_queries(searches: DataFrame, clicks: DataFrame, least: int = 3, below: float = 0.2, k: int = 10) -> DataFrame:
    """Queries asked often and clicked seldom, the most asked first."""
    g = with_clicks(searches, clicks).where(F.col("query") != "").groupBy("query")
    clicked = F.col("clicked_id").isNotNull().cast("int")
    stats = g.agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg("results_count")).cast("bigint").alias("avg_results"), F.avg(clicked).alias("ctr"))
    return stats.where((F.col("searches") >= least) & (F.col("ctr") < below)).select("query", "searches", "avg_results", F.round("ctr", 6).alias("ctr")).orderBy(F.desc("searches"), "query").limit(k)


def top_sources(clicks: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """Clicks by source of the clicked document; equal counts by slug."""
    j = clicks.select("clicked_document_id").join(docs.select(F.col("id").alias("clicked_document_id"), "source_slug"), "clicked_document_id")
    return j.groupBy("source_slug").agg(F.count(F.lit(1)).alias("clicks")).orderBy(F.desc("clicks"), "source_slug").limit(k)


def log_click_events(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """Click rows as they are stored: copies of the search's query and figures; a click without its search stores nothing."""
    s = searches.select("search_id", "session_id", "query", "results_count", "latency_ms")
    return clicks.join(s, "search_id").select("search_id", F.lit("click").alias("event_type"), "session_id", "query", "results_count", "latency_ms", "clicked_document_id", "result_rank")


def duplicate_stats(docs: DataFrame) -> DataFrame:
    """Groups of documents with equal content, and how many documents are too many."""
    g = docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("duplicate_documents"))


def top_domains(docs: DataFrame, k: int = 5) -> DataFrame:
    return docs.groupBy("domain").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "domain").limit(k)


def status_counts(docs: DataFrame, queue: DataFrame, logs: DataFrame) -> DataFrame:
    """(metric, value) of the status page; each table is scanned once."""
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "indexed").alias("indexed"))
    q = queue.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("queue_depth"))
    c = logs.agg(F.count_if(F.col("error_message").isNotNull() | F.coalesce(F.col("status_code") >= 400, F.lit(False))).alias("crawl_failures"))
    one = d.crossJoin(q).crossJoin(c)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("documents", "indexed", "queue_depth", "crawl_failures")])).alias("s")).select("s.*")


def indexed_counts(docs: DataFrame) -> DataFrame:
    return docs.where("status = 'indexed'").groupBy(F.col("source_slug").alias("slug")).agg(F.count(F.lit(1)).alias("doc_count"))


def source_registry_listing(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """Registry with counts of indexed documents, 0 for none; by authority, then name."""
    r = registry.join(indexed_counts(docs), "slug", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    return r.select("slug", "name", "authority_weight", "crawl_cadence_hours", "crawl_status", "doc_count").orderBy(F.desc("authority_weight"), "name")


def static_sources(spark) -> DataFrame:
    """The mirror of shipped sources that live rows are laid over."""
    rows = [(i, f"src{s}", f"Static {s}", f"static {s}") for i, s in enumerate((3, 1, 4, 15, 30))]
    return spark.createDataFrame(rows, "position int, slug string, name string, description string")


def merge_static(static: DataFrame, live: DataFrame, append: bool) -> DataFrame:
    """Static sources with live values over them, but their own description; then, if wished, live-only sources."""
    l = live.select("slug", F.col("name").alias("live_name"), "doc_count", F.col("crawl_status").alias("live_status"))
    merged = static.join(l, "slug", "left").select(
        "slug", F.coalesce("live_name", "name").alias("name"), "description", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("live_status", F.lit("seeded")).alias("crawl_status"), F.col("position")
    )
    if append:
        extra = live.join(static, "slug", "left_anti").select("slug", "name", F.lit("").alias("description"), "doc_count", "crawl_status", F.lit(None).cast("int").alias("position"))
        merged = merged.unionByName(extra)
    return merged


def source_coverage(listing: DataFrame) -> DataFrame:
    return listing.agg(F.coalesce(F.sum("doc_count"), F.lit(0)).cast("bigint").alias("documents"), F.count_if(F.col("doc_count") > 0).alias("sources_with_documents"))


def queue_outcomes(queue: DataFrame, since: str) -> DataFrame:
    """Per source, of what was processed or is still due since then: done, failed, remaining."""
    t = F.lit(since).cast("timestamp_ntz")
    q = queue.where(F.col("source_slug").isNotNull() & ((F.col("processed_at") >= t) | F.col("status").isin("pending", "processing")))
    return q.groupBy("source_slug").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("pending", "processing")).alias("remaining")
    )


def source_health(outcomes: DataFrame) -> DataFrame:
    """healthy without failures or rest, crawling with a rest, else failing; successful needs something done."""
    state = F.when((F.col("failed") == 0) & (F.col("remaining") == 0), "healthy").when(F.col("remaining") > 0, "crawling").otherwise("failing")
    return outcomes.select("source_slug", state.alias("crawl_status"), (F.col("done") > 0).alias("successful"))


def log_search_events(searches: DataFrame) -> DataFrame:
    """Search rows as they are stored: the query in lower case; a search without a query isn't stored."""
    s = searches.where(F.col("query") != "")
    return s.select("search_id", F.lit("search").alias("event_type"), "session_id", F.lower("query").alias("query"), "results_count", "latency_ms")


def filters_json(snapshot: dict[str, Column]) -> Column:
    """The filters of a request as JSON, absent ones as null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in snapshot.items()]), {"ignoreNullFields": "false"})


def failures(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("error_message").isNotNull() | F.coalesce(F.col("status_code") >= 400, F.lit(False)))


def source_lookup(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents with their source's name, null if unknown, and authority, 0 if unknown."""
    r = registry.select(F.col("slug").alias("source_slug"), F.col("name").alias("source_name"), "authority_weight")
    return docs.drop("authority", "source_name").join(r, "source_slug", "left").withColumn("authority", F.coalesce("authority_weight", F.lit(0.0)))
