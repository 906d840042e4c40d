"""Search analytics, corpus status, sources and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchmill.operators import analytics as A
from searchmill.operators import evaluation as E
from searchmill.sources import views as V

from .base import query

RECENT = "created_at >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAY"
SEARCHES = f"(SELECT * FROM searches WHERE {RECENT})"
CLICKED = f"(SELECT DISTINCT search_id, search_id AS clicked_id FROM clicks WHERE {RECENT})"
LISTING = "SELECT r.slug, name, authority_weight, crawl_cadence_hours, crawl_status, coalesce(n, 0) AS doc_count FROM registry r LEFT JOIN (SELECT source_slug AS slug, count(*) AS n FROM docs WHERE status = 'indexed' GROUP BY 1) c ON r.slug = c.slug"
STATIC = "(VALUES (0, 'src3'), (1, 'src1'), (2, 'src4'), (3, 'src15'), (4, 'src30')) AS s(position, slug)"
MERGED = f"SELECT s.slug, coalesce(l.name, 'Static ' || s.slug[4:]) AS name, 'static ' || s.slug[4:] AS description, coalesce(doc_count, 0) AS doc_count, coalesce(crawl_status, 'seeded') AS crawl_status, s.position FROM {STATIC} LEFT JOIN ({LISTING}) l ON l.slug = s.slug"
OUTCOMES = """SELECT source_slug, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('pending', 'processing')) AS remaining
FROM queue WHERE source_slug IS NOT NULL AND (processed_at >= TIMESTAMP '2024-02-04 23:30:00' OR status IN ('pending', 'processing')) GROUP BY 1"""
SINCE = "2024-02-04 23:30:00"


def _recent(spark, d):
    at = V.as_of()
    return A.recent(V.searches(spark, d), at), A.recent(V.clicks(spark, d), at)


def _listing(spark, d):
    return A.source_registry_listing(V.registry(spark, d), V.docs(spark, d))


def _outcomes(spark, d):
    return A.queue_outcomes(V.queue(spark, d), SINCE)


@query(f"""SELECT *, CASE WHEN total_searches > 0 THEN round(zero_results::DOUBLE / total_searches * 1000) / 10 ELSE 0.0 END AS zero_result_rate,
CASE WHEN total_searches > 0 THEN round(clicked_searches::DOUBLE / total_searches * 1000) / 10 ELSE 0.0 END AS click_through_rate FROM (
SELECT count(*) AS total_searches, count(DISTINCT nullif(query, '')) AS unique_queries, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency, round(coalesce(quantile_cont(latency_ms, 0.5), 0), 6) AS p50_latency,
round(coalesce(quantile_cont(latency_ms, 0.95), 0), 6) AS p95_latency, count(*) FILTER (WHERE results_count = 0) AS zero_results, count(clicked_id) AS clicked_searches
FROM {SEARCHES} s LEFT JOIN {CLICKED} c USING (search_id))""")
def insights_totals(spark, d):
    return A.insights_totals(*_recent(spark, d))


def _top(where: str) -> str:
    return f"SELECT query, count(*) AS searches, CAST(round(avg(results_count)) AS BIGINT) AS avg_results, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency FROM {SEARCHES} WHERE query <> '' {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"


@query(_top(""))
def top_queries(spark, d):
    return A.top_queries(_recent(spark, d)[0])


@query(_top("AND results_count = 0"))
def zero_result_queries(spark, d):
    return A.zero_result_queries(_recent(spark, d)[0])


@query(f"""SELECT query, searches, avg_results, round(ctr, 6) AS ctr FROM (SELECT query, count(*) AS searches, CAST(round(avg(results_count)) AS BIGINT) AS avg_results,
avg(CASE WHEN clicked_id IS NULL THEN 0 ELSE 1 END) AS ctr FROM {SEARCHES} s LEFT JOIN {CLICKED} c USING (search_id) WHERE query <> '' GROUP BY 1) WHERE searches >= 3 AND ctr < 0.2 ORDER BY 2 DESC, 1 LIMIT 10""")
def low_click_queries(spark, d):
    return A.low_click_queries(*_recent(spark, d))


@query(f"SELECT source_slug, count(*) AS clicks FROM (SELECT * FROM clicks WHERE {RECENT}) c JOIN docs ON docs.id = clicked_document_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_sources(spark, d):
    return A.top_sources(_recent(spark, d)[1], V.docs(spark, d))


@query(f"SELECT DISTINCT search_id FROM clicks WHERE {RECENT}")
def distinct_clicked(spark, d):
    return A.clicked_ids(_recent(spark, d)[1])


@query("SELECT search_id, session_id, created_at, latency_ms FROM searches")
def dedupe_search_events(spark, d):
    return V.searches(spark, d).select("search_id", "session_id", "created_at", "latency_ms")


@query("SELECT search_id, 'search' AS event_type, session_id, lower(query) AS query, results_count, latency_ms FROM searches WHERE query <> ''")
def log_search_events(spark, d):
    return A.log_search_events(V.searches(spark, d))


@query("""SELECT search_id, '{"source":["src' || results_count || '"],"tags":[],"from":null,"sort":"' || CASE WHEN results_count = 0 THEN 'newest' ELSE 'relevance' END || '"}' AS filters FROM searches""")
def filters_json(spark, d):
    s = V.searches(spark, d)
    snapshot = {
        "source": F.array(F.concat(F.lit("src"), F.col("results_count").cast("string"))),
        "tags": F.array().cast("array<string>"),
        "from": F.lit(None).cast("string"),
        "sort": F.when(F.col("results_count") == 0, "newest").otherwise("relevance"),
    }
    return s.select("search_id", A.filters_json(snapshot).alias("filters"))


@query("SELECT c.search_id, 'click' AS event_type, session_id, query, results_count, latency_ms, clicked_document_id, result_rank FROM clicks c JOIN searches s ON s.search_id = c.search_id")
def log_click_events(spark, d):
    return A.log_click_events(V.searches(spark, d), V.clicks(spark, d))


STATUS = """SELECT 'documents' AS metric, count(*) AS value FROM docs UNION ALL SELECT 'indexed', count(*) FILTER (WHERE status = 'indexed') FROM docs
UNION ALL SELECT 'queue_depth', count(*) FILTER (WHERE status IN ('pending', 'processing')) FROM queue UNION ALL SELECT 'crawl_failures', count(*) FILTER (WHERE error_message IS NOT NULL OR status_code >= 400) FROM crawl_logs"""


@query(STATUS)
def status_counts(spark, d):
    return A.status_counts(V.docs(spark, d), V.queue(spark, d), V.crawl_logs(spark, d))


@query("SELECT count(*) AS queue_depth FROM queue WHERE status IN ('pending', 'processing')")
def queue_depth(spark, d):
    return V.queue(spark, d).where(F.col("status").isin("pending", "processing")).agg(F.count(F.lit(1)).alias("queue_depth"))


@query("SELECT id, url, status_code, error_message FROM crawl_logs WHERE error_message IS NOT NULL OR status_code >= 400")
def crawl_failures(spark, d):
    return A.failures(V.crawl_logs(spark, d)).select("id", "url", "status_code", "error_message")


@query("SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n) - count(*), 0) AS BIGINT) AS duplicate_documents FROM (SELECT count(*) AS n FROM docs GROUP BY content_hash HAVING count(*) > 1)")
def duplicate_stats(spark, d):
    return A.duplicate_stats(V.docs(spark, d))


@query("SELECT domain, count(*) AS documents FROM docs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_domains(spark, d):
    return A.top_domains(V.docs(spark, d))


@query(LISTING + " ORDER BY authority_weight DESC, name")
def source_registry_listing(spark, d):
    return _listing(spark, d)


@query(MERGED)
def source_merge_static(spark, d):
    return A.merge_static(A.static_sources(spark), _listing(spark, d), append=False)


@query(f"{MERGED} UNION ALL SELECT slug, name, '', doc_count, crawl_status, NULL FROM ({LISTING}) WHERE slug NOT IN (SELECT slug FROM {STATIC})")
def source_merge(spark, d):
    return A.merge_static(A.static_sources(spark), _listing(spark, d), append=True)


@query(f"SELECT CAST(coalesce(sum(doc_count), 0) AS BIGINT) AS documents, count(*) FILTER (WHERE doc_count > 0) AS sources_with_documents FROM ({LISTING})")
def source_coverage(spark, d):
    return A.source_coverage(_listing(spark, d))


@query(OUTCOMES)
def queue_outcomes(spark, d):
    return _outcomes(spark, d)


HEALTH = f"SELECT source_slug, CASE WHEN failed = 0 AND remaining = 0 THEN 'healthy' WHEN remaining > 0 THEN 'crawling' ELSE 'failing' END AS crawl_status, done > 0 AS successful FROM ({OUTCOMES})"


@query(HEALTH)
def source_health(spark, d):
    return A.source_health(_outcomes(spark, d))


@query(f"""SELECT r.slug, coalesce(n, 0) AS doc_count, coalesce(h.crawl_status, r.crawl_status) AS crawl_status, CASE WHEN h.crawl_status IS NOT NULL THEN TIMESTAMP '2024-02-05 00:00:00' END AS last_crawled_at,
CASE WHEN successful THEN TIMESTAMP '2024-02-05 00:00:00' END AS last_successful_crawl_at FROM registry r LEFT JOIN (SELECT source_slug AS slug, count(*) AS n FROM docs WHERE status = 'indexed' GROUP BY 1) c ON r.slug = c.slug
LEFT JOIN ({HEALTH}) h ON h.source_slug = r.slug""")
def source_doc_count(spark, d):
    from searchmill.operators import state as S

    return S.source_doc_count(V.registry(spark, d), A.indexed_counts(V.docs(spark, d)), A.source_health(_outcomes(spark, d)), V.AS_OF)


@query("SELECT d.id, d.source_slug, r.name AS source_name, coalesce(r.authority_weight, 0) AS authority FROM docs d LEFT JOIN registry r ON r.slug = d.source_slug")
def source_lookup(spark, d):
    return A.source_lookup(V.docs(spark, d), V.registry(spark, d)).select("id", "source_slug", "source_name", "authority")


@query(f"SELECT event_id, user_id, value FROM events WHERE event_type = 'view' AND ts >= {RECENT[14:]}", views=False)
def scan_filter_project(spark, d):
    e = V.table(spark, d, "events").where((F.col("event_type") == "view") & (F.col("ts") >= V.as_of() - F.make_dt_interval(F.lit(30))))
    return e.select("event_id", "user_id", "value")


# queries of the evaluation: each logged query, its results the documents clicked for it by number of clicks
RANKED = """, counted AS (SELECT query, url, count(*) AS n, min(id) AS id FROM clicks c JOIN searches s ON s.search_id = c.search_id JOIN docs ON docs.id = clicked_document_id WHERE query <> '' GROUP BY 1, 2),
results AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY n DESC, id) AS rank FROM counted),
specs AS (SELECT query, 'src' || (CAST(query[2:] AS INT) % 5) AS source, CASE WHEN query = 'q7' THEN 10 ELSE 5 END AS k FROM (SELECT DISTINCT query FROM searches WHERE query <> '')),
hits AS (SELECT specs.query, any_value(source) AS source, CAST(coalesce(max(CASE WHEN rank <= k AND (contains(lower(url), '/en/') OR contains(lower(url), '//src1.')) THEN 1 ELSE 0 END), 0) AS INT) AS hit
FROM specs LEFT JOIN results ON results.query = specs.query GROUP BY 1) """


def _hits(spark, d):
    from pyspark.sql import Window

    s, c, docs = V.searches(spark, d), V.clicks(spark, d), V.docs(spark, d).select("id", "url")
    j = c.join(s.where("query <> ''").select("search_id", "query"), "search_id").join(docs, F.col("clicked_document_id") == F.col("id"))
    counted = j.groupBy("query", "url").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    results = counted.select("query", "url", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "id")).alias("rank"))
    specs = s.where("query <> ''").select("query").distinct().select(
        "query",
        F.concat(F.lit("src"), (F.substring("query", 2, 9).cast("int") % 5).cast("string")).alias("source"),
        F.array(F.lit("/en/"), F.lit("//SRC1.")).alias("fragments"),
        F.when(F.col("query") == "q7", 10).otherwise(5).alias("k"),
    )
    return E.hit_at_k(results, specs)


@query(RANKED + "SELECT * FROM hits")
def hit_at_k(spark, d):
    return _hits(spark, d)


@query(RANKED + "SELECT source, count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS rate, avg(hit) >= 0.7 AS passed FROM hits GROUP BY 1")
def hit_at_k_by_source(spark, d):
    return E.pass_rate(_hits(spark, d), "source")


@query("SELECT query, latency_ms AS p_nearest, n AS samples FROM (SELECT query, latency_ms, row_number() OVER (PARTITION BY query ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY query) AS n FROM searches) WHERE r = greatest(1, least(n, CAST(round_even(n * 0.95::DOUBLE, 0) AS BIGINT)))")
def latency_nearest_rank(spark, d):
    return E.nearest_rank(V.searches(spark, d), "query", "latency_ms")


@query("SELECT query, round(avg(latency_ms), 4) AS mean_latency, round(avg(results_count), 4) AS mean_hits, array_to_string(list_sort(list(DISTINCT CASE WHEN results_count = 0 THEN 'degraded' ELSE 'live' END)), ',') AS modes FROM searches GROUP BY 1")
def bench_summary(spark, d):
    s = V.searches(spark, d).withColumn("mode", F.when(F.col("results_count") == 0, "degraded").otherwise("live"))
    return E.bench_summary(s, "query")
