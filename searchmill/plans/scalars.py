"""Scalar functions over whole tables, filters, projections and in-memory fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchmill.functions import columns as C
from searchmill.operators import corpus as G
from searchmill.operators import search as S
from searchmill.sources import seeds
from searchmill.sources import views as V

from .base import query

COLD = "TIMESTAMP '2024-02-05 00:00:00'"


@query("SELECT id, body FROM docs")
def clean_text(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), C.clean_text(F.col("text")).alias("body"))


@query("SELECT id, normalized_url FROM queue")
def normalize_url(spark, d):
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), C.normalize_url(F.col("url")).alias("normalized_url"))


@query("SELECT id, domain FROM queue")
def extract_domain(spark, d):
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), C.extract_domain(F.col("url")).alias("domain"))


@query("SELECT page_id AS id, CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END AS path FROM pages", views=False)
def url_path(spark, d):
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), C.url_path(F.col("url")).alias("path"))


@query("SELECT id, sha256(body) AS content_hash FROM docs")
def content_hash(spark, d):
    return V.docs(spark, d).select("id", C.content_hash(F.col("body")).alias("content_hash"))


@query("SELECT id, word_count FROM docs")
def word_count(spark, d):
    return V.docs(spark, d).select("id", "word_count")


@query("SELECT id, boost_score FROM scored")
def boost_score(spark, d):
    return V.scored_docs(spark, d).select("id", "boost_score")


@query("SELECT id, CASE WHEN id % 120 <= 7 THEN 'fresh' WHEN id % 120 <= 30 THEN 'ok' ELSE 'stale' END AS freshness_status FROM docs")
def freshness_bucket(spark, d):
    # crawled an hour short of whole days later: periods of 24 hours count, not calendar days
    return V.docs(spark, d).select("id", C.freshness(F.col("last_crawled_at") - F.expr("interval 23 hours"), V.AS_OF).alias("freshness_status"))


@query("""SELECT page_id AS id, CASE WHEN regexp_matches(url, '(?i)^https?://[^?#]*/(blog|posts?|news|articles?)/') THEN 'blog'
WHEN regexp_matches(html, '(?i)<title>[^<]*\\b(property|method|function|enum|namespace|type|interface|class)\\b') THEN 'reference' ELSE 'guide' END AS content_type FROM pages""", views=False)
def content_type(spark, d):
    p = V.table(spark, d, "pages")
    return p.select(F.col("page_id").alias("id"), C.content_type(F.col("url"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit(0)).alias("content_type"))


@query("SELECT id, list_filter(list_transform(string_split(title, ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM docs")
def parse_tags(spark, d):
    return V.docs(spark, d).select("id", C.parse_tags(F.col("title")).alias("tags"))


@query("SELECT event_id AS id, ts AS parsed FROM events", views=False)
def parse_datetime(spark, d):
    e = V.table(spark, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return e.select(F.col("event_id").alias("id"), C.parse_datetime(text).alias("parsed"))


@query("""SELECT id, replace(replace(replace(replace(replace(regexp_replace('<b>' || title || '</b> <em>&amp;lt;&lt;&quot;&#39;</em>', '(?i)</?b>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS shown
FROM (SELECT id, regexp_replace(title, '[<>&]', ' ', 'g') AS title FROM docs)""")
def decode_entities(spark, d):
    x = F.concat(F.lit("<b>"), F.regexp_replace("title", "[<>&]", " "), F.lit("</b> <em>&amp;lt;&lt;&quot;&#39;</em>"))
    return V.docs(spark, d).select("id", C.decode_entities(x).alias("shown"))


@query("SELECT page_id AS id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':\\d+$', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') AS shown FROM pages", views=False)
def display_url(spark, d):
    return V.table(spark, d, "pages").select(F.col("page_id").alias("id"), C.display_url(F.col("url")).alias("shown"))


@query("SELECT id, CASE WHEN id % 3 > 0 THEN 'Updated ' || strftime(last_updated_at, '%b %-d, %Y') WHEN id % 2 = 0 THEN 'Updated recently' ELSE 'Update may be stale' END AS label FROM docs")
def freshness_label(spark, d):
    i = F.col("id")
    return V.docs(spark, d).select("id", C.freshness_label(F.when(i % 3 > 0, F.col("last_updated_at")), F.when(i % 2 == 0, "fresh").otherwise("stale")).alias("label"))


@query("""SELECT slug, CASE crawl_cadence_hours WHEN 12 THEN '12 hours' WHEN 48 THEN '2 days' WHEN 168 THEN '1 week' WHEN 336 THEN '2 weeks' WHEN 720 THEN '1 month' ELSE '2 months' END AS label FROM registry""")
def cadence_label(spark, d):
    return V.registry(spark, d).select("slug", C.cadence_label(F.col("crawl_cadence_hours")).alias("label"))


@query("SELECT slug, CASE crawl_status WHEN 'healthy' THEN 'Healthy' WHEN 'crawling' THEN 'Crawling' WHEN 'failing' THEN 'Failing' ELSE 'Pending' END AS label FROM registry")
def status_label(spark, d):
    return V.registry(spark, d).select("slug", C.status_label(F.col("crawl_status")).alias("label"))


@query("SELECT id, length(id::VARCHAR) = 2 AS good FROM docs")
def uuid_predicate(spark, d):
    x = F.concat(F.lit("0a1b2c"), F.col("id").cast("string"), F.lit("-0000-4000-8000-0123456789ab"))
    return V.docs(spark, d).select("id", C.is_uuid(x).alias("good"))


# filters and projections


@query("SELECT id FROM docs WHERE source_slug IN ('src1', 'src2', 'src3') AND content_type IN ('guide', 'api') AND language IN ('en', 'de')")
def filter_in_list(spark, d):
    return V.docs(spark, d).where(S.filters(sources=("src1", "src2", "src3"), content_types=("guide", "api"), languages=("en", "de"))).select("id")


@query("SELECT id FROM docs WHERE list_has_any(tags, ['t1', 'fr'])")
def filter_tags_any(spark, d):
    return V.docs(spark, d).where(S.filters(tags=("t1", "fr"))).select("id")


@query("SELECT id, published_at FROM docs WHERE published_at >= TIMESTAMP '2025-03-01' AND published_at <= TIMESTAMP '2025-05-31'")
def filter_date_range(spark, d):
    return V.docs(spark, d).where(S.filters(published_from="2025-03-01", published_to="2025-05-31")).select("id", "published_at")


@query(f"SELECT id, last_updated_at FROM docs WHERE last_updated_at >= {COLD} - INTERVAL 30 DAY")
def filter_updated_within(spark, d):
    return V.docs(spark, d).where(S.filters(updated_within="30d", as_of=V.as_of())).select("id", "last_updated_at")


CONJUNCTION = f"source_slug IN ('src0', 'src1', 'src2', 'src3', 'src4') AND list_has_any(tags, ['t1', 't3', 'en']) AND published_at >= TIMESTAMP '2025-02-01' AND last_updated_at >= {COLD} - INTERVAL 90 DAY"


def _conjunction():
    return S.filters(sources=[f"src{i}" for i in range(5)], tags=("t1", "t3", "en"), published_from="2025-02-01", updated_within="90d", as_of=V.as_of())


@query(f"SELECT id FROM docs WHERE {CONJUNCTION}")
def filter_conjunction(spark, d):
    return V.docs(spark, d).where(_conjunction()).select("id")


@query(f"SELECT id, row_number() OVER (ORDER BY authority DESC, boost_score DESC, id) AS rank FROM scored WHERE {CONJUNCTION} ORDER BY rank LIMIT 10")
def browse_filtered(spark, d):
    found, keys = S.ranked(V.scored_docs(spark, d), "", _conjunction())
    return S.page(found, keys).select("id", "rank")


@query("""SELECT id, url, domain, source_slug, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, content_type, section_path, coalesce(meta_description, '') AS snippet,
CASE WHEN id % 3 = 0 THEN 0 ELSE code_block_count END AS code_block_count, CASE WHEN id % 7 = 0 THEN [] ELSE tags END AS tags, 'unknown' AS freshness_status, list_filter([title, meta_description], lambda x: x <> '') AS highlights FROM docs""")
def result_projection(spark, d):
    i = F.col("id")
    x = V.docs(spark, d).withColumns({"title": F.when(F.col("title") != "", F.col("title")), "code_block_count": F.when(i % 3 > 0, F.col("code_block_count")), "tags": F.when(i % 7 > 0, F.col("tags"))})
    return G.result_projection(x.withColumn("freshness_status", F.lit(None).cast("string")))


@query("SELECT id, list_slice(list_distinct_ordered, 1, 3) AS words FROM (SELECT id, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT id, list_filter(string_split(title, ' '), lambda x: x <> '') AS w FROM docs))")
def dedupe_cap_list(spark, d):
    return V.docs(spark, d).select("id", G.dedupe_cap(F.split("title", " "), 3).alias("words"))


@query("SELECT id, CAST(floor((id - 1) / 500) AS BIGINT) AS batch FROM docs")
def batch_assignment(spark, d):
    return V.docs(spark, d).select("id", G.batch_number(F.col("id"), 500).alias("batch"))


@query("SELECT d.id, 'heading ' || d.id AS heading FROM docs d JOIN (SELECT url FROM docs) u ON u.url = d.url")
def id_resolution_join(spark, d):
    docs = V.docs(spark, d).select("id", "url")
    children = docs.select("url", F.concat(F.lit("heading "), F.regexp_extract("url", r"(\d+)$", 1)).alias("heading"))
    return G.resolve_ids(children, docs).select("id", "heading")


SYNTHETIC = """SELECT n AS doc_number, topic, 'https://' || domain || '/' || topic || '/doc-' || lpad(n::VARCHAR, 5, '0') AS url, domain, language, tags, TIMESTAMP '2025-01-01' + to_days(CAST(n % 365 AS INT)) AS published_at, CAST(6 + n % 5 AS INT) AS boost_score
FROM (SELECT n, list_extract(['search-ranking','crawler-design','index-maintenance','frontend-search','analytics-pipelines','retrieval-tuning','deduplication','metadata-storage'], CAST((n - 1) % 8 + 1 AS INT)) AS topic,
list_extract(['docs','blog','kb','guides'], CAST((n - 1) % 4 + 1 AS INT)) || '.synthetic.local' AS domain, CASE WHEN n % 4 = 0 THEN 'es' ELSE 'en' END AS language,
string_split(list_extract(['ranking relevance search','crawler python queues','indexing etl operations','web typescript ux','analytics sql metrics','search latency performance','content hashing quality','sql schema storage'], CAST((n - 1) % 8 + 1 AS INT)), ' ') AS tags
FROM range(1, 10001) t(n))"""


@query(SYNTHETIC, views=False)
def synthetic_corpus(spark, d):
    return G.synthetic_corpus(spark, 10_000).select("doc_number", "topic", "url", "domain", "language", "tags", "published_at", "boost_score")


@query("SELECT * FROM (VALUES ('a', 'ok'), ('b', 'no allowed_domains'), ('c', 'seed outside allowed_domains'), ('d', 'authority_weight out of range'), ('', 'slug missing or repeated')) t(slug, problem)", views=False)
def seed_validation(spark, d):
    rows = [
        ("a", ["x.org"], 5.0, 2, ["https://x.org/"]),
        ("b", [], 5.0, 2, ["https://x.org/"]),
        ("c", ["x.org"], 5.0, 2, ["https://y.org/"]),
        ("d", ["x.org"], 11.0, 2, []),
        ("", ["x.org"], 5.0, 2, []),
    ]
    return seeds.problems(spark.createDataFrame(rows, seeds.SCHEMA))


@query("SELECT ['a.org', 'b.org', 'c.org', 'd.org'] AS domains", views=False)
def allowed_domains_union(spark, d):
    rows = [("s1", 0, ["a.org", "b.org"]), ("s2", 1, ["b.org", "c.org"]), ("s3", 2, ["a.org", "d.org"])]
    return seeds.allowed_domains(spark.createDataFrame(rows, "slug string, position int, allowed_domains array<string>"))
