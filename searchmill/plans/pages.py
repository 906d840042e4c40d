"""Extraction of crawled pages and link discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchmill.functions import columns as C
from searchmill.operators import extract as X
from searchmill.operators import state as T
from searchmill.sources import views as V

from .base import query


def _pages(spark, d):
    return V.table(spark, d, "pages").select("page_id", "url", "html")


def _parsed(spark, d):
    return X.parse_pages(_pages(spark, d))


ENTITIES = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
TITLE = f"trim(regexp_replace({ENTITIES.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)')}, '\\s+', ' ', 'g'))"
LINKS = "list_transform(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1), lambda h: regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || h)"


@query("SELECT page_id, url, length(html) AS html_chars FROM pages", views=False)
def scan_pages(spark, d):
    return _pages(spark, d).select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


@query(f"SELECT page_id, {TITLE} AS title FROM pages", views=False)
def extract_title(spark, d):
    return _parsed(spark, d).select("page_id", "title")


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language FROM pages", views=False)
def extract_language(spark, d):
    return _parsed(spark, d).select("page_id", "language")


@query(f"SELECT page_id, {LINKS} AS links FROM pages", views=False)
def extract_links(spark, d):
    return _parsed(spark, d).select("page_id", "links")


BARE = "regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g')"
FIRST_P = f"""trim(regexp_replace({ENTITIES.format(f"replace(regexp_replace(regexp_extract({BARE}, '(?s)<p>(.*?)(?:</p>|<p>|<div|<ul|<table|<h[1-6]|</article|</div|</body|$)', 1), '<[^>]*>', ' ', 'g'), '&copy;', '©')")}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"""


@query(f"SELECT page_id, {FIRST_P} AS meta_description FROM pages", views=False)
def extract_description(spark, d):
    return _parsed(spark, d).select("page_id", "meta_description")


HEADINGS = f"list_filter(list_transform(regexp_extract_all(html, '<h[123]>([^<]*)</h[123]>', 1), lambda x: trim(regexp_replace({ENTITIES.format('x')}, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"SELECT page_id, {HEADINGS} AS headings FROM pages", views=False)
def extract_headings(spark, d):
    return _parsed(spark, d).select("page_id", "headings")


@query("SELECT page_id, CAST(NULL AS TIMESTAMP) AS published_at, CAST(NULL AS TIMESTAMP) AS last_updated_at FROM pages", views=False)
def extract_dates(spark, d):
    return _parsed(spark, d).select("page_id", "published_at", "last_updated_at")


@query("SELECT page_id, url AS canonical_url, '{}' AS schema_json FROM pages", views=False)
def extract_meta(spark, d):
    return _parsed(spark, d).select("page_id", "canonical_url", "schema_json")


BODY = f"""trim(regexp_replace({ENTITIES.format("replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(html, '<(article|main)[ >]') THEN regexp_extract(html, '(?s)<(article|main)[^>]*>(.*)</(article|main)>', 2) ELSE html END, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&copy;', '©')")}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"""


@query(f"SELECT page_id, body, CASE WHEN body = '' THEN 0 ELSE len(string_split(trim(body), ' ')) END AS word_count, sha256(body) AS content_hash FROM (SELECT page_id, left({BODY}, 50000) AS body FROM pages)", views=False)
def extract_body(spark, d):
    return _parsed(spark, d).select("page_id", "body", "word_count", "content_hash")


SECTION = """SELECT page_id, CASE WHEN len(k) >= 2 THEN array_to_string(k[1:4], ' > ') ELSE '' END AS section_path FROM (SELECT page_id, list_filter(list_transform(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''),
lambda x: upper(x[1]) || lower(regexp_replace(x[2:], '[.](md|html?)$', ''))), lambda x: length(x) > 1 AND lower(x) NOT IN ('docs', 'latest', 'current', 'us', 'en')) AS k FROM pages)"""


@query(SECTION, views=False)
def section_path(spark, d):
    return _parsed(spark, d).select("page_id", "section_path")


@query("SELECT page_id, CAST(0 AS INT) AS code_block_count FROM pages", views=False)
def code_blocks(spark, d):
    return _parsed(spark, d).select("page_id", "code_block_count")


KIND = """CASE WHEN regexp_matches(url, '(?i)^https?://[^?#]*/(blog|posts?|news|articles?)/') THEN 'blog'
WHEN regexp_matches(html, '(?i)<title>[^<]*\\b(property|method|function|enum|namespace|type|interface|class)\\b') THEN 'reference' ELSE 'guide' END"""


@query(f"""SELECT page_id, url, {TITLE} AS title, {FIRST_P} AS meta_description, url AS canonical_url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, CAST(NULL AS TIMESTAMP) AS published_at, CAST(NULL AS TIMESTAMP) AS last_updated_at,
{HEADINGS} AS headings, {LINKS} AS links, body, sha256(body) AS content_hash, CASE WHEN body = '' THEN 0 ELSE len(string_split(trim(body), ' ')) END AS word_count, CAST(0 AS INT) AS code_block_count, CAST([] AS VARCHAR[]) AS tags, '{{}}' AS schema_json,
{KIND} AS content_type, section_path FROM (SELECT *, left({BODY}, 50000) AS body FROM pages) JOIN ({SECTION}) s USING (page_id)""", views=False)
def parse_pages(spark, d):
    """Every field of every page."""
    return _parsed(spark, d)


# discovery over the link graph of the pages


def _graph(spark, d):
    return _parsed(spark, d).select(C.normalize_url(F.col("url")).alias("normalized_url"), "links")


LINKED = f""", linked AS (SELECT p.page_id, q.source_slug, q.depth, q.normalized_url AS page, unnest(({LINKS.replace('url', 'p.url')})[1:50]) AS url FROM pages p JOIN queue q ON q.id = p.page_id),
found AS (SELECT page_id, source_slug, depth, page, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS domain, {{}} AS normalized_url FROM linked)"""
FOUND = LINKED.format("lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '(.)/$', '\\1')")


@query(FOUND + " SELECT DISTINCT normalized_url, 0 AS depth FROM queue UNION ALL SELECT DISTINCT normalized_url, 1 FROM found WHERE normalized_url NOT IN (SELECT normalized_url FROM queue)")
def bfs_frontier(spark, d):
    g = _graph(spark, d)
    return T.bfs_frontier(g.select("normalized_url"), g, 2)


def _links(spark, d):
    p = _parsed(spark, d).select("page_id", F.explode(F.slice("links", 1, T.LINKS)).alias("url"))
    q = V.queue(spark, d).select(F.col("id").alias("page_id"), "source_slug", "depth")
    j = p.join(q, "page_id")
    return j.select("source_slug", C.extract_domain(F.col("url")).alias("domain"), C.normalize_url(F.col("url")).alias("normalized_url"), (F.col("depth") + 1).alias("depth"))


@query(FOUND + ", allowed AS (SELECT DISTINCT source_slug, domain FROM queue WHERE priority <= 20 AND source_slug <> 'src6') SELECT source_slug, domain, normalized_url, CAST(depth + 1 AS INT) AS depth FROM found f WHERE (source_slug, domain) IN (SELECT (source_slug, domain) FROM allowed) OR (source_slug = 'src6' AND domain IN (SELECT domain FROM allowed))")
def link_allow_list(spark, d):
    allowed = V.queue(spark, d).where("priority <= 20 and source_slug <> 'src6'").select("source_slug", "domain").distinct()
    return T.link_allow_list(_links(spark, d), allowed)


@query(FOUND + " SELECT normalized_url, CAST(min(depth) + 1 AS INT) AS depth FROM found WHERE normalized_url NOT IN (SELECT normalized_url FROM queue) GROUP BY 1")
def frontier_anti_join(spark, d):
    return T.frontier_anti_join(_links(spark, d), V.queue(spark, d))
