"""The same views in DuckDB SQL, as common table expressions that each oracle starts with."""

AS_OF = "TIMESTAMP '2024-02-05 00:00:00'"

# normalised URL of a page URL: the pages carry plain parameters only
NORMAL = (
    "lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || "
    "CASE WHEN regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') END || "
    "CASE WHEN len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid)'))) = 0 THEN '' "
    "ELSE '?' || array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid)')), '&') END"
)

VIEWS = f"""
WITH keyed AS (
  SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k') AS k,
         CAST(user_id AS VARCHAR) || ':' || json_extract_string(props, '$.k') AS search_id FROM events
), searches AS (
  SELECT search_id, user_id AS session_id, CASE WHEN k = '0' THEN '' ELSE 'q' || k END AS query,
         CAST(floor(value) AS BIGINT) % 5 AS results_count, value AS latency_ms, ts AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS rn FROM keyed WHERE event_type = 'view') WHERE rn = 1
), clicks AS (
  SELECT event_id, search_id, event_id % 200 AS clicked_document_id, event_id % 10 + 1 AS result_rank, ts AS created_at FROM keyed WHERE event_type = 'click'
), cleaned AS (
  SELECT doc_id AS id, text, lang, source, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS body FROM documents
), docs AS (
  SELECT id, 'https://' || source || '.example.com/' || lang || '/' || id AS url, source || '.example.com' AS domain, source AS source_slug,
         ['guide','reference','tutorial','api','blog'][CAST(id % 5 + 1 AS INT)] AS content_type,
         CASE WHEN id % 2 = 0 THEN '' ELSE lang || ' > ' || source END AS section_path,
         body[1:60] AS title, list_filter([body[181:220], body[221:260]], lambda x: x <> '') AS headings, 'Source ' || source[4:] AS source_name, body[61:180] AS meta_description, body, lang AS language, [lang, 't' || (id % 8)] AS tags, sha256(text) AS content_hash,
         CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END AS word_count, id % 3 AS code_block_count,
         CAST(CAST(source[4:] AS INT) % 11 AS DOUBLE) AS authority, id % 4 AS depth,
         CASE WHEN id % 10 = 0 THEN 'index_failed' ELSE 'indexed' END AS status,
         TIMESTAMP '2025-01-01' + to_days(CAST(id % 365 AS INT)) AS published_at,
         {AS_OF} - to_days(CAST(id % 120 AS INT)) AS last_updated_at, {AS_OF} - to_days(CAST(id % 120 AS INT)) AS last_crawled_at
  FROM cleaned
), scored AS (
  SELECT *, CAST((CASE WHEN title <> '' THEN 2 ELSE 0 END) + (CASE WHEN meta_description <> '' THEN 1 ELSE 0 END) + (CASE WHEN word_count BETWEEN 300 AND 5000 THEN 2 ELSE 0 END)
         + (CASE WHEN depth <= 1 THEN 1 ELSE 0 END) + (CASE WHEN code_block_count > 0 THEN 1 ELSE 0 END) + (CASE WHEN section_path <> '' THEN 1 ELSE 0 END)
         + least(5, CAST(floor(authority / 2) AS INT)) AS INT) AS boost_score FROM docs
), registry AS (
  SELECT 'src' || n_nationkey AS slug, n_name AS name, CAST(n_nationkey % 11 AS DOUBLE) AS authority_weight,
         [12, 48, 168, 336, 720, 1440][CAST(n_nationkey % 6 + 1 AS INT)] AS crawl_cadence_hours,
         ['healthy', 'crawling', 'failing', 'seeded'][CAST(n_nationkey % 4 + 1 AS INT)] AS crawl_status, 'about ' || lower(n_name) AS description FROM nation
), queue AS (
  SELECT page_id AS id, url, {NORMAL} AS normalized_url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS domain, page_id % 4 AS depth,
         'src' || (page_id % 7) AS source_slug, ['pending','processing','done','failed','skipped'][CAST(page_id % 5 + 1 AS INT)] AS status,
         page_id % 5 * 10 AS priority, page_id % 5 AS retry_count, TIMESTAMP '2024-02-04 23:00:00' + to_minutes(page_id % 120) AS scheduled_at,
         CASE WHEN page_id % 5 >= 2 THEN TIMESTAMP '2024-02-04 23:05:00' + to_minutes(page_id % 120) END AS processed_at FROM pages
), crawl_logs AS (
  SELECT page_id AS id, url, CASE WHEN page_id % 5 <= 1 THEN 200 WHEN page_id % 5 = 2 THEN 404 WHEN page_id % 5 = 3 THEN 500 END AS status_code,
         page_id % 400 AS response_time_ms, CASE WHEN page_id % 5 = 4 THEN 'connection reset' END AS error_message FROM pages
)
"""
