"""Ranked search, its rules one by one, facets, demo mode, autocomplete and result texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchmill.functions import columns as C
from searchmill.operators import analytics as A
from searchmill.operators import search as S
from searchmill.sources import views as V

from .base import query

MANY = "the estion ndtion and"  # terms of several lengths, common and rare
PAIR = "the and"
RARE = "ingor"

ATTRS = " UNION ALL ".join(f"SELECT id, {i} AS attr, {f'array_to_string({a}, chr(32))' if a in ('tags', 'headings') else a} AS x FROM scored" for i, a in enumerate(S.ATTRIBUTES))
POSTS = f""", posts AS (SELECT id, attr, unnest(ws) AS term, unnest(range(0, len(ws))) AS pos FROM (SELECT id, attr, regexp_extract_all(lower(coalesce(x, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM ({ATTRS})))"""


def metrics_sql(q: str, prefix_last: bool = False) -> str:
    """Tables m (hits) and found (metrics of each document), by the definition of each rule."""
    terms = S.query_terms(q)
    hits = []
    for t, term in enumerate(terms):
        k = S.typos_allowed(term)
        plain = "regexp_replace(term, '[^\\x00-\\x7F]', '?', 'g')"
        prefix = prefix_last and t == len(terms) - 1
        typos = f"CASE WHEN starts_with(term, '{term}') THEN 0 ELSE levenshtein({plain}, '{term}') END" if prefix else f"levenshtein({plain}, '{term}')"
        where = f"levenshtein({plain}, '{term}') <= {k}" + (f" OR starts_with(term, '{term}')" if prefix else "")
        hits.append(f"SELECT id, attr, pos, {t} AS t, {typos} AS typos FROM posts WHERE {where}")
    gaps = [
        f"SELECT a.id, {t} AS t, least({S.FAR}, min(abs(a.pos - b.pos))) AS gap FROM m a JOIN m b ON a.id = b.id AND a.attr = b.attr AND a.t = {t} AND b.t = {t + 1} GROUP BY 1" for t in range(len(terms) - 1)
    ]
    near = f"{S.FAR * (len(terms) - 1)} + coalesce((SELECT sum(gap - {S.FAR}) FROM gaps WHERE gaps.id = base.id), 0)" if gaps else "0"
    return (
        POSTS
        + f", m AS ({' UNION ALL '.join(hits)})"
        + (f", gaps AS ({' UNION ALL '.join(gaps)})" if gaps else "")
        + ", base AS (SELECT id, count(*) AS words, CAST(sum(typos) AS BIGINT) AS typos, CAST(min(attr) AS BIGINT) AS attribute, count(*) FILTER (WHERE typos = 0) AS exactness FROM (SELECT id, t, min(typos) AS typos, min(attr) AS attr FROM m GROUP BY 1, 2) GROUP BY 1)"
        + f", found AS (SELECT scored.*, words, typos, attribute, exactness, CAST({near} AS BIGINT) AS proximity FROM base JOIN scored USING (id))"
    )


def order_sql(sort: str = "") -> str:
    return f"words DESC, typos, proximity, attribute, {sort + ',' if sort else ''} exactness DESC, authority DESC, boost_score DESC, id"


def _rule(q: str, name: str) -> str:
    return metrics_sql(q) + f" SELECT id, {name} FROM found"


def _metrics(spark, d, q):
    return S.rule_metrics(V.scored_docs(spark, d), S.query_terms(q))


@query(_rule(MANY, "words"))
def search_words(spark, d):
    return _metrics(spark, d, MANY).select("id", "words")


@query(_rule(MANY, "typos"))
def search_typo(spark, d):
    return _metrics(spark, d, MANY).select("id", "typos")


@query(_rule(PAIR, "proximity"))
def search_proximity(spark, d):
    return _metrics(spark, d, PAIR).select("id", "proximity")


@query(_rule(PAIR, "attribute"))
def search_attribute(spark, d):
    return _metrics(spark, d, PAIR).select("id", "attribute")


@query(_rule(MANY, "exactness"))
def search_exactness(spark, d):
    return _metrics(spark, d, MANY).select("id", "exactness")


def _page(q: str, where: str = "true", sort: str = "", first: int = 1, last: int = 10) -> str:
    return metrics_sql(q) + f" SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY {order_sql(sort)}) AS rank FROM found WHERE {where}) WHERE rank BETWEEN {first} AND {last}"


@query(_page(MANY, last=50))
def search_relevance(spark, d):
    found, keys = S.ranked(V.scored_docs(spark, d), MANY)
    return S.page(found, keys, 1, 50).select("id", "rank")


WHERE = "language IN ('en', 'fr') AND content_type IN ('guide', 'reference', 'api')"


def _where():
    return S.filters(languages=("en", "fr"), content_types=("guide", "reference", "api"))


@query(_page(PAIR, WHERE, first=11, last=20))
def search_page(spark, d):
    found, keys = S.ranked(V.scored_docs(spark, d), PAIR, _where())
    return S.page(found, keys, 2, 10).select("id", "rank")


@query(metrics_sql(PAIR) + f" SELECT count(*) AS total FROM found WHERE {WHERE}")
def search_total(spark, d):
    return S.ranked(V.scored_docs(spark, d), PAIR, _where())[0].agg(F.count(F.lit(1)).alias("total"))


@query(metrics_sql(PAIR) + f" SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) AS pages, CAST(least(99, greatest(1, ceil(count(*) / 10.0))) AS BIGINT) AS page FROM found WHERE {WHERE}")
def page_bounds(spark, d):
    return S.page_bounds(S.ranked(V.scored_docs(spark, d), PAIR, _where())[0], 99, 10)


@query(_page(RARE, first=11, last=20))
def result_rank(spark, d):
    found, keys = S.ranked(V.scored_docs(spark, d), RARE)
    return S.page(found, keys, 2, 10).select("id", "rank")


@query(_page(RARE, sort="published_at DESC, authority DESC"))
def sort_newest(spark, d):
    found, keys = S.ranked(V.scored_docs(spark, d), RARE, sort="newest")
    return S.page(found, keys).select("id", "rank")


@query(_page(RARE, sort="published_at"))
def sort_oldest(spark, d):
    found, keys = S.ranked(V.scored_docs(spark, d), RARE, sort="oldest")
    return S.page(found, keys).select("id", "rank")


@query(metrics_sql("the es", True) + f" SELECT title, min(rank) AS rank FROM (SELECT trim(title) AS title, row_number() OVER (ORDER BY {order_sql()}) AS rank FROM found) WHERE rank <= 8 AND title <> '' GROUP BY 1 ORDER BY 2 LIMIT 6")
def autocomplete(spark, d):
    return S.autocomplete(V.scored_docs(spark, d), "the es")


@query("SELECT title, min(id) AS id FROM (SELECT id, trim(title) AS title FROM docs) WHERE contains(lower(title), 'the') GROUP BY 1 ORDER BY 2 LIMIT 6")
def autocomplete_demo(spark, d):
    return S.autocomplete_demo(V.docs(spark, d), "The")


@query("SELECT id, row_number() OVER (ORDER BY boost_score DESC, id) AS rank FROM scored WHERE contains(lower(concat_ws(' ', title, meta_description, body, array_to_string(tags, ' '))), 'the and') AND language IN ('en', 'fr') AND content_type IN ('guide', 'reference', 'api') ORDER BY 2 LIMIT 10")
def demo_search(spark, d):
    found, keys = S.demo_search(V.scored_docs(spark, d), "The and", _where())
    return S.page(found, keys).select("id", "rank")


@query(POSTS + " SELECT attr, count(*) AS tokens, count(DISTINCT term) AS terms, count(DISTINCT id) AS documents FROM posts GROUP BY 1")
def postings_stats(spark, d):
    p = S.postings(V.scored_docs(spark, d))
    return p.groupBy("attr").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("term").alias("terms"), F.countDistinct("id").alias("documents"))


# facets: of the whole corpus, whatever is searched

COUNTS = " UNION ALL ".join(f"SELECT '{f}' AS facet, {f} AS value, count(*) AS n FROM docs WHERE {f} IS NOT NULL GROUP BY 2" for f in ("source_slug", "content_type", "domain", "language"))


@query(f"SELECT facet, value, n FROM ({COUNTS}) QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 50")
def facet_counts(spark, d):
    return S.facets(V.docs(spark, d))


@query("SELECT 'tags' AS facet, value, count(*) AS n FROM (SELECT unnest(tags) AS value FROM docs) WHERE value IS NOT NULL GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, value) <= 50")
def facet_tags(spark, d):
    return S.facets(V.docs(spark, d), ("tags",))


@query("SELECT content_type AS value, count(*) AS n, row_number() OVER (ORDER BY min(id)) AS place FROM docs GROUP BY 1")
def facet_first_seen(spark, d):
    return S.facet_first_seen(V.docs(spark, d), "content_type")


@query("SELECT s.slug, s.position, coalesce(n, 0) AS n FROM (VALUES (0, 'src3'), (1, 'src1'), (2, 'src4'), (3, 'src15'), (4, 'src30')) AS s(position, slug) LEFT JOIN (SELECT source_slug, count(*) AS n FROM docs GROUP BY 1) c ON c.source_slug = s.slug")
def facet_source_options(spark, d):
    return S.facet_options(A.static_sources(spark), S.facets(V.docs(spark, d), ("source_slug",)))


@query("SELECT language AS value, count(*) AS n FROM docs WHERE language IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def facet_languages_top8(spark, d):
    return S.facets(V.docs(spark, d), ("language",), 8).select("value", "n")


# texts of results


def _marked(x: str) -> str:
    once = f"regexp_replace(' ' || {x} || ' ', '(?i)([^\\p{{L}}\\p{{N}}])(the|and)([^\\p{{L}}\\p{{N}}])', '\\1<em>\\2</em>\\3', 'g')"
    twice = f"regexp_replace({once}, '(?i)([^\\p{{L}}\\p{{N}}>])(the|and)([^\\p{{L}}\\p{{N}}])', '\\1<em>\\2</em>\\3', 'g')"
    return f"({twice})[2:-2]"


CROPPED = """SELECT id, array_to_string(w[greatest(1, spot - 17):greatest(1, spot - 17) + 34], ' ') AS snippet FROM (SELECT id, w, coalesce(list_min(list_filter([list_position(b, 'the'), list_position(b, 'and')], lambda x: x > 0)), 1) AS spot
FROM (SELECT id, w, list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g')) AS b FROM (SELECT id, string_split(body, ' ') AS w FROM docs)))"""
MARKED = f"SELECT id, {_marked('title')} AS m_title, list_transform(headings, lambda h: {_marked('h')}) AS m_headings, {_marked('section_path')} AS m_section_path, {_marked('meta_description')} AS m_meta_description, {_marked('snippet')} AS m_body FROM docs JOIN ({CROPPED}) c USING (id)"


@query(MARKED)
def highlight(spark, d):
    return S.marked(V.docs(spark, d), S.query_terms(PAIR)).select("id", "m_title", "m_headings", "m_section_path", "m_meta_description", "m_body")


WHY = " ".join(f"CASE WHEN contains({x}, '<em>') THEN '{label}' END," for label, x in (("title", "m_title"), ("headings", "array_to_string(m_headings, ' ')"), ("section", "m_section_path"), ("description", "m_meta_description"), ("body", "m_body")))


@query(metrics_sql(PAIR) + f""", texts AS ({MARKED}), hits AS (SELECT id, title, url, source_name, row_number() OVER (ORDER BY {order_sql()}) AS rank, count(*) OVER () AS total FROM found WHERE {WHERE})
SELECT rank, id, title, url, source_name, m_body AS snippet, list_filter([m_title, m_meta_description], lambda x: x <> '') AS highlights, list_filter([{WHY[:-1]}], lambda x: x IS NOT NULL) AS why, total FROM hits JOIN texts USING (id) WHERE rank BETWEEN 11 AND 20""")
def search_response(spark, d):
    """The whole answer to a search: second page, filtered."""
    return S.response(V.scored_docs(spark, d), PAIR, _where(), number=2)


@query(CROPPED)
def snippet(spark, d):
    return V.docs(spark, d).select("id", S.snippet(F.col("body"), S.query_terms(PAIR)).alias("snippet"))


def _has(x: str) -> str:
    return f"regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}])(the|and)([^\\p{{L}}\\p{{N}}]|$)')"


@query(f"SELECT id, list_filter([CASE WHEN {_has('title')} THEN 'title' END, CASE WHEN {_has('section_path')} THEN 'section' END, CASE WHEN {_has('meta_description')} THEN 'description' END, CASE WHEN {_has('body')} THEN 'body' END], lambda x: x IS NOT NULL) AS why FROM docs")
def why_matched(spark, d):
    terms = S.query_terms(PAIR)
    fields = {"title": "title", "section": "section_path", "description": "meta_description", "body": "body"}
    return V.docs(spark, d).select("id", S.why_matched({k: S.highlight(F.col(c), terms) for k, c in fields.items()}).alias("why"))


@query("""SELECT search_id, CASE WHEN results_count > 0 OR query = '' THEN [] WHEN CAST(query[2:] AS INT) % 3 = 0 THEN ['flexbox', 'grid', 'custom properties', 'animations']
WHEN CAST(query[2:] AS INT) % 3 = 1 THEN ['useState', 'useEffect', 'Server Components', 'React hooks'] ELSE ['useState', 'async/await', 'SQL joins', 'TypeScript generics'] END AS suggestions FROM searches""")
def recovery_suggestions(spark, d):
    k = F.substring("query", 2, 9).cast("int") % 3
    q = F.when(F.col("query") == "", F.lit("")).when(k == 0, F.concat("query", F.lit(" CSS html"))).when(k == 1, F.concat("query", F.lit(" React next"))).otherwise(F.col("query"))
    return V.searches(spark, d).select("search_id", S.recovery_suggestions(q, F.col("results_count")).alias("suggestions"))
