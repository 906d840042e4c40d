"""Projection of results, batches, id resolution and the synthetic corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOPICS = {  # with the tags of each
    "search-ranking": "ranking relevance search",
    "crawler-design": "crawler python queues",
    "index-maintenance": "indexing etl operations",
    "frontend-search": "web typescript ux",
    "analytics-pipelines": "analytics sql metrics",
    "retrieval-tuning": "search latency performance",
    "deduplication": "content hashing quality",
    "metadata-storage": "sql schema storage",
}
_HOSTS = ("docs", "blog", "kb", "guides")


def result_projection(found: DataFrame) -> DataFrame:
    """What a hit shows, with defaults for what is missing; an empty body stays an empty snippet."""
    return found.select(
        "id",
        "url",
        "domain",
        "source_slug",
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        "content_type",
        "section_path",
        F.coalesce("meta_description", F.lit("")).alias("snippet"),
        F.coalesce("code_block_count", F.lit(0)).alias("code_block_count"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("freshness_status", F.lit("unknown")).alias("freshness_status"),
        F.filter(F.array("title", "meta_description"), lambda x: F.coalesce(x != "", F.lit(False))).alias("highlights"),
    )


def dedupe_cap(values: Column, most: int = 20) -> Column:
    """Trimmed, without empty ones and repeats, in order, the first `most`."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return F.slice(F.array_distinct(kept), 1, most)


def toggled(values: Column, value: Column) -> Column:
    """Without the value if it is there, else with it at the end."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


def worth_running(q: Column, lists: list[Column], within: Column) -> Column:
    """Whether a request asks for anything: a query, a filter value or an age; date bounds alone don't count."""
    filters = sum((F.coalesce(F.size(v), F.lit(0)) for v in lists), F.lit(0))
    return (F.trim(q) != "") | (filters > 0) | within.isNotNull()


def mode(search_up: Column, database_up: Column, demo_allowed: Column) -> Column:
    """How the service answers by which of its two backends are up."""
    return F.when(search_up & database_up, "live").when(search_up | database_up, "degraded").when(demo_allowed, "demo").otherwise("unavailable")


def request_problem(q: Column, page: Column, limit: Column, sort: Column, first: Column, last: Column) -> Column:
    """What a strict service refuses about a request, null for nothing."""
    day = r"^\d{4}(-\d\d){2}$"
    bad = lambda d: d.isNotNull() & ~d.rlike(day)
    return (
        F.when(F.length(F.trim(q)) > 200, "q")
        .when(~page.between(1, 10_000), "page")
        .when(~limit.between(1, 50), "limit")
        .when(~sort.isin("relevance", "newest", "oldest"), "sort")
        .when(bad(first) | bad(last), "date")
        .when(first > last, "range")
    )


def address(q: Column, sources: Column, sort: Column, page: Column) -> Column:
    """URL parameters of a request, defaults left out."""
    listed = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("source="), F.url_encode(s))), "&")
    parts = [F.when(q != "", F.concat(F.lit("q="), F.url_encode(q))), F.when(listed != "", listed), F.when(sort != "relevance", F.concat(F.lit("sort="), sort)), F.when(page != 1, F.concat(F.lit("page="), page.cast("string")))]
    return F.concat_ws("&", *parts)


def batch_number(n: Column, size: int) -> Column:
    return F.floor((n - 1) / size)


def resolve_ids(children: DataFrame, stored: DataFrame) -> DataFrame:
    """children (url, ...) with the id that the store has for their URL."""
    return children.join(stored.select("url", "id"), "url")


def synthetic_corpus(spark: SparkSession, n: int) -> DataFrame:
    """n made-up documents, topics, hosts and languages taking turns; any n is made in parallel."""
    i = F.col("doc_number")

    def turn(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), ((i - 1) % len(values) + 1).cast("int"))

    base = spark.range(1, n + 1).select(F.col("id").alias("doc_number")).withColumns({"topic": turn(list(_TOPICS)), "tags": F.split(turn(list(_TOPICS.values())), " "), "domain": F.concat(turn(_HOSTS), F.lit(".synthetic.local"))})
    label = F.replace("topic", F.lit("-"), F.lit(" "))
    body = F.concat(F.lit("Document "), i.cast("string"), F.lit(" covers "), label, F.lit(" on "), "domain", F.lit(". "), F.repeat(F.concat(F.lit("Notes about "), label, F.lit(" and how it is measured. ")), 5))
    return base.select(
        "doc_number",
        "topic",
        F.concat(F.lit("https://"), "domain", F.lit("/"), "topic", F.lit("/doc-"), F.when(i < 100_000, F.lpad(i.cast("string"), 5, "0")).otherwise(i.cast("string"))).alias("url"),
        "domain",
        F.concat(F.initcap(label), F.lit(" Reference "), i.cast("string")).alias("title"),
        F.concat(F.lit("Synthetic search document "), i.cast("string"), F.lit(" focused on "), label, F.lit(".")).alias("meta_description"),
        F.trim(body).alias("body"),
        F.when(i % 4 == 0, F.lit("es")).otherwise(F.lit("en")).alias("language"),
        "tags",
        (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval((i % 365).cast("int"))).alias("published_at"),
        (i % 5 + 6).cast("int").alias("boost_score"),
    )
