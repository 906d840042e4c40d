"""Queue and store state as pure functions from one snapshot and a batch to the next snapshot.

Parquet has no keyed update, so each function returns the whole next snapshot, to
be written beside the old one. Time is a parameter. Batches carry an `arrival`
that orders rows of one key; without it the order of a batch would decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchmill.functions import columns as C

LINKS = 50  # of a page, at most, before any filter


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def enqueue_merge(queue: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """Upsert on normalized_url of batch (url, normalized_url, domain, depth, source_url, source_slug, priority, arrival).

    The first arrival gives url, domain and source_url for good; depth and priority
    take the least; a known source stays, an unknown one takes the first named.
    When a queued row without a source gets one it is due again.
    """
    first = F.min_by(F.struct("url", "domain", "source_url"), "arrival")
    b = batch.groupBy("normalized_url").agg(
        first.alias("f"),
        F.min("depth").alias("new_depth"),
        F.min("priority").alias("new_priority"),
        F.min_by("source_slug", F.when(F.col("source_slug").isNotNull(), F.col("arrival"))).alias("new_slug"),
    )
    j = queue.join(b, "normalized_url", "full_outer")
    old = F.col("status").isNotNull()
    again = ~old | (F.col("source_slug").isNull() & F.col("new_slug").isNotNull())
    return j.select(
        F.coalesce("id", F.xxhash64("normalized_url")).alias("id"),
        F.when(old, F.col("url")).otherwise(F.col("f.url")).alias("url"),
        "normalized_url",
        F.when(old, F.col("domain")).otherwise(F.col("f.domain")).alias("domain"),
        F.least("depth", "new_depth").alias("depth"),
        F.when(old, F.col("source_url")).otherwise(F.col("f.source_url")).alias("source_url"),
        F.coalesce("source_slug", "new_slug").alias("source_slug"),
        F.when(again, F.lit("pending")).otherwise(F.col("status")).alias("status"),
        F.least("priority", "new_priority").alias("priority"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.when(again, at(now)).otherwise(F.col("scheduled_at")).alias("scheduled_at"),
        F.when(~again, F.col("processed_at")).alias("processed_at"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str, keep=(), fixed: dict[str, Column] | None = None) -> DataFrame:
    """Rows of both by key; a new row replaces all columns of the old one but those in `keep`. fixed: columns that a replaced or added row gets."""
    n = new.withColumn("is_new", F.lit(True)).select(F.col(key).alias("new_key"), "is_new", F.struct(*[c for c in new.columns if c != key]).alias("n"))
    j = old.withColumn("is_old", F.lit(True)).join(n, F.col(key) == F.col("new_key"), "full_outer")
    fresh, there = F.coalesce("is_new", F.lit(False)), F.coalesce("is_old", F.lit(False))
    out = []
    for c in old.columns:
        if c == key:
            out.append(F.coalesce(key, "new_key").alias(key))
        elif fixed and c in fixed:
            out.append(F.when(fresh & ~(there & F.lit(c in keep)), fixed[c]).otherwise(F.col(c)).alias(c))
        elif c not in new.columns:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.when(there, F.col(c)).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c))
    return j.select(*out)


def upsert_documents(store: DataFrame, parsed: DataFrame, now: str) -> DataFrame:
    """Recrawled documents replace what is stored under their URL; the id stays, the status starts over."""
    return upsert(store, parsed, "url", keep=("id",), fixed={"status": F.lit("stored"), "last_crawled_at": at(now)})


def upsert_sources(registry: DataFrame, config: DataFrame) -> DataFrame:
    """Metadata follows the configuration; a known source keeps its crawl status, a new one is pending."""
    return upsert(registry, config, "slug", keep=("crawl_status",), fixed={"crawl_status": F.lit("pending")})


def delete_by_domain(docs: DataFrame, domains: list[str]) -> DataFrame:
    """What is left when documents without a source go from the given domains."""
    gone = F.col("source_slug").isNull() & F.col("domain").isin(domains)
    return docs.where(~F.coalesce(gone, F.lit(False)))


def due(queue: DataFrame, now: str) -> DataFrame:
    return queue.where((F.col("status") == "pending") & (F.col("scheduled_at") <= at(now)))


def dequeue_batch(queue: DataFrame, now: str, limit: int = 10) -> DataFrame:
    """The next `limit` due rows by priority, time and id, in processing."""
    picked = due(queue, now).orderBy("priority", "scheduled_at", "id").limit(limit)
    return picked.withColumn("status", F.lit("processing"))


def take_batch(queue: DataFrame, now: str, limit: int = 10) -> DataFrame:
    """The snapshot after `dequeue_batch`."""
    ids = dequeue_batch(queue, now, limit).select("id", F.lit(True).alias("taken"))
    return queue.join(ids, "id", "left").withColumn("status", F.when(F.col("taken"), F.lit("processing")).otherwise(F.col("status"))).drop("taken")


def requeue_stale(queue: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """Rows in processing that were scheduled longer ago than that are pending again."""
    stale = (F.col("status") == "processing") & (F.col("scheduled_at") < at(now) - F.make_dt_interval(mins=F.lit(minutes)))
    return queue.withColumn("status", F.when(stale, F.lit("pending")).otherwise(F.col("status")))


def queue_transitions(queue: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """updates (id, new_status, new_retry_count): the count changes only if given; what changed was processed now."""
    j = queue.join(updates, "id", "left")
    hit = F.col("new_status").isNotNull()
    return j.withColumns(
        {
            "status": F.coalesce("new_status", "status"),
            "retry_count": F.coalesce("new_retry_count", "retry_count"),
            "processed_at": F.when(hit, at(now)).otherwise(F.col("processed_at")),
        }
    ).select(*queue.columns)


def mark_index_status(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (id, index_status); only indexed and index_failed count."""
    u = updates.where(F.col("index_status").isin("indexed", "index_failed"))
    return docs.join(u, "id", "left").withColumn("status", F.coalesce("index_status", "status")).select(*docs.columns)


def retry_policy(failures: DataFrame, now: str, most: int = 3) -> DataFrame:
    """failures (id, retry_count, status_code): pending again after a growing delay, or failed."""
    again = C.should_retry(F.col("retry_count"), F.col("status_code"), most)
    n = F.col("retry_count") + 1
    delay = C.retry_delay(n)
    return failures.select(
        "id",
        F.when(again, F.lit("pending")).otherwise(F.lit("failed")).alias("status"),
        F.when(again, n).otherwise(F.col("retry_count")).cast("int").alias("retry_count"),
        F.when(again, at(now) + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))).alias("scheduled_at"),
    )


def depth_gate(queue: DataFrame, limits: DataFrame, global_max: int) -> DataFrame:
    """queue with skip (deeper than its source allows) and discover (its links may still be followed); limits (source_slug, max_depth)."""
    cap = C.depth_cap(F.col("max_depth"), F.lit(global_max))
    return queue.join(limits, "source_slug", "left").select("id", "source_slug", "depth", cap.alias("cap"), (F.col("depth") > cap).alias("skip"), (F.col("depth") < cap).alias("discover"))


def domain_slots(requests: DataFrame, delay: float) -> DataFrame:
    """requests (id, domain, t in seconds): slot, at least `delay` after the domain's slot before.

    s_i = max(t_i, s_(i-1) + d) has the closed form i d + max over j <= i of
    (t_j - j d), so a window does what the recurrence does.
    """
    w = Window.partitionBy("domain").orderBy("t", "id")
    numbered = requests.withColumn("i", F.row_number().over(w) - 1)
    slot = F.col("i") * delay + F.max(F.col("t") - F.col("i") * delay).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.select("id", "domain", "t", slot.alias("slot"))


def link_allow_list(links: DataFrame, allowed: DataFrame) -> DataFrame:
    """Links (source_slug, domain, ...) whose domain its source allows, or, for a source without a list, any source does."""
    named = links.join(allowed.select("source_slug", "domain"), ["source_slug", "domain"], "left_semi")
    rest = links.join(allowed.select("source_slug").distinct(), "source_slug", "left_anti")
    return named.unionByName(rest.join(allowed.select("domain").distinct(), "domain", "left_semi").select(*links.columns))


def frontier_anti_join(links: DataFrame, queue: DataFrame) -> DataFrame:
    """One row for each normalized URL that isn't queued yet."""
    return links.join(queue.select("normalized_url"), "normalized_url", "left_anti").groupBy("normalized_url").agg(F.min("depth").alias("depth"))


def discover(level: DataFrame, pages: DataFrame, depth: int) -> DataFrame:
    """(normalized_url, url, depth): targets of the first LINKS links of the level's pages (normalized_url, links)."""
    found = level.join(pages, "normalized_url").select(F.explode(F.slice("links", 1, LINKS)).alias("url"))
    return found.select(C.normalize_url(F.col("url")).alias("normalized_url"), "url").groupBy("normalized_url").agg(F.min("url").alias("url")).withColumn("depth", F.lit(depth))


def bfs_frontier(seeds: DataFrame, pages: DataFrame, max_depth: int) -> DataFrame:
    """(normalized_url, depth): all that a crawl from the seeds reaches in max_depth steps.

    pages (normalized_url, links) stands for what a fetch returns. Each level joins
    only what the level before has found new; the levels are as few as max_depth,
    so nothing is collected and the plan stays short.
    """
    seen = seeds.select("normalized_url").distinct().withColumn("depth", F.lit(0))
    level = seen
    for depth in range(1, max_depth + 1):
        level = discover(level, pages, depth).select("normalized_url", "depth").join(seen.select("normalized_url"), "normalized_url", "left_anti")
        seen = seen.unionByName(level)
    return seen


def source_doc_count(registry: DataFrame, counts: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Registry with recomputed doc_count, the status of the crawl and its times; the success time moves only on success."""
    j = registry.join(counts, "slug", "left").join(outcomes.select(F.col("source_slug").alias("slug"), F.col("crawl_status").alias("new_status"), "successful"), "slug", "left")
    crawled = F.col("new_status").isNotNull()
    return j.select(
        "slug",
        F.coalesce("doc_count", F.lit(0)).alias("doc_count"),
        F.coalesce("new_status", "crawl_status").alias("crawl_status"),
        F.when(crawled, at(now)).alias("last_crawled_at"),
        F.when(F.col("successful"), at(now)).alias("last_successful_crawl_at"),
    )
