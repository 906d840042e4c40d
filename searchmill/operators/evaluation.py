"""Relevance and latency evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_at_k(results: DataFrame, specs: DataFrame) -> DataFrame:
    """(query, source, hit): whether any of the query's fragments is in one of its first k result URLs, case aside.

    results (query, rank, url); specs (query, source, fragments, k). A query without results is a miss.
    """
    j = specs.join(results, "query", "left").where(F.col("rank").isNull() | (F.col("rank") <= F.col("k")))
    found = F.exists("fragments", lambda f: F.contains(F.lower("url"), F.lower(f)))
    seen = j.groupBy("query").agg(F.max(F.coalesce(found, F.lit(False)).cast("int")).alias("hit"))
    return specs.join(seen, "query", "left").select("query", "source", F.coalesce("hit", F.lit(0)).alias("hit"))


def pass_rate(hits: DataFrame, *by: str, threshold: float = 0.7) -> DataFrame:
    """queries, hits, rate and passed, in all or by the columns given."""
    rate = F.avg("hit")
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("hits"), F.round(rate, 6).alias("rate"), (rate >= threshold).alias("passed"))


def nearest_rank(samples: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """The value at place round(share n), half to even, within the ordered samples; ranked by a window that spills, no arrays."""
    w = Window.partitionBy(by)
    r = samples.select(by, value).withColumns({"r": F.row_number().over(w.orderBy(value)), "n": F.count(F.lit(1)).over(w)})
    place = F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("n") * F.lit(share)).cast("bigint")))
    return r.where(F.col("r") == place).select(by, F.col(value).alias("p_nearest"), F.col("n").alias("samples"))


def bench_summary(samples: DataFrame, by: str) -> DataFrame:
    """Mean latency and hits, and the sorted distinct modes, of samples (by, latency_ms, results_count, mode)."""
    return samples.groupBy(by).agg(
        F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.round(F.avg("results_count"), 4).alias("mean_hits"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes")
    )
