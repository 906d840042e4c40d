"""Event streams: deduplicated searches, clicks joined to them, windows, and merges of queue batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Event files as they arrive; ts becomes an instant, which watermarks need."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    key = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.get_json_object("props", "$.k"))
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("search_id", key)


def searches(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each search_id within the watermark."""
    s = events.where("event_type = 'view'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["search_id"])
    return s.select("search_id", F.col("ts").alias("searched_at"), F.col("value").alias("latency_ms"))


def with_clicks(events: DataFrame, late: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """Searches with the clicks that follow within a time; those without come out, with nulls, when the watermark has passed them."""
    s = searches(events, late)
    c = events.where("event_type = 'click'").select(F.col("search_id").alias("click_search_id"), F.col("ts").alias("clicked_at")).withWatermark("clicked_at", late)
    on = F.expr(f"search_id = click_search_id and clicked_at >= searched_at and clicked_at <= searched_at + interval {within}")
    return s.join(c, on, "left_outer").select("search_id", "searched_at", "latency_ms", "clicked_at")


def daily_counts(events: DataFrame, late: str = "1 hour", length: str = "30 days", step: str = "1 day") -> DataFrame:
    """Events and mean value by type over trailing windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "event_type")
    return w.agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value")).select(F.col("window.end").alias("until"), "event_type", "events", "mean_value")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs what has arrived to the end and stops, as a worker does that drains its queue."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def merge_batches(batches: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], base: str, checkpoint: str) -> None:
    """Each micro-batch gives the next version of a snapshot under `base`; a batch that is run again writes its version anew."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{base}/version={number - 1}") if number else None
        merge(old, batch).write.mode("overwrite").parquet(f"{base}/version={number}")

    batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
