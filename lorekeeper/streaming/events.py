"""Streams of events: windows with late data, and graph upserts in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events from a folder of Parquet files, with ``ts`` as an instant."""
    raw = spark.readStream.schema(EVENTS).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; events later than ``late`` are left out of a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 6).alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n_events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events that follow each other within ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str):
    """Run each micro-batch through ``merge(current, batch)`` and write the result.

    The merge must give the same table when a batch comes twice, as it does after a failure.
    """

    def each(batch: DataFrame, _: int) -> None:
        write(merge(read(), batch))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
