"""Progress and session streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def progress_changes(events: DataFrame) -> DataFrame:
    """Batch form: events (key, seq, step, percent) whose step or percent differs from the one before of the same key."""
    w = Window.partitionBy("key").orderBy("seq")
    e = events.withColumn("_s", F.lag("step").over(w)).withColumn("_p", F.lag("percent").over(w)).withColumn("_n", F.row_number().over(w))
    return e.where((F.col("_n") == 1) | ~F.col("_s").eqNullSafe(F.col("step")) | ~F.col("_p").eqNullSafe(F.col("percent"))).drop("_s", "_p", "_n")


def stream_progress(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming form (key, ts, step, percent): a state of a key is emitted once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key", "step", "percent"])


def stream_sessions(events: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key (key, ts) that end after ``gap`` without an event; emitted when the watermark passes their end."""
    g = events.withWatermark("ts", delay).groupBy("key", F.session_window("ts", gap).alias("_w")).agg(F.count("*").alias("events"))
    return g.select("key", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def stream_counts(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by key and tumbling window."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("_w"), "key").agg(F.count("*").alias("events"))
    return g.select("key", F.col("_w.start").alias("start"), "events")
