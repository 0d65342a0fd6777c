"""Streams of events: windowed counts with late data, and buffered appends without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and value of each event type in each window; works on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str, late_column: str, late: str = "1 day"):
    """Append rows whose key was not seen within the lateness; each micro-batch is one atomic write."""
    fresh = stream.withColumn(late_column, F.col(late_column).cast("timestamp")).withWatermark(late_column, late).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
