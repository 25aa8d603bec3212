"""The metric log and call records as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import METRICS


def metric_stream(spark: SparkSession, path: str) -> DataFrame:
    """Metric events as they are appended, with their time as `ts`."""
    return spark.readStream.schema(METRICS).json(path).withColumn("ts", F.try_to_timestamp("timestamp"))


def event_counts(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by kind and window; events later than delay are dropped. Works on batches too."""
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", window).alias("w"), "event").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event", "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events at most gap apart."""
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    out = marked.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(calls: DataFrame, key: str = "id", delay: str = "1 day") -> DataFrame:
    """Call records whose key was not seen within delay before."""
    return calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
