"""Streaming trend counts: watermarked tumbling windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalogue as C


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n) of a stream or a table of events; rows later than the watermark are dropped by a stream only."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start"), "event_type", "n")


def stream_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan over the whole table."""
    return windowed_counts(C.table(spark, sf_dir, "events"))


QUERIES = {"stream_trending": (stream_trending, "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")}
