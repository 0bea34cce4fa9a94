"""Windowed counts over a stream of events: an extension, the batch operators have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; rows later than ``late`` are dropped when streaming."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
