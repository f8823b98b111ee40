"""Structured Streaming over an event stream: an extension, for data that arrive late and without an end.

Late rows are bounded by a watermark; windows close once it has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100, glob: str = "*.parquet") -> DataFrame:
    """Files of a folder whose names fit the pattern, as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and type."""
    g = _timed(events, late).groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    g = _timed(events, late).groupBy(F.window("at", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    g = _timed(events, late).groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
