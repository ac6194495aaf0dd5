"""Event-time windows; each function takes a static or a streaming DataFrame alike.

On a stream the watermark bounds the state: windows closed by it are emitted once and dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _late(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, lateness) if df.isStreaming else df


def _measured(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


def tumbling(df: DataFrame, ts: str = "ts", size: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(event_type, window_start, events, total) of every window that holds an event."""
    got = _measured(_late(df, ts, lateness).groupBy(F.window(ts, size), "event_type"))
    return got.select("event_type", F.col("window.start").alias("window_start"), "events", "total")


def sliding(df: DataFrame, ts: str = "ts", size: str = "1 day", step: str = "6 hours", lateness: str = "10 minutes") -> DataFrame:
    """(event_type, window_start, events, total) of every overlapping window."""
    got = _measured(_late(df, ts, lateness).groupBy(F.window(ts, size, step), "event_type"))
    return got.select("event_type", F.col("window.start").alias("window_start"), "events", "total")


def sessions(df: DataFrame, ts: str = "ts", gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, events, total); a session ends after ``gap`` without an event."""
    got = _measured(_late(df, ts, lateness).groupBy(F.session_window(ts, gap), "user_id"))
    return got.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events", "total")


def first_seen(df: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Rows without repetitions of ``keys``; on a stream within the watermark."""
    late = _late(df, ts, lateness)
    return late.dropDuplicatesWithinWatermark(keys) if df.isStreaming else late.dropDuplicates(keys)


def settled_files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """A stream of the JSON rows of files that land in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)
