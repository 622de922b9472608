"""Event-time operations that hold for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, time: str = "ts", late: str | None = None) -> DataFrame:
    """df with `time` as a timestamp, and a watermark on streams."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if df.isStreaming and late else df


def tumbling(df: DataFrame, width: str, keys: list[str], *aggregates: Column, time: str = "ts", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates by window (start, stop) and keys."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = event_time(df, time, late).groupBy(window.alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), *keys, *(c for c in out.columns if c not in ("_w", *keys)))


def sessions(df: DataFrame, gap: str, keys: list[str], *aggregates: Column, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Aggregates by session: events of the keys with less than `gap` between them."""
    out = event_time(df, time, late).groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), *keys, *(c for c in out.columns if c not in ("_w", *keys)))


def distinct_events(df: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One event for each value of keys; on streams, within the watermark."""
    df = event_time(df, time, late)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
