"""Windowed aggregates over event time, the same for batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(time, watermark) if watermark and df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, by: list[str], aggs: list[Column], slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(window_start, window_end, by, aggregates). With ``slide`` windows overlap. Rows with a null time belong to no window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = _late(df, time, watermark).groupBy(w.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggs: list[Column], watermark: str | None = None) -> DataFrame:
    """(session_start, session_end, by, aggregates): activity of a key without a pause of ``gap``; the end is the last event plus ``gap``."""
    out = _late(df, time, watermark).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def once(df: DataFrame, id_cols: list[str], time: str, watermark: str) -> DataFrame:
    """One copy of each identifier within the watermark; state older than that is forgotten."""
    return df.withWatermark(time, watermark).dropDuplicatesWithinWatermark(id_cols)
