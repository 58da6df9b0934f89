"""Bars over streams: an extension, the batch queries' twin on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def streaming_bars(ticks: DataFrame, symbol: str, ts: str, price: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """OHLC bars per symbol and window; ticks later than ``late`` behind the newest are dropped, and their state with them."""
    marked = ticks.withWatermark(ts, late)
    return marked.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count("*").alias("ticks")
    ).select("symbol", F.col("w.start").alias("bucket_start"), "open", "high", "low", "close", "ticks")


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once among rows no further apart than ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
