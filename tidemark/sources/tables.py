"""Readers of the project's tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; filters and column pruning reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Several Parquet files, columns united by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def overlapping(shards: Iterable[dict], start: str, end: str) -> list[dict]:
    """The shards whose date range meets [start, end]; a shard without dates always stays."""
    kept = []
    for shard in shards:
        low, high = shard.get("date_start"), shard.get("date_end")
        if low is None or high is None or (high >= start and low <= end):
            kept.append(shard)
    return kept


def register_views(spark: SparkSession, folder: str, days: dict[str, str | None], start: str, end: str, prefix: str = "") -> list[str]:
    """S3: a temporary view of each table, bounded to [start, end] by its column of dates (``YYYY-MM-DD``), unbounded where that is None.

    Views are plans: nothing is read until a query asks, and the bounds reach the scan.
    """
    names = []
    for name, day in days.items():
        rows = table(spark, folder, name)
        (rows if day is None else rows.where(F.col(day).between(start, end))).createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


def batches(df: DataFrame, rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """The result as Arrow batches of at most ``rows`` rows, one partition at a time: the driver never holds more than one partition's batches."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    for row in df.mapInArrow(pack, "batch binary").toLocalIterator():
        yield from pa.ipc.open_stream(row.batch)


def picked(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose ``column`` is in a list that the caller holds, joined as a small table; repeated and null values change nothing."""
    kind = df.schema[column].dataType
    wanted = df.sparkSession.createDataFrame([(v,) for v in {*values} - {None}], f"`{column}` {kind.simpleString()}")
    return df.join(wanted, column, "left_semi")


def line_order() -> Column:
    """Order, line and part as one number in their order, by which prices aggregate without a sort: lines below 10^5, parts below 10^15."""
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    return (whole("l_orderkey") * F.expr("cast(1e20 as decimal(21,0))") + whole("l_linenumber") * F.expr("cast(1e15 as decimal(16,0))") + whole("l_partkey")).cast("decimal(38,0)")


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """A1 over lineitem: (symbol, trade_date) OHLCV bars.

    lineitem has repeated (orderkey, linenumber) pairs, so first and last prices take the part into their order; lines equal in
    all three are copies.
    """
    trades = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
        line_order().alias("seq"),
    )
    return ohlcv(trades, ["symbol", "trade_date"], "seq")


def ohlcv(trades: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A1: open, high, low, close, volume and amount of each key, in one partial aggregation."""
    return trades.groupBy(*keys).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
    )
