"""Readers of bar archives: zipped CSV and fixed-width binary files. Each file is opened in its own task and read in blocks."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.files import Files, open_anywhere, path_tasks

#: One packed bar; prices in thousandths, time in seconds since 1970 (UTC).
BAR = np.dtype([("seconds", "<u4"), ("open", "<i4"), ("high", "<i4"), ("low", "<i4"), ("close", "<i4"), ("volume", "<i8"), ("amount", "<i8")])
MAGIC, HEADER = b"BARS", 16


def zipped_csv(spark: SparkSession, paths: str, columns: list[str], years: tuple[int, int] | None = None, rows: int = 65536) -> DataFrame:
    """(member, columns): the rows of every CSV member of every zip file, texts as they stand.

    A file is opened where its task runs and a member read in blocks of ``rows``, so memory doesn't grow with either; absent trailing
    fields are null. ``years`` keeps members whose name begins with a year in that range.
    """
    schema = "member string, " + ", ".join(f"`{c}` string" for c in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                with open_anywhere(path) as raw, zipfile.ZipFile(raw) as z:
                    for name in sorted(z.namelist()):
                        year = name.rpartition("/")[2][:4]
                        if not name.endswith(".csv") or (years and not (year.isdigit() and years[0] <= int(year) <= years[1])):
                            continue
                        with z.open(name) as f:
                            for part in pd.read_csv(f, header=None, names=columns, dtype=str, chunksize=rows, keep_default_na=False, na_values=[""]):
                                part.insert(0, "member", name)
                                yield part.astype(object).where(part.notna(), None)

    return path_tasks(spark, Files(spark).matching(paths)).mapInPandas(read, schema)


def binary_bars(spark: SparkSession, paths: str, offset_hours: int = 8, lot: int = 1, daily: bool = False, rows: int = 65536) -> DataFrame:
    """(path, trade_date, bar_time, prices, volume, amount) of packed bar files; the time is moved to the market's zone.

    ``lot`` is the number of shares in a unit of volume. Files of ``daily`` bars have no time of day: theirs is null. A file that doesn't begin
    with the magic bytes, or whose records aren't whole, fails the read. Records are read in blocks of ``rows``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                with open_anywhere(path) as f:
                    if f.read(HEADER)[: len(MAGIC)] != MAGIC or (f.size() - HEADER) % BAR.itemsize:
                        raise ValueError(f"not a bar file: {path}")
                    while block := f.read(rows * BAR.itemsize):
                        bars = np.frombuffer(block, BAR)
                        at = pd.to_datetime(bars["seconds"].astype("int64") + offset_hours * 3600, unit="s")
                        out = pd.DataFrame({"path": path, "trade_date": at.strftime("%Y-%m-%d"), "bar_time": None if daily else at.strftime("%H%M%S") + "000"})
                        for name in ("open", "high", "low", "close"):
                            out[name] = bars[name] / 1000.0
                        yield out.assign(volume=bars["volume"].astype(float) * lot, amount=bars["amount"].astype(float))

    schema = "path string, trade_date string, bar_time string, open double, high double, low double, close double, volume double, amount double"
    return path_tasks(spark, Files(spark).matching(paths)).mapInPandas(read, schema)


def partitioned_sink(df: DataFrame, path: str, by: list[str]) -> None:
    """A hive layout; only the partitions that ``df`` has are overwritten. Rows go to their partition's task first, so files stay few."""
    df.repartition(*[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
