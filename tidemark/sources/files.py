"""Files on whatever file system Spark writes to, through its own Hadoop client; and what tells one file's content from another's."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Files:
    """The few calls the store needs, for local, HDFS-like and object stores alike."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def absolute(self, path: str) -> str:
        fs, p = self._at(path)
        return fs.makeQualified(p).toString().rstrip("/")

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")] if fs.exists(p) else []

    def matching(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []) if s.isFile())

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, content: str | bytes) -> None:
        """A whole file under a name that must be free; raises if it is taken."""
        data = content.encode() if isinstance(content, str) else content
        fs, p = self._at(path)
        partial = self.jvm.org.apache.hadoop.fs.Path(f"{path}.partial-{hashlib.md5(data).hexdigest()}")
        stream = fs.create(partial, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if fs.exists(p):
            fs.delete(partial, False)
            raise FileExistsError(path)
        self.rename(partial.toString(), path)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        target = self.jvm.org.apache.hadoop.fs.Path(new)
        if fs.exists(target) or not fs.rename(p, target):
            raise FileExistsError(new)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def shard_of(path: Column) -> Column:
    """The folder's name of a file in it."""
    return F.element_at(F.split(path, "/"), -2)


def open_anywhere(path: str):
    """A seekable stream of a file, opened where the task runs."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def fingerprints(spark: SparkSession, pattern: str, block: int = 1 << 24) -> DataFrame:
    """(name, bytes, sha256, rows, row_groups) of each Parquet file, read in blocks where the task runs; one file is one task's work."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.path:
                with open_anywhere(path) as f:
                    digest = hashlib.sha256()
                    while chunk := f.read(block):
                        digest.update(chunk)
                    size = f.tell()
                    f.seek(0)
                    meta = pq.ParquetFile(f).metadata
                yield pd.DataFrame([(path.rpartition("/")[2], size, digest.hexdigest(), meta.num_rows, meta.num_row_groups)], columns=["name", "bytes", "sha256", "rows", "row_groups"])

    return path_tasks(spark, Files(spark).matching(pattern)).mapInPandas(look, "name string, bytes bigint, sha256 string, rows bigint, row_groups int")


def path_tasks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path): one partition for each file, so that each is opened by its own task."""
    if not paths:
        return spark.createDataFrame([], "path string")
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")


def same_artifact(record: dict, found: dict) -> bool:
    """Whether a file is the one that was recorded."""
    return all(record.get(k) == found.get(k) for k in ("bytes", "sha256", "rows", "row_groups"))


def write_evidence(spark: SparkSession, path: str, rows: DataFrame, most: int = 10000) -> int:
    """A report's few rows as JSON in one new file; more than ``most`` rows is an error, as such results belong into tables."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    content = json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, default=str, sort_keys=True)
    Files(spark).write_new(path, content)
    return len(found)
