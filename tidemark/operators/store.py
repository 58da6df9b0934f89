"""Immutable generations of a table: append, replace, patch, mutate, install, compact, as-of, garbage. On any file system that Spark writes to.

A generation is a manifest (JSON) that lists shards: folders of Parquet files, which may belong to earlier generations too.
Manifests are numbered; the one with the highest number is in force. A commit writes its manifest beside the others and
renames it to the next number, which fails if another commit took it: nothing is ever overwritten, and a reader sees the
generation before or the one after. Shards are written under a name that ends in ``.partial`` and renamed when whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.sources.files import Files, shard_of
from tidemark.sources.tables import overlapping


class Store:
    """One table under ``root`` with primary key ``keys`` and day column ``day``."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], day: str | None = None):
        self.spark, self.files, self.keys, self.day = spark, Files(spark), keys, day
        self.root = self.files.absolute(root)
        for folder in ("data", "manifests"):
            self.files.make_folder(f"{self.root}/{folder}")

    # Manifests --------------------------------------------------------------------------------------------------

    def generations(self) -> list[str]:
        """The manifests' names in order of their numbers."""
        return sorted(n for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json"))

    def manifest(self, name: str) -> dict:
        return json.loads(self.files.read_text(f"{self.root}/manifests/{name}"))

    def active(self) -> dict | None:
        names = self.generations()
        return self.manifest(names[-1]) if names else None

    def _commit(self, shards: list[dict], schema: str, installed: list[str], base: dict | None) -> dict:
        number = (base["generation"] if base else 0) + 1
        manifest = {"generation": number, "keys": self.keys, "schema": schema, "rows": sum(s["rows"] for s in shards), "shards": shards, "installed": installed}
        self.files.write_new(f"{self.root}/manifests/{number:012d}.json", json.dumps(manifest))
        return manifest

    def _next(self, base: dict, shards: list[dict]) -> dict:
        return self._commit(shards, base["schema"], base["installed"], base)

    def _write(self, df: DataFrame) -> dict:
        """One shard, known to nobody until a manifest names it."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(f"{path}.partial")
        self.files.rename(f"{path}.partial", path)
        return self._described([path])[0]

    def _described(self, paths: list[str]) -> list[dict]:
        """Rows and date range of shards, from one pass over them."""
        span = [F.min(self.day).cast("string"), F.max(self.day).cast("string")] if self.day else [F.lit(None).cast("string")] * 2
        rows = self.spark.read.parquet(*paths).groupBy(shard_of(F.col("_metadata.file_path")).alias("shard")).agg(F.count("*").alias("n"), span[0].alias("lo"), span[1].alias("hi")).collect()  # a row per shard
        found = {r.shard: r for r in rows}
        out = []
        for path in paths:
            r = found.get(path.rpartition("/")[2])
            out.append({"path": path, "rows": r.n if r else 0, "date_start": r.lo if r else None, "date_end": r.hi if r else None})
        return out

    def _rows(self, shards: Iterable[dict], manifest: dict) -> DataFrame:
        paths = [s["path"] for s in shards if s["rows"]]
        schema = _schema(manifest)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The active rows; shards whose dates lie outside are not opened."""
        manifest = self.active()
        if manifest is None:
            raise LookupError("the store is empty")
        if start is None:
            return self._rows(manifest["shards"], manifest)
        end = end or "9999-12-31"
        return self._rows(overlapping(manifest["shards"], start, end), manifest).where(F.col(self.day).between(start, end))

    # Mutation ---------------------------------------------------------------------------------------------------

    def _unique(self, df: DataFrame, what: str = "the new rows repeat a key") -> None:
        if df.groupBy(*self.keys).count().where("count > 1").head(1):
            raise ValueError(what)

    def replace(self, df: DataFrame) -> dict:
        """M4: a new generation of these rows only; schema and key may change."""
        self._unique(df)
        return self._commit([self._write(df)], df.schema.json(), [], self.active())

    def append(self, df: DataFrame) -> dict:
        """M1, M2: rows whose keys are new, of the same schema; anything else leaves the store as it is.

        Only shards whose dates meet those of the new rows are searched for their keys, if the day is part of the key.
        """
        base = self.active()
        if base is None:
            return self.replace(df)
        if _shape(df.schema) != _shape(_schema(base)):
            raise ValueError("the new rows have another schema")
        self._unique(df)
        shards = base["shards"]
        if self.day in self.keys:
            low, high = df.agg(F.min(self.day).cast("string"), F.max(self.day).cast("string")).first()
            shards = overlapping(shards, low or "", high or "9999-12-31") if low else shards
        if df.join(self._rows(shards, base).select(*self.keys), self.keys, "left_semi").head(1):
            raise ValueError("the new rows hold keys that are stored already")
        return self._next(base, [*base["shards"], self._write(df)])

    def append_shards(self, paths: list[str]) -> dict:
        """M2: Parquet folders that are prepared already become shards as they are: moved, not copied, keys checked across all."""
        base = self.active()
        if base is None:
            raise LookupError("the store is empty")
        schema, moved = _schema(base), []
        for path in map(self.files.absolute, paths):
            if _shape(self.spark.read.parquet(path).schema) != _shape(schema):
                raise ValueError("a prepared shard has another schema")
        self._unique(self._rows(base["shards"], base).select(*self.keys).unionByName(self.spark.read.schema(schema).parquet(*paths).select(*self.keys)), "the prepared shards repeat a key")
        for path in map(self.files.absolute, paths):
            to = f"{self.root}/data/{uuid.uuid4().hex}"
            self.files.rename(path, to)
            moved.append(to)
        return self._next(base, [*base["shards"], *self._described(moved)])

    def append_missing(self, df: DataFrame) -> dict:
        """Of these rows those whose keys aren't stored yet, one per key."""
        fresh = df.dropDuplicates(self.keys)
        return self.append(fresh.join(self.read().select(*self.keys), self.keys, "left_anti").select(*df.columns) if self.active() else fresh)

    def patch(self, changes: DataFrame, column: str) -> dict:
        """M5: sets ``column`` to ``value`` where it equals ``expected``; ``changes`` has the keys and these two.

        Every change must meet exactly one row that still has the expected value, else nothing changes. Only shards that hold such
        a row are written anew.
        """
        self._unique(changes, "two changes of one key")
        base = self.active()
        asked = changes.select(*self.keys, F.col("expected").alias("_e"), F.col("value").alias("_v"), F.lit(True).alias("_c"))
        fits = F.col("_c") & F.col(column).eqNullSafe(F.col("_e"))
        placed = self._rows(base["shards"], base).withColumn("_shard", shard_of(F.col("_metadata.file_path")))
        hit = {r["_shard"]: r["n"] for r in placed.join(asked, self.keys).where(fits).groupBy("_shard").agg(F.count("*").alias("n")).collect()}  # a row per shard
        if sum(hit.values()) != changes.count():
            raise ValueError("a change meets no row with the expected value")
        touched = [s for s in base["shards"] if s["path"].rpartition("/")[2] in hit]
        kept = [s for s in base["shards"] if s not in touched]
        rows = self._rows(touched, base)
        patched = rows.join(asked, self.keys, "left").withColumn(column, F.when(fits, F.col("_v")).otherwise(F.col(column))).select(*rows.columns)
        return self._next(base, [*kept, self._write(patched)] if touched else kept)

    def mutate(self, remove: list[str], add: list[DataFrame]) -> dict:
        """M3: shards out and in within one commit; no key may be in two of those that stay or come. Files of those removed stay until ``collect_garbage``."""
        base = self.active()
        kept = [s for s in base["shards"] if s["path"] not in remove]
        if add:
            every = self._rows(kept, base).select(*self.keys)
            for df in add:
                every = every.unionByName(df.select(*self.keys))
            self._unique(every, "shards that stay and come repeat a key")
        return self._next(base, [*kept, *map(self._write, add)])

    def install(self, batch: str, expected: DataFrame, new: DataFrame) -> dict:
        """Replaces the rows ``expected`` by ``new`` of the same keys, once for each ``batch``.

        The rows in force must equal ``expected`` field by field (compare and set). A batch that is installed already changes nothing,
        so an interrupted run may start again.
        """
        base = self.active()
        if batch in base["installed"]:
            return base
        columns = self._rows([], base).columns
        current = self._rows(base["shards"], base).join(expected.select(*self.keys), self.keys, "left_semi").select(*columns)
        asked = expected.select(*columns)
        if asked.exceptAll(current).head(1) or current.exceptAll(asked).head(1):
            raise ValueError("rows in force aren't the expected ones")
        self._unique(new)
        keys = lambda df: df.select(*self.keys).distinct()
        if keys(new).exceptAll(keys(expected)).head(1) or keys(expected).exceptAll(keys(new)).head(1):
            raise ValueError("the new rows have other keys than the expected ones")
        placed = self._rows(base["shards"], base).withColumn("_shard", shard_of(F.col("_metadata.file_path")))
        hit = {r["_shard"] for r in placed.join(expected.select(*self.keys), self.keys, "left_semi").select("_shard").distinct().collect()}
        touched = [s for s in base["shards"] if s["path"].rpartition("/")[2] in hit]
        rest = self._rows(touched, base).join(expected.select(*self.keys), self.keys, "left_anti").select(*columns)
        shards = [s for s in base["shards"] if s not in touched] + [self._write(rest.unionByName(new.select(*columns)))]
        return self._commit(shards, base["schema"], [*base["installed"], batch], base)

    def compact(self, files: int = 1, by_year: bool = False) -> dict:
        """The same rows in one shard of ``files`` files, or a shard of one file for each year; fails if their number or content changes."""
        base = self.active()
        before = self._rows(base["shards"], base)
        if by_year:
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            year = F.coalesce(F.substring(F.col(self.day).cast("string"), 1, 4), F.lit("none"))
            before.withColumn("_year", year).repartition("_year").write.partitionBy("_year").parquet(f"{path}.partial")
            paths = []
            for name in sorted(n for n in self.files.names(f"{path}.partial") if n.startswith("_year=")):
                paths.append(f"{path}-{name.partition('=')[2]}")
                self.files.rename(f"{path}.partial/{name}", paths[-1])
            self.files.delete(f"{path}.partial")
            shards = self._described(paths) if paths else []
        else:
            shards = [self._write(before.repartition(files, *self.keys))]
        if _digest(self._rows(shards, base)) != _digest(before):
            raise RuntimeError("compaction changed the rows")
        return self._next(base, shards)

    def as_of(self, cutoff: str) -> DataFrame:
        """M6: rows dated up to the cutoff or not at all; shards that begin later are not opened."""
        manifest = self.active()
        early = [s for s in manifest["shards"] if s["date_start"] is None or s["date_start"] <= cutoff]
        return self._rows(early, manifest).where(F.col(self.day).isNull() | (F.col(self.day) <= cutoff))

    def cut(self, cutoff: str) -> dict:
        """M6: a generation that ends at the cutoff: shards that end before it stay, those that begin after it go, those on the boundary are written anew."""
        base = self.active()
        keep = [s for s in base["shards"] if s["rows"] and s["date_end"] is not None and s["date_end"] <= cutoff]
        boundary = [s for s in base["shards"] if s["rows"] and s not in keep and (s["date_start"] is None or s["date_start"] <= cutoff)]
        undated = F.col(self.day).isNull() | (F.col(self.day) <= cutoff)
        late = [s for s in base["shards"] if s not in keep and s not in boundary]
        kept_nulls = self._rows(late, base).where(F.col(self.day).isNull())
        written = [self._write(self._rows(boundary, base).where(undated).unionByName(kept_nulls))] if boundary or late else []
        return self._next(base, [*keep, *written])

    def collect_garbage(self, keep: int = 1, references: Iterable[str] = ()) -> list[str]:
        """M7: removes data that neither the last ``keep`` generations nor ``references`` (manifests or shards elsewhere that still need it) name."""
        names = self.generations()
        held = names[-keep:]
        used = {self.files.absolute(p) for p in references} | {s["path"] for n in held for s in self.manifest(n)["shards"]}
        for name in set(names) - set(held):
            self.files.delete(f"{self.root}/manifests/{name}")
        gone = [p for p in (f"{self.root}/data/{n}" for n in self.files.names(f"{self.root}/data")) if p not in used]
        for path in gone:
            self.files.delete(path)
        return gone


def _schema(manifest: dict) -> T.StructType:
    return T.StructType.fromJson(json.loads(manifest["schema"]))


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    """Names and types; whether a column may be null isn't part of a stored schema."""
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def _digest(df: DataFrame) -> tuple:
    """Rows and the exact sum of their 64-bit digests, which repeated rows change and order doesn't."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())


def changed_events(df: DataFrame, keys: list[str], order: str, value: str, rtol: float = 1e-12, atol: float = 0.5) -> DataFrame:
    """M9: the first row of each key and those whose value differs from the row before by more than the tolerance."""
    from tidemark.operators.windows import along

    before = F.lag(value).over(along(keys, order))
    far = F.abs(F.col(value) - before) > atol + rtol * F.abs(before)
    return df.withColumn("_far", before.isNull() | far).where("_far").drop("_far")
