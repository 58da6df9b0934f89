"""The store, the archive readers and the streaming bars."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.store import Store, changed_events
from tidemark.sources import tables as S
from tidemark.sources.files import Files, fingerprints, same_artifact, write_evidence
from tidemark.sources.archives import BAR, HEADER, MAGIC, binary_bars, partitioned_sink, zipped_csv
from tidemark.streaming.bars import streaming_bars

SCHEMA = "trade_date string, symbol string, close double"


@pytest.fixture()
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path), ["trade_date", "symbol"], "trade_date")
    s.replace(spark.createDataFrame([("2001-01-01", "a", 1.0), ("2001-01-02", "a", 2.0), (None, "z", 0.0)], SCHEMA))
    return s


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_append_and_prune(spark, store):
    store.append(spark.createDataFrame([("2001-02-01", "a", 3.0)], SCHEMA))
    assert store.active()["rows"] == 4 and len(store.active()["shards"]) == 2
    assert content(store.read("2001-02-01", "2001-02-28")) == [("2001-02-01", "a", 3.0)]
    assert len(store.read("2001-02-01", "2001-02-28").inputFiles()) < len(store.read().inputFiles())
    before = store.active()
    for bad in ([("2001-01-01", "a", 9.0)], [("2001-03-01", "b", 1.0), ("2001-03-01", "b", 2.0)]):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame(bad, SCHEMA))
    with pytest.raises(ValueError, match="schema"):
        store.append(spark.createDataFrame([("2001-03-01", "b")], "trade_date string, symbol string"))
    assert store.active() == before
    store.append_missing(spark.createDataFrame([("2001-01-01", "a", 9.0), ("2001-03-01", "b", 1.0)], SCHEMA))
    assert store.active()["rows"] == 5


def test_patch(spark, store):
    change = lambda e, v: spark.createDataFrame([("2001-01-01", "a", e, v)], "trade_date string, symbol string, expected double, value double")
    with pytest.raises(ValueError):
        store.patch(change(7.0, 8.0), "close")
    store.patch(change(1.0, None), "close")
    store.patch(change(None, 5.0), "close")
    assert ("2001-01-01", "a", 5.0) in content(store.read())


def test_compact_as_of_garbage(spark, store):
    store.append(spark.createDataFrame([("2001-02-01", "a", 3.0)], SCHEMA))
    rows = content(store.read())
    store.compact()
    assert content(store.read()) == rows and len(store.active()["shards"]) == 1
    assert content(store.as_of("2001-01-01")) == [("2001-01-01", "a", 1.0), (None, "z", 0.0)]
    assert len(store.collect_garbage()) == 2 and content(store.read()) == rows
    store.mutate([store.active()["shards"][0]["path"]], [spark.createDataFrame([("2002-01-01", "q", 1.0)], SCHEMA)])
    assert content(store.read()) == [("2002-01-01", "q", 1.0)]


def test_changed_events(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.2, 5.0, 5.0, None, 5.0])], "k string, t int, v double")
    assert [r.t for r in changed_events(df, ["k"], "t", "v").orderBy("t").collect()] == [0, 2, 5]


def test_zip_of_csv(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("2001_a.csv", "093100,1.5,2\n093200,1.6\n")
        z.writestr("2003_a.csv", "093100,9,9\n")
        z.writestr("notes.txt", "x")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    df = zipped_csv(spark, str(tmp_path / "*.zip"), ["time", "close", "volume"], (2000, 2002))
    assert content(df) == [("2001_a.csv", "093100", "1.5", "2"), ("2001_a.csv", "093200", "1.6", None)]


def test_binary(spark, tmp_path):
    bars = np.array([(1_000_000_000, 1500, 1600, 1400, 1550, 100, 155)], BAR)
    (tmp_path / "a.bar").write_bytes(MAGIC + struct.pack("<12x") + bars.tobytes())
    assert HEADER == 16
    r = binary_bars(spark, str(tmp_path / "*.bar")).first()
    assert (r.trade_date, r.bar_time, r.close, r.volume) == ("2001-09-09", "094640000", 1.55, 100.0)
    (tmp_path / "b.bar").write_bytes(b"nope" * 5)
    with pytest.raises(Exception, match="not a bar file"):
        binary_bars(spark, str(tmp_path / "b.bar")).collect()


def test_partitioned_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    partitioned_sink(df, str(tmp_path / "t"), ["p"])
    partitioned_sink(df.where("p = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ["p"])
    assert content(spark.read.parquet(str(tmp_path / "t"))) == [(2, "b"), (9, "a")]


def test_streaming_bars(spark, tmp_path):
    ticks = spark.createDataFrame([("a", "2001-01-01 00:10:00", 1.0), ("a", "2001-01-01 05:00:00", 3.0), ("a", "2001-01-01 06:00:00", 2.0), ("b", "2001-01-02 00:00:00", 7.0)], "s string, t string, p double")
    ticks.withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, t timestamp, p double").parquet(str(tmp_path / "in"))
    q = streaming_bars(stream, "s", "t", "p").writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.symbol, str(r.bucket_start)): (r.open, r.high, r.low, r.close, r.ticks) for r in spark.table("bars").collect()}
    assert got["a", "2001-01-01 00:00:00"] == (1.0, 3.0, 1.0, 3.0, 2) and len(got) == 3


def shards(store):
    return [s["path"] for s in store.active()["shards"]]


def test_patch_writes_only_the_shard_it_meets(spark, store):
    store.append(spark.createDataFrame([("2001-02-01", "a", 3.0)], SCHEMA))
    first, second = shards(store)
    store.patch(spark.createDataFrame([("2001-02-01", "a", 3.0, 4.0)], "trade_date string, symbol string, expected double, value double"), "close")
    assert first in shards(store) and second not in shards(store) and ("2001-02-01", "a", 4.0) in content(store.read())


def test_mutate_checks_keys_of_all_shards(spark, store):
    before = store.active()
    with pytest.raises(ValueError, match="repeat"):
        store.mutate([], [spark.createDataFrame([("2001-01-01", "a", 5.0)], SCHEMA)])
    assert store.active() == before


def test_install_once_and_only_on_what_was_expected(spark, store):
    old = store.read().where("symbol = 'a' and close = 1.0")
    new = old.withColumn("close", F.lit(9.0))
    with pytest.raises(ValueError, match="expected"):
        store.install("b", new, old)
    with pytest.raises(ValueError, match="keys"):
        store.install("b", old, new.withColumn("symbol", F.lit("q")))
    done = store.install("b", old, new)
    assert store.install("b", old, new) == done and content(store.read()) == sorted([("2001-01-01", "a", 9.0), ("2001-01-02", "a", 2.0), (None, "z", 0.0)], key=repr)


def test_cut_keeps_drops_and_rewrites(spark, store):
    store.append(spark.createDataFrame([("2001-02-01", "a", 3.0), ("2001-02-20", "a", 4.0)], SCHEMA))
    store.append(spark.createDataFrame([("2001-03-01", "a", 5.0)], SCHEMA))
    first = shards(store)[0]
    store.cut("2001-02-10")
    assert first in shards(store) and {r[0] for r in content(store.read())} == {"2001-01-01", "2001-01-02", "2001-02-01", None}


def test_years_prepared_shards_and_references(spark, store, tmp_path):
    store.append(spark.createDataFrame([("2002-02-01", "a", 3.0)], SCHEMA))
    rows = content(store.read())
    old = shards(store)
    store.compact(by_year=True)
    assert content(store.read()) == rows and [s["rows"] for s in store.active()["shards"]] == [2, 1, 1]
    path = str(tmp_path / "prepared")
    spark.createDataFrame([("2003-01-01", "a", 7.0)], SCHEMA).write.parquet(path)
    store.append_shards([path])
    assert store.active()["rows"] == 5
    spark.createDataFrame([("2003-01-01", "a", 8.0)], SCHEMA).write.parquet(path)
    with pytest.raises(ValueError, match="repeat"):
        store.append_shards([path])
    gone = store.collect_garbage(keep=1, references=[old[0]])
    assert old[0] not in gone and old[1] in gone and store.active()["rows"] == 5


def test_a_generation_is_taken_once(spark, store):
    with pytest.raises(FileExistsError):
        store._commit([], store.active()["schema"], [], {"generation": 0})
    assert len(store.generations()) == 1


def test_fingerprints(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    found = fingerprints(spark, str(tmp_path / "t" / "*.parquet")).collect()
    import hashlib

    file = next((tmp_path / "t").glob("*.parquet"))
    assert len(found) == 1 and found[0].sha256 == hashlib.sha256(file.read_bytes()).hexdigest() and (found[0].rows, found[0].row_groups, found[0].bytes) == (100, 1, file.stat().st_size)
    assert same_artifact(found[0].asDict(), found[0].asDict()) and not same_artifact(found[0].asDict(), found[0].asDict() | {"rows": 99})
    assert fingerprints(spark, str(tmp_path / "none" / "*.parquet")).collect() == []


def test_batches_are_bounded(spark):
    got = list(S.batches(spark.range(1000).repartition(3), 64))
    assert max(b.num_rows for b in got) <= 64 and sorted(x for b in got for x in b.column(0).to_pylist()) == list(range(1000))


def test_views_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("2001-01-01", 1), ("2001-06-01", 2)], "d string, v int").write.parquet(str(tmp_path / "t.parquet"))
    S.register_views(spark, str(tmp_path), {"t": "d"}, "2001-05-01", "2001-12-31", "x_")
    assert [r.v for r in spark.sql("select v from x_t").collect()] == [2]
    assert "GreaterThanOrEqual(d,2001-05-01)" in spark.sql("select v from x_t")._jdf.queryExecution().toString()


def test_evidence(spark, tmp_path):
    path = str(tmp_path / "e.json")
    assert write_evidence(spark, path, spark.createDataFrame([("的", 1)], "a string, b int")) == 1
    assert Files(spark).read_text(path) == '[{"a": "的", "b": 1}]'
    with pytest.raises(FileExistsError):
        write_evidence(spark, path, spark.range(1))
    with pytest.raises(ValueError):
        write_evidence(spark, path + "2", spark.range(10), 5)


def test_binary_units_and_days(spark, tmp_path):
    bars = np.array([(1_000_000_000, 1500, 1600, 1400, 1550, 100, 155)] * 3, BAR)
    (tmp_path / "a.bar").write_bytes(MAGIC + struct.pack("<12x") + bars.tobytes())
    got = binary_bars(spark, str(tmp_path / "*.bar"), lot=100, daily=True, rows=2).collect()
    assert len(got) == 3 and got[0].volume == 10000.0 and got[0].bar_time is None and got[0].trade_date == "2001-09-09"
