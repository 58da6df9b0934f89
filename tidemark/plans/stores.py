"""Queries of SURVEY §2.1 and §2.2: each takes a table through the store or a source and gives what is in force then. Twins in ``stores_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.store import Store, changed_events
from tidemark.session import scratch
from tidemark.sources import tables as S
from tidemark.sources.archives import partitioned_sink

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "supplier")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their date as text; every hundredth of a number ending in 7 has none."""
    day = F.when(F.col("o_orderkey") % 1000 != 7, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return S.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", day.alias("day"))


@query
def store_append_and_patch(spark, folder):
    """M1, M4, M5, M8: half of the suppliers, then the other half, then all again as missing ones, then every urgent balance set anew."""
    t = suppliers(spark, folder)
    store = Store(spark, scratch(spark, "suppliers"), ["s_suppkey"])
    store.replace(t.where("s_nationkey < 12"))
    store.append(t.where("s_nationkey >= 12"))
    store.append_missing(t.withColumn("s_acctbal", F.lit(0.0)))
    wrong = store.read().where("s_acctbal < 0")
    store.patch(wrong.select("s_suppkey", F.col("s_acctbal").alias("expected"), F.lit(0.0).alias("value")), "s_acctbal")
    return store.read()


@query
def store_mutate_and_install(spark, folder):
    """A shard replaced by another, a batch installed twice, all compacted; counted by nation."""
    t = suppliers(spark, folder)
    store = Store(spark, scratch(spark, "suppliers"), ["s_suppkey"])
    first = store.replace(t.where("s_nationkey < 12"))
    store.append(t.where("s_nationkey >= 12"))
    store.mutate([first["shards"][0]["path"]], [t.where("s_nationkey < 6")])
    old = store.read().where("s_nationkey = 20")
    for _ in range(2):
        store.install("batch-1", old, old.withColumn("s_acctbal", F.col("s_acctbal") + 1000))
    store.compact()
    store.collect_garbage()
    return store.read().groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query
def store_as_of(spark, folder):
    """Orders in yearly shards, cut at a date: shards before it stay, later ones go, the one on it is written anew; undated orders stay."""
    store = Store(spark, scratch(spark, "orders"), ["o_orderkey"], "day")
    t = orders(spark, folder)
    one = t.dropDuplicates(["o_orderkey"])
    store.replace(one)
    store.compact(by_year=True)
    known = store.as_of("1998-06-30").groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit("as_of").alias("how"), "o_orderstatus", "n")
    store.cut("1998-06-30")
    cut = store.read().groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit("cut").alias("how"), "o_orderstatus", "n")
    ranged = store.read("1997-02-01", "1997-03-15").groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit("range").alias("how"), "o_orderstatus", "n")
    return known.unionByName(cut).unionByName(ranged)


@query
def compressed_events(spark, folder):
    """M9: the orders of each customer at which the price moves by more than a tolerance."""
    t = S.table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_totalprice")
    return changed_events(t, ["o_custkey"], "at", "o_totalprice", 0.1, 1000.0).select("o_custkey", "o_orderkey", "o_totalprice")


@query
def bounded_views(spark, folder):
    """Several tables as views bounded by dates, queried together."""
    S.register_views(spark, folder, {"security_status": "trade_date", "stock_day": "trade_date", "nation": None}, "2001-04-10", "2001-05-10", "tidemark_bounded_")
    return spark.sql("""
      select 'status' as name, count(*) as rows, min(trade_date) as first, max(trade_date) as last from tidemark_bounded_security_status
      union all select 'context', count(*), min(trade_date), max(trade_date) from tidemark_bounded_stock_day
      union all select 'nation', count(*), null, null from tidemark_bounded_nation""")


@query
def picked_rows(spark, folder):
    """Rows of the symbols in a list that the caller holds."""
    return S.picked(S.table(spark, folder, "orders"), "o_custkey", [3, 5, 8, 13, 21, 21, None]).groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query
def partition_overwrite(spark, folder):
    """A hive layout of which one partition is written again, the others staying."""
    path = scratch(spark, "parts")
    t = S.table(spark, folder, "part").select("p_partkey", "p_size", "p_brand")
    partitioned_sink(t, path, ["p_brand"])
    partitioned_sink(t.where("p_brand = 'Brand#11' and p_size > 25"), path, ["p_brand"])
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
