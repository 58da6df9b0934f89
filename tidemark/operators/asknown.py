"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def timeline(facts: DataFrame, key: str, known_from: str, preference: Column, upto: DataFrame, period: int = 32) -> DataFrame:
    """(key, period, snapshot, log): what was known at each period's start, and what became known in it.

    ``facts`` says from which day (an integer) each fact was known; of those known at a time, the one with the
    largest ``preference`` (a struct) holds. Facts of one key and day combine first, so a log has at most
    ``period`` entries and a key at most one row per period, whatever the number of facts. Snapshots are
    materialised for every period from the first fact to ``upto`` (one row: the last period asked for), so
    that an event finds its own by equality.
    """
    by_day = (
        facts.where(F.col(known_from).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_k"), F.floor(F.col(known_from) / period).cast("int").alias("_p"), F.col(known_from).alias("_d"))
        .agg(F.max(preference).alias("_state"))
    )
    logs = by_day.groupBy("_k", "_p").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_d").alias("day"), F.col("_state").alias("state")))).alias("log"),
        F.max("_state").alias("_best"),
    )
    along = Window.partitionBy("_k").orderBy("_p")
    spans = logs.select(
        "_k", "_p", "log",
        F.max("_best").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.max("_best").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_after"),
        F.lead("_p").over(along).alias("_next"),
    )
    last = upto.select(F.col(upto.columns[0]).alias("_last"))
    reach = F.greatest(F.col("_p"), F.coalesce(F.col("_next") - 1, F.col("_last"), F.col("_p")))
    every = spans.join(F.broadcast(last)).select("*", F.explode(F.sequence("_p", reach)).alias("period"))
    own = F.col("period") == F.col("_p")
    return every.select(
        F.col("_k").alias(key), "period",
        F.when(own, F.col("_before")).otherwise(F.col("_after")).alias("snapshot"),
        F.when(own, F.col("log")).alias("log"),
    )


def as_known(events: DataFrame, facts: DataFrame, key: str, at: str, known_from: str, preference: Column, period: int = 32) -> DataFrame:
    """``events`` plus ``known``, the preferred fact of its key known on or before the event's day; null if none.

    Each event joins the snapshot of its period's start and replays only the changes logged within that
    period up to its own day. The join is on (key, period); events are moved at most once and never
    gathered by key, and AQE splits a key that holds many. Facts with an unknown day or key are never
    known; events with an unknown day or key know nothing and stay. Repeated events stay repeated.
    Event columns keep their names whatever the facts' are called.
    """
    period_of = F.floor(F.col(at) / period).cast("int")
    lines = timeline(facts, key, known_from, preference, events.select(F.max(period_of)), period)
    right = lines.select(F.col(key).alias("_lk"), F.col("period").alias("_lp"), F.col("snapshot").alias("_ls"), F.col("log").alias("_ll"))
    joined = events.withColumn("_period", period_of).join(right, (F.col(key) == F.col("_lk")) & (F.col("_period") == F.col("_lp")), "left")
    replayed = F.array_max(F.transform(F.filter("_ll", lambda x: x["day"] <= F.col(at)), lambda x: x["state"]))
    return joined.withColumn("known", F.greatest("_ls", replayed)).select(*events.columns, "known")
