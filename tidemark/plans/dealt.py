"""Queries of the general data problems over the project's tables, with SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import normalize as N
from tidemark.operators.asknown import as_known
from tidemark.operators.counting import counting
from tidemark.operators.diff import differences, field_differences
from tidemark.operators.grid import regular_grid
from tidemark.operators.history import versions
from tidemark.operators.rolling import daily_totals, trailing_periods
from tidemark.session import checkpoint
from tidemark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# 1. History of changing attributes -------------------------------------------------------------------------------


def universe_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, name, is_st, first_event_day): counting snapshots in one spelling."""
    raw = table(spark, folder, "universe_snapshot").select(
        N.symbol("symbol").alias("symbol"), N.day_number("trade_date").alias("day"), "name", "is_st",
        N.day_number("first_event_date").alias("first_event_day"), "received_at",
    )
    rows = counting(raw.where("symbol is not null and day is not null"), ["symbol", "day"], "received_at",
                    {c: F.col(c) for c in ("name", "is_st", "first_event_day")})
    return rows.withColumn("name", N.fold_text("name"))


@query
def p1_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of every symbol's three attributes, with the dates from and to which it held."""
    out = versions(universe_snapshots(spark, folder), "symbol", "day", ["name", "is_st", "first_event_day"])
    return out.select(
        "symbol", N.day_text(F.col("valid_from")).alias("valid_from"), N.day_text(F.col("valid_to")).alias("valid_to"),
        "name", "is_st", N.day_text(F.col("first_event_day")).alias("first_event_date"),
    )


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_history(spark, folder).select("symbol", "valid_from")


# 2. Trailing periods ---------------------------------------------------------------------------------------------


def session_rows(spark: SparkSession, folder: str, value: str) -> DataFrame:
    """(symbol, day, millis, ``value``): the counting session bars.

    Rows outside the session share one key per symbol and date, with null millis: they witness that the
    date has rows. Kept apart by that key rather than by a filter, which would be pushed below the
    projection and parse the time again.
    """
    rows = table(spark, folder, "minute_bars").select(
        N.symbol("symbol").alias("symbol"), N.day_number("trade_date").alias("day"), N.clock("bar_time").alias("millis"),
        N.finite(value).alias(value), "received_at",
    )
    inside = F.when(N.session_ordinal(F.col("millis")).isNotNull(), F.col("millis"))
    kept = counting(rows.withColumn("millis", inside), ["symbol", "day", "millis"], "received_at", {value: F.col(value)})
    return kept.where("symbol is not null and day is not null")


def open_days(spark: SparkSession, folder: str) -> DataFrame:
    """(day, ordinal) of the open days. The calendar has one row per day: its size is fixed, so one task may number it."""
    from pyspark.sql import Window

    days = table(spark, folder, "trading_calendar").where("is_open").select(N.day_number("trade_date").alias("day")).distinct()
    return days.where("day is not null").select("day", F.row_number().over(Window.orderBy("day")).alias("ordinal"))


def amounts_by_period(spark: SparkSession, folder: str, targets: DataFrame | None = None) -> DataFrame:
    """Trailing totals of every symbol, over its open days from its first bar or target to its last."""
    bars = session_rows(spark, folder, "amount")
    kept = bars.withColumn("amount", F.when(F.col("millis").isNotNull() & (F.col("amount") >= 0), F.col("amount")))
    totals = daily_totals(kept, ["symbol", "day"], "amount")
    if targets is not None:
        # The targets' days count as rows of 0 as well, so that every target has its own row.
        totals = totals.unionByName(targets.select("symbol", "day", F.lit(0.0).alias("amount"))).groupBy("symbol", "day").agg(F.sum("amount").alias("amount"))
    # A row per symbol and day, written once: the spans and the totals would each read all bars otherwise.
    totals = checkpoint(totals)
    entities = totals.groupBy("symbol").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return trailing_periods(totals, entities, open_days(spark, folder), "symbol", "day", "amount")


@query
def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing totals, means and medians of every symbol and open date."""
    return amounts_by_period(spark, folder).where("ordinal is not null").select(
        "symbol", N.day_text(F.col("day")).alias("trade_date"), F.round("amount", 2).alias("day_amount"),
        F.round("prior_median_20", 2).alias("prior_20d_median_amount"), F.round("sum_7d", 2).alias("amount_sum_7d"),
        F.round("mean_30d", 2).alias("amount_mean_30d"),
    )


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stored totals of stock_day that are missing or more than 0.05 off."""
    stored = table(spark, folder, "stock_day").select(
        N.symbol("symbol").alias("symbol"), N.day_number("trade_date").alias("day"),
        "prior_20d_median_amount", "amount_sum_7d", "amount_mean_30d",
    ).where("symbol is not null and day is not null").distinct()
    fields = {"prior_20d_median_amount": "prior_median_20", "amount_sum_7d": "sum_7d", "amount_mean_30d": "mean_30d"}
    right = amounts_by_period(spark, folder, stored.select("symbol", "day").distinct())
    both = stored.join(right, ["symbol", "day"])
    off = F.filter(
        F.array(*[F.when(~F.coalesce(F.abs(F.col(a) - F.col(b)) <= 0.05, F.lit(False)), F.lit(a)) for a, b in fields.items()]),
        lambda x: x.isNotNull(),
    )
    return both.select("symbol", N.day_text(F.col("day")).alias("trade_date"), F.explode(off).alias("field_name")).distinct()


# 3. As known at event time ---------------------------------------------------------------------------------------


def counting_signals(spark: SparkSession, folder: str, **values) -> DataFrame:
    raw = table(spark, folder, "minute_signals").where("signal_id is not null")
    return counting(raw, ["signal_id"], "received_at", values)


def known_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Every signal with the statement of its symbol that was known on its date, null if there was none."""
    signals = counting_signals(spark, folder, symbol=N.symbol("symbol"), day=N.day_number("signal_date"))
    facts = table(spark, folder, "statement_quarterly").where("statement_id is not null").select(
        N.symbol("symbol").alias("symbol"), N.day_number("feature_available_date").alias("known_from"),
        N.day_number("report_date").alias("report_day"), "update_flag", "statement_id",
    )
    best = F.struct("report_day", "known_from", "update_flag", "statement_id")
    return as_known(signals, facts, "symbol", "day", "known_from", best).select(
        "signal_id", "symbol", N.day_text(F.col("day")).alias("signal_date"), F.col("known.statement_id").alias("statement_id"),
        N.day_text(F.col("known.report_day")).alias("report_date"), N.day_text(F.col("known.known_from")).alias("feature_available_date"),
    )


@query
def p3_known(spark: SparkSession, folder: str) -> DataFrame:
    return known_statements(spark, folder).withColumn("statement_id", F.col("statement_id").cast("string"))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return known_statements(spark, folder).where("statement_id is not null").select("signal_id", "statement_id")


# 6. Regular grid -------------------------------------------------------------------------------------------------


def five_minute_grid(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, slot, value, status) of all 48 slots of every symbol and date with any row."""
    kept = session_rows(spark, folder, "close")
    slot = F.floor(N.session_ordinal(F.col("millis")) / 5).cast("int")
    return regular_grid(kept, "symbol", "day", slot, F.col("millis"), F.when(F.col("close") > 0, F.col("close")), 48)


@query
def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The complete series: each slot's close, observed or filled, and its mark."""
    return five_minute_grid(spark, folder).select(
        "symbol", N.day_text(F.col("day")).alias("trade_date"), "slot", F.round("value", 6).alias("close"), "status"
    )


@query
def p6_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell's mark, with the close of those that were read: what doesn't depend on the factorisation."""
    return five_minute_grid(spark, folder).select("symbol", N.day_text(F.col("day")).alias("trade_date"), "slot", "status", F.when(F.col("status") == "observed", F.col("value")).alias("close"))


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return five_minute_grid(spark, folder).where("status != 'observed'").select("symbol", N.day_text(F.col("day")).alias("trade_date"), "slot")


# 7. Two copies ---------------------------------------------------------------------------------------------------

FLAGS = ("is_st", "is_suspended", "is_delisted")


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows on one side, differing flags, and ledger rows whose count of changes is wrong."""
    active = counting(
        table(spark, folder, "security_status").withColumns({"symbol": N.symbol("symbol"), "day": N.day_number("trade_date")}),
        ["symbol", "day"], "received_at", {**{f: F.col(f) for f in FLAGS}, "shard_id": F.col("shard_id")},
    )
    archive = counting(
        table(spark, folder, "archive_status").withColumns({"symbol": N.symbol("code"), "day": N.day_number("trade_date")}),
        ["symbol", "day"], "received_at", {f: N.flag(f"archive_{f}") for f in FLAGS},
    )
    # The shard rides along with the active copy; the archive has none, so it isn't a field to compare.
    found = differences(active, archive.withColumn("shard_id", F.lit(None).cast("string")), ["symbol", "day"], [*FLAGS, "shard_id"])
    fields = field_differences(found, ["symbol", "day"], list(FLAGS), left_missing="missing_in_status", right_missing="missing_in_archive")
    changed = (
        found.where((F.col("kind") == "both") & ~F.col("left.is_st").eqNullSafe(F.col("right.is_st")))
        .groupBy(F.col("left.shard_id").alias("shard_id")).agg(F.count("*").alias("n"))
    )
    ledger = table(spark, folder, "status_shard").select("shard_id", "date_start", "changed_rows")
    wrong = ledger.join(changed, "shard_id", "left").where(~F.col("changed_rows").eqNullSafe(F.coalesce("n", F.lit(0))))
    return fields.select(F.col("symbol").alias("record_key"), N.day_text(F.col("day")).alias("trade_date"), "field_name").unionByName(
        wrong.select(
            F.col("shard_id").alias("record_key"), F.coalesce(N.day_text(N.day_number("date_start")), F.col("date_start")).alias("trade_date"),
            F.lit("changed_rows").alias("field_name"),
        )
    )
