"""Queries of SURVEY §2 over the market tables: bars, hours, features, states, outcomes. Twins in ``market_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import normalize as N
from tidemark.functions.scalars import first_reason, ladder, safe_ratio
from tidemark.operators import joins as J, minutes as M, windows as W
from tidemark.operators.counting import counting
from tidemark.plans.dealt import open_days
from tidemark.plans.reference import r_off
from tidemark.sources.tables import table

QUERIES: dict = {}

SLOTS, HOUR = 48, 12


def query(f):
    QUERIES[f.__name__] = f
    return f


def s(c, digits: int = 6):
    """Rounded off the grid of ties, as ``r_off``."""
    return r_off(F.col(c) if isinstance(c, str) else c, digits)


def named_day(df: DataFrame, day: str = "day") -> DataFrame:
    return df.withColumn("trade_date", N.day_text(F.col(day))).drop(day)


# Bars ------------------------------------------------------------------------------------------------------------


def stock_days(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, factor, industry): one row per key, exact copies being one."""
    t = table(spark, folder, "stock_day").select(N.symbol("symbol").alias("symbol"), N.day_number("trade_date").alias("day"), N.finite_positive("adjust_factor").alias("factor"), F.col("industry_name").alias("industry"))
    return t.where("symbol is not null and day is not null").groupBy("symbol", "day").agg(F.max("factor").alias("factor"), F.max("industry").alias("industry"))


def minute_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, millis, slot, auction, open … amount): counting rows of the session and of its auction (09:25 to 09:30), whose slot is the first."""
    prices = ("open", "high", "low", "close", "volume", "amount")
    raw = table(spark, folder, "minute_bars").select(
        N.sealed(N.symbol("symbol")).alias("symbol"), N.sealed(N.day_number("trade_date")).alias("day"), N.sealed(N.clock("bar_time")).alias("millis"), *[N.finite(c).alias(c) for c in prices], "received_at")
    minute = F.floor(F.col("millis") / 60000).cast("int")
    ordinal, auction = N.session_ordinal(F.col("millis")), minute.between(565, 570)
    inside = raw.withColumn("millis", F.when(ordinal.isNotNull() | auction, F.col("millis")))
    kept = counting(inside, ["symbol", "day", "millis"], "received_at", {c: F.col(c) for c in prices}).where("symbol is not null and day is not null and millis is not null")
    return kept.withColumns({"auction": auction, "slot": F.when(auction, 0).otherwise(F.floor(ordinal / 5)).cast("int")})


def five_minute(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, slot, open … amount, bars, factor): adjusted five-minute bars by right edge, the auction folded into the first."""
    rows = minute_rows(spark, folder).join(stock_days(spark, folder).select("symbol", "day", "factor"), ["symbol", "day"])
    fine = M.adjusted(M.field_masks(rows), "factor").withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("volume", "amount")})
    return M.bucket_bars(fine, ["symbol", "day", "slot"], "millis", ~F.col("auction"))


def hours(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, hour, open … amount): hours of all twelve regular five-minute bars; the first is seeded by the auction."""
    five = five_minute(spark, folder).withColumn("hour", (F.floor(F.col("slot") / HOUR) + 1).cast("int"))
    return M.whole_buckets(five, ["symbol", "day", "hour"], "slot", HOUR)


PRICES = ("open", "high", "low", "close")


@query
def session_five_minute(spark, folder):
    """Five-minute bars named by their right edge; the auction belongs to the first."""
    end = F.col("slot") * 5 + F.when(F.col("slot") < 24, 575).otherwise(665)
    out = five_minute(spark, folder).select("symbol", "day", end.cast("int").alias("end_minute"), *[s(c).alias(c) for c in PRICES], s("volume", 2).alias("volume"), s("amount", 2).alias("amount"), "bars")
    return named_day(out)


@query
def field_validity(spark, folder):
    """P5: how many rows of a source have each field valid."""
    t = table(spark, folder, "minute_bars").select("source", *[N.finite(c).alias(c) for c in PRICES])
    return M.field_masks(t).groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"valid_{c}")).alias(f"valid_{c}") for c in PRICES])


@query
def session_hours(spark, folder):
    """A3, A4: hourly bars of complete hours."""
    return named_day(hours(spark, folder).select("symbol", "day", "hour", *[s(c).alias(c) for c in PRICES], s("volume", 2).alias("volume"), s("amount", 2).alias("amount")))


@query
def complete_sessions(spark, folder):
    """A4: sessions that have exactly all 48 different slots, with the number of rows they came from."""
    five = five_minute(spark, folder)
    g = five.groupBy("symbol", "day").agg(F.count_if((F.col("bars") > 0) & F.col("close").isNotNull()).alias("slots"), F.sum("bars").alias("rows"))
    return named_day(g.where(F.col("slots") == SLOTS).drop("slots"))


@query
def any_known_value(spark, folder):
    """A symbol's exchange and board, from any snapshot that states them; where they differ the largest, so that it is always the same."""
    t = table(spark, folder, "universe_snapshot").select(N.symbol("symbol").alias("symbol"), *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("exchange", "board")])
    return t.where("symbol is not null").groupBy("symbol").agg(F.max("exchange").alias("exchange"), F.max("board").alias("board"))


# Features --------------------------------------------------------------------------------------------------------


@query
def bar_features(spark, folder):
    """Five features for seven windows of five-minute bars, running over sessions."""
    out = M.rolling_features(five_minute(spark, folder), "symbol", ["day", "slot"], "volume")
    return named_day(out.select("symbol", "day", "slot", *[s(c).alias(c) for c in out.columns[3:]]))


@query
def hour_features(spark, folder):
    """The same over hourly bars, with amounts."""
    out = M.rolling_features(hours(spark, folder), "symbol", ["day", "hour"], "amount")
    return named_day(out.select("symbol", "day", "hour", *[s(c).alias(c) for c in out.columns[3:]]))


@query
def running_hour_state(spark, folder):
    """The state of the hour so far, at each five-minute bar; the first bar moves against the bar before the hour."""
    five = five_minute(spark, folder).where("close is not null and high is not null and low is not null").withColumn("hour", (F.floor(F.col("slot") / HOUR) + 1).cast("int"))
    before = F.lag("close").over(W.along(["symbol"], "day", "slot"))
    out = M.running_state(five.withColumn("before", before), ["symbol", "day", "hour"], "slot", "before")
    return named_day(out.select("symbol", "day", "slot", *[s(c).alias(c) for c in ("partial_high", "partial_low", "rebound", "partial_range", "location", "lower_wick", "up_down_ratio")]))


MA_PERIODS = (5, 10)


def hour_states(spark: SparkSession, folder: str) -> DataFrame:
    """Hours times periods with the sum of the period's earlier closes, the level they set, the mean and its slope."""
    spec = W.along(["symbol"], "day", "hour")
    wide = hours(spark, folder).withColumn("m", F.array(*[F.struct(
        F.lit(p).alias("period"), W.complete(F.sum, F.col("close"), spec, -(p - 1), -1).alias("prior"), W.complete(F.avg, F.col("close"), spec, -(p - 1), 0).alias("mean"),
        W.complete(F.avg, F.col("close"), spec, -p, -1).alias("mean_before")) for p in MA_PERIODS]))
    long = wide.select("symbol", "day", "hour", "high", "low", "close", F.explode("m").alias("m")).select("symbol", "day", "hour", "high", "low", "close", "m.*")
    level = F.col("prior") / (F.col("period") - 1)
    return long.withColumns({"level": level, "slope": (safe_ratio(F.col("mean"), F.col("mean_before")) - 1) * 10000, "touched": F.coalesce((F.col("low") <= level) & (level <= F.col("high")), F.lit(False))})


@query
def hourly_ma_state(spark, folder):
    """Level, slope in hundredths of a percent, and touches of the 20 hours before and of all hours before."""
    spec = W.along(["symbol", "period"], "day", "hour")
    one = F.col("touched").cast("int")
    out = hour_states(spark, folder).withColumns({
        "touches20": F.coalesce(F.sum(one).over(spec.rowsBetween(-20, -1)), F.lit(0)), "touches": F.coalesce(F.sum(one).over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return named_day(out.select("symbol", "day", "hour", "period", s("level").alias("level"), s("slope", 4).alias("slope"), "touched", "touches20", "touches"))


@query
def completed_hour_join(spark, folder):
    """Each five-minute bar joins the hour completed before its own, in the first hour the last one of the session before."""
    five = five_minute(spark, folder).where("close is not null").withColumn("hour", F.floor(F.col("slot") / HOUR).cast("int"))
    days = five.select("symbol", "day").distinct().withColumn("day_before", F.lag("day").over(W.along(["symbol"], "day")))
    keyed = five.join(days, ["symbol", "day"]).select("symbol", "day", "slot", "close", F.when(F.col("hour") > 0, F.col("day")).otherwise(F.col("day_before")).alias("hour_day"), F.when(F.col("hour") > 0, F.col("hour")).otherwise(4).alias("done"))
    done = hours(spark, folder).select("symbol", F.col("day").alias("hour_day"), F.col("hour").alias("done"), F.col("close").alias("hour_close"))
    return named_day(keyed.join(done, ["symbol", "hour_day", "done"], "left").select("symbol", "day", "slot", s(safe_ratio(F.col("close"), F.col("hour_close")) - 1).alias("to_hour")))


@query
def decision_grid(spark, folder):
    """Bars of the decision slots (10:00–11:25 and 13:30–14:50) with the number of their date and slot among all.

    Numbers count days first and slots within them, so no task sorts more than the calendar.
    """
    five = five_minute(spark, folder).where(F.col("slot").between(5, 22) | F.col("slot").between(29, 45))
    per_day = five.select("day", "slot").distinct().withColumn("within", F.row_number().over(Window.partitionBy("day").orderBy("slot")))
    days = per_day.groupBy("day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = per_day.join(days.select("day", before.alias("before")), "day").select("day", "slot", (F.col("before") + F.col("within")).alias("ordinal"))
    return named_day(five.join(grid, ["day", "slot"]).select("symbol", "day", "slot", "ordinal"))


@query
def market_and_industry_minutes(spark, folder):
    """The market's and each industry's five-minute moments: members, mean return, breadth, dispersion and amount."""
    spec = W.along(["symbol"], "day", "slot")
    industry = stock_days(spark, folder).select("symbol", "day", F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.lit("UNKNOWN")).alias("industry"))
    moved = five_minute(spark, folder).withColumn("last", F.lag("close").over(spec)).withColumn("move", safe_ratio(F.col("close"), F.col("last")) - 1).join(industry, ["symbol", "day"])
    both = moved.select("day", "slot", "move", "amount", F.explode(F.array(F.lit("*"), F.col("industry"))).alias("industry"))
    g = both.groupBy("day", "slot", "industry").agg(
        F.count("*").alias("members"), s(F.avg("move")).alias("mean"), s(F.avg(F.when(F.col("move") > 0, 1.0).otherwise(0.0))).alias("breadth"), s(F.stddev_samp("move")).alias("dispersion"), s(F.sum("amount"), 2).alias("amount"))
    return named_day(g)


# Outcomes --------------------------------------------------------------------------------------------------------


@query
def execution_window(spark, folder):
    """The window from 09:35 to 10:00 of each symbol and day."""
    out = M.execution_windows(five_minute(spark, folder), ["symbol", "day"], "slot", 1, 5)
    return named_day(out.withColumns({c: s(c) for c in ("high", "low", "first_price", "last_price", "vwap")}))


def signal_points(spark: SparkSession, folder: str) -> DataFrame:
    """(signal_id, symbol, day, slot, executable): counting signals in their slots."""
    raw = table(spark, folder, "minute_signals").where("signal_id is not null")
    signals = counting(raw, ["signal_id"], "received_at", {"symbol": N.symbol("symbol"), "day": N.day_number("signal_date"), "millis": N.clock("signal_time"), "executable": F.col("signal_executable")})
    return signals.select("signal_id", "symbol", "day", F.floor(N.session_ordinal(F.col("millis")) / 5).cast("int").alias("slot"), "executable")


def outcomes_of(spark: SparkSession, folder: str, points: DataFrame) -> DataFrame:
    return M.signal_outcomes(points, five_minute(spark, folder), open_days(spark, folder), SLOTS)


OUTCOMES = [*[f"return_{n}b" for n in (1, 3, 6)], *[f"{m}_{n}d" for n in (1, 2, 3) for m in ("return", "mfe", "mae")]]


@query
def signal_outcomes(spark, folder):
    """Every signal with its entry, outcomes and reason."""
    out = outcomes_of(spark, folder, signal_points(spark, folder))
    return out.select("signal_id", s("entry").alias("entry"), "reason", *[s(c).alias(c) for c in OUTCOMES])


@query
def outcomes_scored_once(spark, folder):
    """Outcomes of the different symbols and moments, joined back to their signals; those that can't be executed count nothing."""
    keys = ["symbol", "day", "slot", "executable"]
    out = M.score_once(signal_points(spark, folder), keys, lambda points: outcomes_of(spark, folder, points))
    g = out.groupBy("symbol", "executable").agg(F.count("*").alias("signals"), F.count("return_3b").alias("known"), s(F.avg("return_3b")).alias("mean3"), s(F.max("mfe_1d")).alias("best"), s(F.min("mae_1d")).alias("worst"))
    return g


@query
def outcome_coverage(spark, folder):
    """Q16: of all signals, how many have each outcome, by reason; their number is that of the signals."""
    out = outcomes_of(spark, folder, signal_points(spark, folder))
    return out.groupBy("reason").agg(F.count("*").alias("signals"), *[F.count(c).alias(c) for c in OUTCOMES])
