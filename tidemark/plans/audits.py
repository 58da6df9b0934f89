"""Queries of SURVEY §2: signal rules and classes (U), and the audit catalogue (Q). Twins in ``audits_sql``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import normalize as N
from tidemark.functions.scalars import first_reason, ladder, safe_ratio
from tidemark.operators import joins as J, windows as W
from tidemark.operators.counting import counting
from tidemark.plans.dealt import open_days
from tidemark.plans.market import HOUR, OUTCOMES, five_minute, hour_states, minute_rows, named_day, outcomes_of, s, signal_points, stock_days
from tidemark.sources.tables import daily_bars, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Rules -----------------------------------------------------------------------------------------------------------

GROUP = ["symbol", "day", "hour", "period"]
NEAR, CATCH_UP, STABLE, LEAST_AMOUNT = 30.0, 50.0, 3, 20000.0


def ruled(spark: SparkSession, folder: str) -> DataFrame:
    """Five-minute bars of an hour and a period with the level known before it, sides, touches and candidates; a group has twelve bars at most."""
    spec = W.along(["symbol", "period"], "day", "hour")
    known = hour_states(spark, folder).withColumns({"hour_before": F.lag("close").over(spec), "hour_high_before": F.lag("high").over(spec)}).where("level is not null")
    known = known.select(*GROUP, "level", "hour_before", "hour_high_before", F.col("low").alias("hour_low"), F.col("mean").alias("final_mean"))
    five = five_minute(spark, folder).where("close is not null and high is not null and low is not null").withColumn("hour", (F.floor(F.col("slot") / HOUR) + 1).cast("int"))
    bars = five.select("symbol", "day", "hour", "slot", "high", "low", "close", "amount").join(known, ["symbol", "day", "hour"])
    level, along = F.col("level"), W.along(GROUP, "slot")
    bps = lambda c: (F.col(c) / level - 1) * 10000
    touched = (F.col("low") <= level) & (level <= F.col("high"))
    state = bars.withColumns({
        "touched": touched, "below": F.col("close") < level, "distance": bps("close"), "range_distance": F.when(touched, 0.0).when(F.col("low") > level, bps("low")).otherwise(bps("high")),
        "rising": F.coalesce(F.col("close") > F.lag("close").over(along), F.lit(False)), "ok": F.col("amount") >= LEAST_AMOUNT})
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    seen = state.withColumns({
        "seen": F.max(F.col("touched") | F.col("below")).over(so_far), "turn": ~F.col("below") & F.col("rising"), "near": ~F.col("touched") & (F.abs("range_distance") <= NEAR)})
    # An episode begins after each turn: what was near before the last turn was taken by it.
    episodes = seen.withColumn("episode", F.coalesce(F.sum(F.col("turn").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near_seen = F.max("near").over(W.along([*GROUP, "episode"], "slot").rowsBetween(Window.unboundedPreceding, 0))
    return episodes.withColumn("reversal", F.col("turn") & near_seen)


def stable_hits(bars: Column, n: int) -> Column:
    """The slots at which a run of ``n`` bars not below completes after a touch or break; both start anew then. A fold over a group's few bars."""
    start = F.struct(F.lit(False).alias("seen"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] | x["touched"] | x["below"]
        run = F.when(seen & ~x["below"], acc["run"] + 1).otherwise(0)
        hit = run >= n
        return F.struct((seen & ~hit).alias("seen"), F.when(hit, 0).otherwise(run).alias("run"), F.when(hit, F.concat(acc["hits"], F.array(x["slot"]))).otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(bars, start, step, lambda acc: acc["hits"])


@query
def rule_signals(spark, folder):
    """Of each hour and period the first bar that each rule picks among those with enough amount."""
    digest = F.md5(F.concat_ws("|", F.col("symbol"), N.day_text(F.col("day")), *[F.col(c).cast("string") for c in ("hour", "period", "slot")]))
    first = lambda c: F.min(F.when(c & F.col("ok"), F.col("slot")))
    ahead = F.sort_array(F.collect_list(F.struct("slot", "touched", "below", "ok")))
    g = ruled(spark, folder).groupBy(*GROUP).agg(
        F.min_by("slot", digest).alias("random_bar"), first(F.col("close") >= F.col("hour_high_before")).alias("strong"), first(F.abs("distance") <= NEAR).alias("near_level"),
        first(F.col("touched")).alias("touch"), first(F.col("seen") & ~F.col("below")).alias("reclaim"), first(F.col("reversal")).alias("reversal"), ahead.alias("bars"))
    fine = F.transform(F.filter("bars", lambda x: x["ok"]), lambda x: x["slot"])
    return named_day(g.withColumn("stable", F.array_min(F.array_intersect(stable_hits(F.col("bars"), STABLE), fine))).drop("bars"))


@query
def rule_episodes(spark, folder):
    """How many reversals and stable runs each hour and period has, each after its own approach or touch."""
    bars = F.sort_array(F.collect_list(F.struct("slot", "touched", "below")))
    g = ruled(spark, folder).groupBy(*GROUP).agg(F.count_if("reversal").alias("reversals"), bars.alias("bars"))
    return named_day(g.select(*GROUP, "reversals", F.size(stable_hits(F.col("bars"), STABLE)).alias("stable_runs")).where("reversals > 0 or stable_runs > 0"))


@query
def ma_event_kinds(spark, folder):
    """Each hour's and period's kind of event in order of priority; hours without any are left out."""
    above = ~F.col("below")
    opening = F.col("hour_before") >= F.col("level")
    bars = ruled(spark, folder).withColumn("crossed", (above != F.coalesce(F.lag(above).over(W.along(GROUP, "slot")), opening)).cast("int"))
    g = bars.groupBy(*GROUP).agg(
        F.bool_or("touched").alias("touch"), F.sum("crossed").alias("crosses"), F.min(F.when(F.col("below"), F.col("slot"))).alias("first_below"), F.max(F.when(above, F.col("slot"))).alias("last_above"),
        F.max_by(above, "slot").alias("ends_above"), F.min(F.abs("range_distance")).alias("closest"), F.max("hour_low").alias("hour_low"), F.max("final_mean").alias("final_mean"), F.max("level").alias("level"),
        F.bool_and(opening).alias("opens_above"))
    reclaimed = F.coalesce(F.col("last_above") > F.col("first_below"), ~F.col("opens_above") & F.col("last_above").isNotNull(), F.lit(False))
    broke, t = F.col("first_below").isNotNull(), F.col("touch")
    late = ~t & (F.col("hour_low") > F.col("level")) & (F.abs(F.col("final_mean") / F.col("hour_low") - 1) * 10000 <= CATCH_UP)
    kind = first_reason(
        (t & (F.col("crosses") >= 3), "repeated_cross"), (t & F.col("opens_above") & broke & reclaimed & F.col("ends_above"), "break_reclaim"), (t & ~F.col("opens_above") & reclaimed & F.col("ends_above"), "reclaim_from_below"),
        (t & broke & ~F.col("ends_above"), "failed_break"), (t & F.col("ends_above"), "touch_hold"), (F.coalesce(late, F.lit(False)), "posthoc_catchup"), (~t & (F.col("closest") <= NEAR), "near_touch"), default="none")
    return named_day(g.select(*GROUP, kind.alias("kind"), "crosses").where("kind != 'none'"))


@query
def reference_pairs(spark, folder):
    """Each signal of a strategy against the first signal of another strategy of its symbol and moment: the mean difference of outcomes."""
    families = counting(table(spark, folder, "minute_signals").where("signal_id is not null"), ["signal_id"], "received_at", {"strategy_id": F.col("strategy_id")})
    scored = outcomes_of(spark, folder, signal_points(spark, folder)).join(families, "signal_id").select("signal_id", "symbol", "day", "slot", "strategy_id", "return_1b")
    keys = ["symbol", "day", "slot"]
    firsts = scored.groupBy(*keys, "strategy_id").agg(F.min("signal_id").alias("first"))
    # The two lowest of a moment, of different strategies: a signal refers to the lower one that isn't of its own strategy.
    lowest = firsts.groupBy(*keys).agg(F.min(F.struct("first", "strategy_id")).alias("a"))
    other = firsts.join(lowest, keys).where(F.col("strategy_id") != F.col("a.strategy_id")).groupBy(*keys).agg(F.min("first").alias("b"))
    referred = scored.join(lowest, keys).join(other, keys, "left").withColumn("reference_id", F.when(F.col("strategy_id") != F.col("a.strategy_id"), F.col("a.first")).otherwise(F.col("b")))
    control = scored.select(F.col("signal_id").alias("reference_id"), F.col("return_1b").alias("control"))
    d = F.col("return_1b") - F.col("control")
    return referred.join(control, "reference_id").groupBy("strategy_id").agg(F.count("*").alias("pairs"), F.count(d).alias("known"), s(F.avg(d)).alias("mean"), s(F.avg((d > 0).cast("double"))).alias("positive_share"))


# Audits ----------------------------------------------------------------------------------------------------------

#: The tables that should have a key, and the columns it is made of.
KEYS = {
    "security_status": ("symbol", "trade_date"), "archive_status": ("code", "trade_date"), "universe_snapshot": ("symbol", "trade_date"), "stock_day": ("symbol", "trade_date"), "minute_bars": ("symbol", "trade_date", "bar_time"),
    "statement_quarterly": ("statement_id",), "minute_signals": ("signal_id",), "research_report": ("record_id",), "documents": ("doc_id",), "status_shard": ("shard_id",), "trading_calendar": ("trade_date",),
}


@query
def key_audit(spark, folder):
    """Q1: rows, rows with an unknown key, keys that are repeated and their rows, of every table, by the spelling as stored."""

    def one(name: str, keys: tuple[str, ...]) -> DataFrame:
        t = table(spark, folder, name).select(*keys)
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        g = t.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("known", known)
        return g.agg(F.lit(name).alias("name"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("null_keys"),
                     F.count_if(F.col("known") & (F.col("n") > 1)).alias("repeated"), F.coalesce(F.sum(F.when(F.col("known") & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_rows"))

    return reduce(DataFrame.unionByName, [one(n, k) for n, k in KEYS.items()])


def status_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, flags, shard_id): counting rows of the active copy."""
    t = table(spark, folder, "security_status").withColumns({"symbol": N.sealed(N.symbol("symbol")), "day": N.sealed(N.day_number("trade_date"))})
    return counting(t, ["symbol", "day"], "received_at", {c: F.col(c) for c in ("is_st", "is_suspended", "is_delisted", "shard_id")}).where("symbol is not null and day is not null")


@query
def cross_shard_keys(spark, folder):
    """Q2: pairs of shards whose ranges overlap, with the number of keys that are in both."""
    ledger = table(spark, folder, "status_shard").select("shard_id", N.day_number("date_start").alias("a"), N.day_number("date_end").alias("b")).distinct()
    pairs = ledger.alias("x").join(ledger.alias("y"), (F.col("x.shard_id") < F.col("y.shard_id")) & (F.col("x.a") <= F.col("y.b")) & (F.col("y.a") <= F.col("x.b")))
    overlapping = pairs.select(F.col("x.shard_id").alias("left_shard"), F.col("y.shard_id").alias("right_shard"))
    rows = table(spark, folder, "security_status").select(N.symbol("symbol").alias("symbol"), N.day_number("trade_date").alias("day"), "shard_id").distinct()
    shards = rows.groupBy("symbol", "day").agg(F.sort_array(F.collect_set("shard_id")).alias("held")).where(F.size("held") > 1)  # shards of one key: as many as delivered it
    both = shards.select(F.explode("held").alias("left_shard"), "held").select("left_shard", F.explode("held").alias("right_shard")).where("left_shard < right_shard")
    shared = both.groupBy("left_shard", "right_shard").agg(F.count("*").alias("n"))
    return overlapping.join(shared, ["left_shard", "right_shard"], "left").groupBy("left_shard").agg(F.count("*").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("shared_keys"))


@query
def physical_order(spark, folder):
    """Rows of a file that stand after one with a later date, and after one of the same date with a larger symbol.

    Spark has no order of rows, but each row knows its file and place there; the row before is found block by block.
    """
    t = table(spark, folder, "stock_day").select("symbol", "trade_date", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    keyed = t.select("file", "place", F.struct("trade_date", "symbol").alias("at"))
    before = W.lagged(keyed, ["file"], F.floor(F.col("place") / 65536), ["place"], "at", "before")
    return before.agg(F.count("*").alias("rows"), F.count_if(F.col("before.trade_date") > F.col("at.trade_date")).alias("date_back"), F.count_if(F.col("before") > F.col("at")).alias("key_back"))


def day_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, open, close, volume): raw daily figures of the session's counting rows."""
    price = lambda c: F.when(F.col(c) > 0, F.col("millis"))
    return minute_rows(spark, folder).groupBy("symbol", "day").agg(F.min_by("open", price("open")).alias("open"), F.max_by("close", price("close")).alias("close"), F.coalesce(F.sum(F.when(F.col("volume") > 0, F.col("volume"))), F.lit(0.0)).alias("volume"))


@query
def status_daily_consistency(spark, folder):
    """Q4: suspension flags against whether the symbol traded on the day, by month."""
    joined = status_rows(spark, folder).join(day_volumes(spark, folder).select("symbol", "day", "volume"), ["symbol", "day"], "left")
    idle, said = F.coalesce(F.col("volume"), F.lit(0.0)) <= 0, F.coalesce(F.col("is_suspended"), F.lit(False))
    return joined.groupBy(F.substring(N.day_text(F.col("day")), 1, 7).alias("month")).agg(
        F.count("*").alias("n"), F.count_if(F.col("is_suspended").isNull()).alias("unknown"), F.count_if(said != idle).alias("mismatches"),
        F.count_if(~said & idle).alias("idle_unsuspended"), F.count_if(said & ~idle).alias("traded_suspended"))


@query
def factor_changes(spark, folder):
    """Q6: changes of the factor beyond 1 %, with the raw and adjusted ratio of the open to the close before and the days between.

    The context's factors never change, so a month's mean close stands for the factor of its days.
    """
    spec = W.along(["symbol"], "day")
    bars = daily_bars(spark, folder).withColumn("month", F.date_format("trade_date", "yyyy-MM")).withColumn("day", F.unix_date("trade_date"))
    means = bars.groupBy("symbol", "month").agg(F.round(F.avg("close"), 6).alias("factor"))
    p = bars.join(means, ["symbol", "month"]).withColumns({"prior_factor": F.lag("factor").over(spec), "prior_close": F.lag("close").over(spec), "prior_day": F.lag("day").over(spec)})
    ratio, raw = F.col("factor") / F.col("prior_factor"), F.col("open") / F.col("prior_close")
    out = p.where((F.col("prior_factor") > 0) & (F.col("prior_close") > 0) & ~ratio.between(0.99, 1.01))
    return named_day(out.select("symbol", "day", s(ratio).alias("factor_ratio"), s(raw).alias("open_ratio"), s(ratio * raw).alias("adjusted_open_ratio"), (F.col("day") - F.col("prior_day")).alias("gap_days")))


@query
def factor_and_day_validity(spark, folder):
    """Q3: per symbol, days whose factor is unknown or not above 0, and days with rows that aren't open in the calendar."""
    factors = table(spark, folder, "stock_day").select(N.symbol("symbol").alias("symbol"), N.finite_positive("adjust_factor").isNull().cast("int").alias("bad_factor"), F.lit(0).alias("closed_day"))
    days = minute_rows(spark, folder).select("symbol", "day").distinct().join(open_days(spark, folder), "day", "left")
    closed = days.select("symbol", F.lit(0).alias("bad_factor"), F.col("ordinal").isNull().cast("int").alias("closed_day"))
    return factors.unionByName(closed).groupBy("symbol").agg(F.sum("bad_factor").alias("bad_factors"), F.sum("closed_day").alias("closed_days"), F.count("*").alias("looked_at"))


@query
def identity_conflicts(spark, folder):
    """Q7: symbols of snapshots without a status row, symbols with a status row but no snapshot, and names that several symbols have."""
    name = F.nullif(F.upper(F.regexp_replace("name", r"[\s\p{Z}]", "")), F.lit(""))
    history = table(spark, folder, "universe_snapshot").select(N.symbol("symbol").alias("symbol"), name.alias("name")).where("symbol is not null").distinct()
    identity = table(spark, folder, "security_status").select(N.symbol("symbol").alias("symbol")).where("symbol is not null").distinct()
    orphan = history.select("symbol").distinct().join(identity, "symbol", "left_anti").select(F.lit("orphan_history").alias("reason"), F.col("symbol").alias("who"))
    without = identity.join(history.select("symbol").distinct(), "symbol", "left_anti").select(F.lit("identity_without_history").alias("reason"), F.col("symbol").alias("who"))
    shared = history.where("name is not null").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("name_of_several").alias("reason"), F.col("name").alias("who"))
    looked = history.agg(F.lit("looked_at").alias("reason"), F.count_distinct("symbol").cast("string").alias("who"))
    return orphan.unionByName(without).unionByName(shared).unionByName(looked)


@query
def suspension_runs(spark, folder):
    """Stretches of open days for which a symbol is said to be suspended, and whether they are long."""
    days = status_rows(spark, folder).join(open_days(spark, folder), "day").where("is_suspended")
    broken = F.coalesce(F.col("ordinal") - F.lag("ordinal").over(W.along(["symbol"], "ordinal")) > 1, F.lit(True))
    runs = W.islands(days, ["symbol"], "ordinal", broken)
    return runs.groupBy("symbol", "island").agg(N.day_text(F.min("day")).alias("first_day"), N.day_text(F.max("day")).alias("last_day"), F.count("*").alias("days"), (F.count("*") >= 5).alias("long")).drop("island")


@query
def auxiliary_keys(spark, folder):
    """Q9: by date, symbols in one of the daily tables only, and statements that were to be known before they were published."""
    stock, bars = stock_days(spark, folder).select("symbol", "day", F.lit(True).alias("a")), day_volumes(spark, folder).select("symbol", "day", F.lit(True).alias("b"))
    within = stock.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    both = stock.join(bars, ["symbol", "day"], "full").join(F.broadcast(within)).where(F.col("day").between(F.col("lo"), F.col("hi")))
    st = table(spark, folder, "statement_quarterly").select(N.day_number("publish_date").alias("day"), N.day_number("feature_available_date").alias("known"))
    early = st.where("day is not null").groupBy("day").agg(F.count_if(F.col("known") <= F.col("day")).alias("known_early"), F.count_if(F.col("known").isNull()).alias("never_known"))
    g = both.groupBy("day").agg(F.count_if(F.col("b").isNull()).alias("without_bars"), F.count_if(F.col("a").isNull()).alias("without_context"), F.count("*").alias("keys"))
    out = g.join(early, "day", "full").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("without_bars", "without_context", "keys", "known_early", "never_known")])
    return named_day(out)


@query
def latest_parity(spark, folder):
    """Q10: of each pair of daily tables, symbols of the first one's latest date that the second lacks on that date, and the other way about."""
    parts = {
        "stock_day": stock_days(spark, folder).select("symbol", "day"), "status": status_rows(spark, folder).select("symbol", "day"),
        "bars": day_volumes(spark, folder).select("symbol", "day"),
    }
    out = []
    for a, b in (("stock_day", "status"), ("status", "bars"), ("bars", "stock_day")):
        last = parts[a].agg(F.max("day").alias("day"))
        x, y = parts[a].join(F.broadcast(last), "day").select("symbol", F.lit(True).alias("x")), parts[b].join(F.broadcast(last), "day").select("symbol", F.lit(True).alias("y"))
        out.append(x.join(y, "symbol", "full").agg(F.lit(f"{a}-{b}").alias("pair"), F.count("*").alias("symbols"), F.count_if(F.col("y").isNull()).alias("missing"), F.count_if(F.col("x").isNull()).alias("extra")))
    return reduce(DataFrame.unionByName, out)


@query
def lifecycle_effectivity(spark, folder):
    """Status rows of each symbol before it was listed, within its life, and after it was first said to be delisted."""
    snaps = table(spark, folder, "universe_snapshot").select(N.symbol("symbol").alias("symbol"), N.day_number("list_date").alias("listed"))
    listed = snaps.where("symbol is not null").groupBy("symbol").agg(F.min("listed").alias("listed"))
    rows = status_rows(spark, folder)
    gone = rows.where("is_delisted").groupBy("symbol").agg(F.min("day").alias("gone"))
    placed = rows.join(listed, "symbol", "left").join(gone, "symbol", "left")
    early, late = F.coalesce(F.col("day") < F.col("listed"), F.lit(False)), F.coalesce(F.col("day") > F.col("gone"), F.lit(False))
    return placed.groupBy("symbol").agg(F.count_if(early).alias("before"), F.count_if(~early & ~late).alias("within"), F.count_if(late).alias("after"), F.count_if(late & F.col("is_delisted").eqNullSafe(False)).alias("came_back"))


def said_st(name: Column) -> Column:
    """whether a name begins as those of special-treatment securities do; unknown for a blank one."""
    bare = F.upper(F.regexp_replace(name, r"[\s\p{Z}]", ""))
    return F.when(bare != "", bare.rlike(r"^(?:S\*?ST|\*?ST)"))


@query
def status_invariants(spark, folder):
    """States that should not occur: special treatment or suspension of a delisted symbol, a name that says otherwise than the flag."""
    rows = status_rows(spark, folder)
    snaps = table(spark, folder, "universe_snapshot").select(N.symbol("symbol").alias("symbol"), N.day_number("trade_date").alias("day"), "name", F.col("is_st").alias("said"), "received_at")
    named = counting(snaps, ["symbol", "day"], "received_at", {"name": F.col("name"), "said": F.col("said")}).where("symbol is not null and day is not null")
    both = rows.join(named, ["symbol", "day"], "left").withColumn("by_name", said_st(F.col("name")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return both.agg(
        F.count("*").alias("rows"), F.count_if(yes(F.col("is_delisted")) & yes(F.col("is_st"))).alias("delisted_st"), F.count_if(yes(F.col("is_delisted")) & yes(~F.col("is_suspended"))).alias("delisted_not_suspended"),
        F.count_if(F.col("is_st").isNull() & F.col("is_suspended").isNull() & F.col("is_delisted").isNull()).alias("nothing_known"),
        F.count_if(yes(F.col("by_name") != F.col("is_st"))).alias("name_against_flag"), F.count_if(yes(F.col("by_name") != F.col("said"))).alias("name_against_snapshot"))


@query
def minute_daily_quality(spark, folder):
    """A day's extremes and last price from the rows that count against those of all rows ever delivered, as quality classes."""
    rows = table(spark, folder, "minute_bars").select(N.symbol("symbol").alias("symbol"), N.sealed(N.day_number("trade_date")).alias("day"), N.sealed(N.clock("bar_time")).alias("millis"), *[N.finite_positive(c).alias(c) for c in ("high", "low", "close")])
    all_rows = rows.where(N.session_ordinal(F.col("millis")).isNotNull()).groupBy("symbol", "day").agg(F.max("high").alias("h0"), F.min("low").alias("l0"))
    counted = minute_rows(spark, folder).where("not auction").groupBy("symbol", "day").agg(F.max(F.when(F.col("high") > 0, F.col("high"))).alias("h1"), F.min(F.when(F.col("low") > 0, F.col("low"))).alias("l1"))
    off = lambda a, b: F.abs(safe_ratio(F.col(a), F.col(b)) - 1)
    g = counted.join(all_rows, ["symbol", "day"]).withColumn("off", F.greatest(off("h0", "h1"), off("l0", "l1")))
    grade = ladder(F.col("off"), (1e-9, "normal"), (0.005, "warning"), (0.01, "soft_warning"), (0.05, "medium"), (0.2, "high"), top="critical")
    return g.groupBy(F.coalesce(grade, F.lit("unknown")).alias("grade")).agg(F.count("*").alias("days"), s(F.max("off")).alias("worst"))


@query
def provider_parity(spark, folder):
    """Slots of a symbol's day as one feed has them against those of all other feeds: in one only, in both, closes that differ."""
    rows = table(spark, folder, "minute_bars").select(N.sealed(N.symbol("symbol")).alias("symbol"), N.sealed(N.day_number("trade_date")).alias("day"), N.sealed(N.clock("bar_time")).alias("millis"), N.finite_positive("close").alias("close"), (F.col("source") == "feed_delta").alias("one"))
    ordinal = N.session_ordinal(F.col("millis"))
    slots = rows.where("symbol is not null and day is not null").withColumn("slot", F.floor(ordinal / 5).cast("int")).where("slot is not null and close is not null")
    g = slots.groupBy("symbol", "day", "slot").agg(
        F.max(F.when(F.col("one"), F.struct("millis", "close"))).alias("a"), F.max(F.when(~F.col("one"), F.struct("millis", "close"))).alias("b"))
    far = F.abs(F.col("a.close") - F.col("b.close")) > F.greatest(F.abs("b.close") * 0.0005, F.lit(0.005))
    kind = first_reason((F.col("b").isNull(), "left_only"), (F.col("a").isNull(), "right_only"), (far, "differs"), default="same")
    return named_day(g.groupBy("day", kind.alias("kind")).agg(F.count("*").alias("slots")))


@query
def artifact_verification(spark, folder):
    """Q15: whether the table of outcomes has each signal once, none besides, and entries whenever it gives a reason to."""
    signals = signal_points(spark, folder)
    made = outcomes_of(spark, folder, signals)
    keyed = signals.select("signal_id", F.lit(1).alias("a")).join(made.select("signal_id", F.lit(1).alias("b"), "reason", "entry", "return_1b"), "signal_id", "full")
    return keyed.agg(
        F.count("*").alias("rows"), F.count_distinct("signal_id").alias("different"), F.count_if(F.col("b").isNull()).alias("signals_without"), F.count_if(F.col("a").isNull()).alias("outcomes_without"),
        F.count_if((F.col("reason") == "ok") != F.col("entry").isNotNull()).alias("reason_against_entry"), F.count_if(F.col("entry").isNull() & F.col("return_1b").isNotNull()).alias("outcome_without_entry"))


@query
def gap_days(spark, folder):
    """Q17: for each symbol, stretches of open days within its bars' span on which it has none, longest first in number."""
    have = day_volumes(spark, folder).select("symbol", "day").join(open_days(spark, folder), "day")
    ahead = F.lead("ordinal").over(W.along(["symbol"], "ordinal"))
    gaps = have.withColumn("next", ahead).where(F.col("next") > F.col("ordinal") + 1).select("symbol", (F.col("ordinal") + 1).alias("from"), (F.col("next") - 1).alias("to"))
    days = open_days(spark, folder)
    first = days.select(F.col("ordinal").alias("from"), N.day_text(F.col("day")).alias("first_day"))
    last = days.select(F.col("ordinal").alias("to"), N.day_text(F.col("day")).alias("last_day"))
    return gaps.join(first, "from").join(last, "to").select("symbol", "first_day", "last_day", (F.col("to") - F.col("from") + 1).alias("days"))


@query
def secondary_validation(spark, folder):
    """Q18: the special-treatment flag of a second source against the first, by what each says."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    second = table(spark, folder, "universe_snapshot").select(N.symbol("symbol").alias("symbol"), N.day_number("trade_date").alias("day"), F.col("is_st").alias("second"), "received_at")
    snaps = counting(second, ["symbol", "day"], "received_at", {"second": F.col("second")}).where("symbol is not null and day is not null").withColumn("b", F.lit(True))
    both = status_rows(spark, folder).select("symbol", "day", F.col("is_st").alias("first"), F.lit(True).alias("a")).join(snaps, ["symbol", "day"], "full")
    kind = first_reason((F.col("a").isNull(), "second_only"), (F.col("b").isNull(), "first_only"), (F.col("first").eqNullSafe(F.col("second")), "same"), default="differs")
    return both.groupBy(kind.alias("kind"), word("first").alias("first"), word("second").alias("second")).agg(F.count("*").alias("n"))


@query
def ledger_chain(spark, folder):
    """Shards of a series whose first day isn't the open day after the last day of the shard before."""
    days = open_days(spark, folder)
    ledger = table(spark, folder, "status_shard").select("shard_id", F.regexp_extract("shard_id", r"^(.*)-\d+$", 1).alias("series"), N.day_number("date_start").alias("start"), N.day_number("date_end").alias("end")).distinct()
    chained = ledger.withColumn("old_end", F.lag("end").over(W.along(["series"], "start", "shard_id")))
    due = days.select("day", F.lead("day").over(Window.orderBy("day")).alias("due"))  # the calendar: some ten thousand rows at most
    checked = chained.join(due, F.col("old_end") == F.col("day"), "left")
    kind = first_reason((F.col("old_end").isNull(), "first"), (F.col("due").isNull(), "closed_end"), (F.col("start") < F.col("due"), "overlap"), (F.col("start") > F.col("due"), "gap"), default="chained")
    return checked.groupBy("series", kind.alias("kind")).agg(F.count("*").alias("shards"))
