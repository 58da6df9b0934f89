"""Operators over intraday bars: buckets with the auction, hours, features of trailing windows, running state, execution windows, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import first_reason, safe_ln, safe_ratio
from tidemark.operators import windows as W

#: The windows that features are made for, in bars.
WINDOWS = (5, 10, 20, 30, 60, 120, 240)


def field_masks(bars: DataFrame, excluded: dict[str, Column] | None = None) -> DataFrame:
    """P5: ``bars`` plus valid_open, valid_high, valid_low, valid_close; a field may be excluded by a flag. Unknown is not valid."""
    out = excluded or {}
    sure = lambda name, c: F.coalesce(c, F.lit(False)) & ~F.coalesce(out.get(name, F.lit(False)), F.lit(False))
    range_ok = (F.col("high") > 0) & (F.col("low") > 0) & (F.col("high") >= F.col("low"))
    return bars.withColumns({
        "valid_open": sure("open", F.col("open") > 0), "valid_high": sure("high", range_ok), "valid_low": sure("low", range_ok), "valid_close": sure("close", F.col("close") > 0),
    })


def adjusted(bars: DataFrame, factor: str) -> DataFrame:
    """Open, high, low and close times the factor where valid and finite, else null."""
    infinite = float("inf")
    times = lambda c: F.when(F.col(f"valid_{c}") & (F.col(factor) > 0) & (F.col(c) * F.col(factor) < infinite), F.col(c) * F.col(factor))
    return bars.withColumns({c: times(c) for c in ("open", "high", "low", "close")})


def bucket_bars(bars: DataFrame, keys: list[str], order: str, regular: Column) -> DataFrame:
    """A1, A2: one bar per key: first open and last close that are known, extremes, flows, and the number of ``regular`` rows.

    Rows that aren't regular (an auction) are folded into the bucket that their key names. One partial aggregation by hash.
    """
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    return bars.groupBy(*keys).agg(
        F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"), F.count_if(regular).alias("bars"))


def whole_buckets(bars: DataFrame, keys: list[str], slot: str, expected: int) -> DataFrame:
    """A3, A4: larger buckets of ``bars``, those only that have exactly ``expected`` different regular slots."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(slot))
    out = bars.groupBy(*keys).agg(
        F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.count_if(F.col("bars") > 0).alias("slots"))
    return out.where(F.col("slots") == expected).drop("slots")


def rolling_features(bars: DataFrame, key: str, order: list[str], flow: str, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(key, order, return_n, deviation_n, range_n, volatility_n, flow_ratio_n) for each window of ``n`` bars, over sessions.

    A window that isn't complete and known gives null. All share one sort, and a row costs the same whatever the windows' lengths:
    sums are differences of running sums, extremes are those of two overlapping stretches (``long_windows``).
    """
    spec = W.along([key], *order)
    lagged = bars.withColumns({f"_lag{n}": F.lag("close", n).over(spec) for n in (1, *windows)})
    logs = lagged.withColumn("_log", safe_ln(safe_ratio(F.col("close"), F.col("_lag1"))))
    wide = W.long_windows(logs, spec, windows, means={"_mean": "close", "_flow": flow}, deviations={"_sd": "_log"}, highest={"_high": "high"}, lowest={"_low": "low"})
    over = lambda a, b: safe_ratio(F.col(a), F.when(F.col(b) > 0, F.col(b))) - 1
    return wide.select(key, *order, *[x for n in windows for x in (
        over("close", f"_lag{n}").alias(f"return_{n}"), over("close", f"_mean{n}").alias(f"deviation_{n}"), over(f"_high{n}", f"_low{n}").alias(f"range_{n}"),
        F.col(f"_sd{n}").alias(f"volatility_{n}"), over(flow, f"_flow{n}").alias(f"flow_ratio_{n}"))])


def running_state(bars: DataFrame, bucket: list[str], order: str, before: str) -> DataFrame:
    """``bars`` plus the state of its bucket so far: extremes, rebound, range, place of the close, lower wick, and the amounts of
    rising and falling bars. ``before`` is the last close before the bucket, against which its first bar moves."""
    spec = W.along(bucket, order)
    so_far = spec.rowsBetween(Window.unboundedPreceding, 0)
    named = bars.withColumns({
        "_high": F.max("high").over(so_far), "_low": F.min("low").over(so_far), "_open": F.first("open", ignorenulls=True).over(so_far), "_previous": F.coalesce(F.lag("close").over(spec), F.col(before)),
    })
    way = F.signum(F.col("close") - F.col("_previous"))
    flows = named.withColumns({"_up": F.sum(F.when(way > 0, F.col("amount")).otherwise(0.0)).over(so_far), "_down": F.sum(F.when(way < 0, F.col("amount")).otherwise(0.0)).over(so_far)})
    span = F.col("_high") - F.col("_low")
    return flows.select(
        *bars.columns, F.col("_high").alias("partial_high"), F.col("_low").alias("partial_low"),
        (safe_ratio(F.col("close"), F.col("_low")) - 1).alias("rebound"), (safe_ratio(F.col("_high"), F.col("_low")) - 1).alias("partial_range"),
        F.when(span > 0, (F.col("close") - F.col("_low")) / span).otherwise(0.5).alias("location"),
        (safe_ratio(F.least("_open", "close"), F.col("_low")) - 1).alias("lower_wick"),
        F.when(F.col("_down") > 0, F.col("_up") / F.col("_down")).alias("up_down_ratio"))


def execution_windows(bars: DataFrame, keys: list[str], slot: str, first: int, last: int) -> DataFrame:
    """The window of slots ``first`` to ``last`` of each key: VWAP, extremes, first and last price (of bars with flow, else
    of any), whether it is complete, whether it can be bought and sold, and why not."""
    inside = F.col(slot).between(first, last)
    flow = inside & (F.col("volume") > 0) & (F.col("amount") > 0)
    only = lambda condition, c: F.when(condition & F.col(c).isNotNull(), F.col(slot))
    g = bars.groupBy(*keys).agg(
        F.count_if(inside & F.col("close").isNotNull()).alias("bars"), F.max(F.when(inside, F.col("high"))).alias("high"), F.min(F.when(inside, F.col("low"))).alias("low"),
        F.sum(F.when(flow, F.col("amount"))).alias("_a"), F.sum(F.when(flow, F.col("volume"))).alias("_v"),
        F.coalesce(F.min_by("open", only(flow, "open")), F.min_by("open", only(inside, "open"))).alias("first_price"),
        F.coalesce(F.max_by("close", only(flow, "close")), F.max_by("close", only(inside, "close"))).alias("last_price"))
    whole = F.col("bars") == last - first + 1
    why = first_reason((F.col("bars") == 0, "missing"), (~whole, "incomplete"), (F.col("_v").isNull(), "no_flow"), (F.col("high") <= F.col("low"), "one_price"))
    return g.select(*keys, "bars", "high", "low", "first_price", "last_price", safe_ratio(F.col("_a"), F.col("_v")).alias("vwap"), whole.alias("complete"), (why == "ok").alias("executable"), why.alias("reason"))


def signal_outcomes(signals: DataFrame, bars: DataFrame, calendar: DataFrame, slots: int, bar_steps: tuple[int, ...] = (1, 3, 6), day_steps: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Each (symbol, day, slot) of ``signals`` with its entry and outcomes.

    Entry is the open of the next bar: the next slot, or the first slot of the next open day. Exits after ``bar_steps`` count from
    the fill bar and need every bar between; exits after ``day_steps`` are closes of later days of ``calendar`` (day,
    ordinal), never of days on which the symbol merely traded next. Best and worst of those days count only if every day has
    all ``slots`` bars. ``reason`` says why there is no entry. A bar has a place on the market's own time line (day
    ordinal times slots plus slot), so that contiguity is a difference of places and all comes from one sort by place.
    """
    line = bars.join(calendar, "day").withColumn("_place", F.col("ordinal").cast("bigint") * slots + F.col("slot"))
    spec = W.along(["symbol"], "_place")
    ahead = {n: W.steps_ahead(["symbol"], "_place", 1, n) for n in (1, *(1 + s for s in bar_steps))}
    named = line.withColumns({
        "_entry_place": F.min("_place").over(ahead[1]), "_entry": F.min("open").over(ahead[1]),
        **{f"_n{s}": F.count("close").over(ahead[1 + s]) for s in bar_steps},
        **{f"_exit{s}": F.max_by("close", "_place").over(ahead[1 + s]) for s in bar_steps},
    })
    daily = line.groupBy("symbol", "ordinal").agg(F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col("slot"))).alias("_c"), F.count("close").alias("_k"))
    later = {s: W.steps_ahead(["symbol"], "ordinal", 1, s) for s in day_steps}
    exactly = {s: W.steps_ahead(["symbol"], "ordinal", s, s) for s in day_steps}
    days = daily.select("symbol", "ordinal", *[x for s in day_steps for x in (
        F.max("_c").over(exactly[s]).alias(f"_day{s}"), F.when(F.sum(F.when(F.col("_k") == slots, 1).otherwise(0)).over(later[s]) == s, F.max("_h").over(later[s])).alias(f"_best{s}"),
        F.when(F.sum(F.when(F.col("_k") == slots, 1).otherwise(0)).over(later[s]) == s, F.min("_l").over(later[s])).alias(f"_worst{s}"))])
    marked = named.select("symbol", "day", "slot", "ordinal", "_entry", *[F.when(F.col(f"_n{s}") == 1 + s, F.col(f"_exit{s}")).alias(f"_exit{s}") for s in bar_steps])
    found = signals.join(marked.join(days, ["symbol", "ordinal"], "left"), ["symbol", "day", "slot"], "left")
    entry = F.when(F.col("_entry") > 0, F.col("_entry"))
    why = first_reason((F.col("ordinal").isNull(), "no_signal_bar"), (F.col("_entry").isNull(), "no_next_bar"), (~(F.col("_entry") > 0), "bad_price"))
    gain = lambda c: safe_ratio(F.col(c), entry) - 1
    return found.select(
        *signals.columns, entry.alias("entry"), why.alias("reason"), *[gain(f"_exit{s}").alias(f"return_{s}b") for s in bar_steps],
        *[x for s in day_steps for x in (gain(f"_day{s}").alias(f"return_{s}d"), gain(f"_best{s}").alias(f"mfe_{s}d"), gain(f"_worst{s}").alias(f"mae_{s}d"))])


def score_once(rows: DataFrame, keys: list[str], score) -> DataFrame:
    """``rows`` with the columns that ``score`` adds to their different keys, each scored once and joined back; null keys match null keys."""
    scored = score(rows.select(*keys).distinct())
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    added = [c for c in scored.columns if c not in keys]
    right = scored.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *added)
    return rows.join(right, same, "left").select(*rows.columns, *added)
