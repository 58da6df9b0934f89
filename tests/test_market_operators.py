"""Intraday operators on small frames with known answers: the auction, gaps, the future, episodes, tests."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import minutes as M, windows as W
from tidemark.operators.aggregates import exact_quantiles, trimmed_mean
from tidemark.operators.joins import nearest_controls
from tidemark.plans.audits import stable_hits
from tidemark.plans.evaluation import student_p
from tidemark.plans.repair import ALIASES, aliased, day_vector, normalised

BAR = "symbol string, day int, slot int, open double, high double, low double, close double, volume double, amount double, bars long"


def bars(spark, days, slots=48, price=lambda d, s: 10.0 + d + s / 100, skip=()):
    rows = [("a", d, s, price(d, s), price(d, s) + 0.05, price(d, s) - 0.05, price(d, s) + 0.01, 100.0, 1000.0, 1) for d in days for s in range(slots) if (d, s) not in skip]
    return spark.createDataFrame(rows, BAR)


def test_auction_folds_into_the_first_bucket(spark):
    rows = [("a", 1, 34200000, True, 0, 9.0, 9.5, 9.0, 9.2, 10.0, 90.0), ("a", 1, 34260000, False, 0, 10.0, 10.1, 9.9, 10.0, 5.0, 50.0), ("a", 1, 34860000, False, 2, 11.0, None, 10.5, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, day int, millis int, auction boolean, slot int, open double, high double, low double, close double, volume double, amount double")
    got = {r.slot: r for r in M.bucket_bars(df, ["symbol", "day", "slot"], "millis", ~F.col("auction")).collect()}
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].volume, got[0].bars) == (9.0, 10.1, 9.0, 10.0, 15.0, 1)
    assert (got[2].high, got[2].close, got[2].volume) == (None, None, 0.0)


def test_hours_are_whole_or_absent(spark):
    df = bars(spark, [1], skip={(1, 13)}).withColumn("hour", (F.floor(F.col("slot") / 12) + 1).cast("int"))
    assert sorted(r.hour for r in M.whole_buckets(df, ["symbol", "day", "hour"], "slot", 12).collect()) == [1, 3, 4]


def test_masks_and_adjustment(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.5, 0.0, 2.0, True), (1.0, 1.0, 2.0, 1.0, 2.0, False), (None, float("nan"), 1.0, 1.0, None, None)], "open double, high double, low double, close double, f double, bad boolean")
    got = M.adjusted(M.field_masks(df, {"low": F.col("bad")}), "f").collect()
    assert [tuple(r)[:4] for r in got[:2]] == [(2.0, 4.0, None, None), (2.0, None, None, 2.0)]
    assert got[2].open is None and got[2].close is None


def test_features_do_not_see_the_future(spark):
    known = bars(spark, [1, 2, 3])
    changed = known.withColumns({c: F.when(F.col("day") == 3, F.col(c) * 7).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    upto = lambda df: sorted(map(tuple, M.rolling_features(df, "symbol", ["day", "slot"], "volume", (5, 60)).where("day < 3").collect()))
    assert upto(known) == upto(changed)
    state = lambda df: sorted(map(tuple, M.running_state(df.withColumn("before", F.lit(1.0)), ["symbol", "day"], "slot", "before").where("day < 3").drop("before").collect()))
    assert state(known) == state(changed)


def test_incomplete_windows_are_null(spark):
    got = {(r.day, r.slot): r for r in M.rolling_features(bars(spark, [1, 2]), "symbol", ["day", "slot"], "volume", (5,)).collect()}
    assert got[1, 3].deviation_5 is None and got[1, 4].deviation_5 is not None and got[1, 4].volatility_5 is None and got[2, 0].return_5 is not None


def test_outcomes(spark):
    calendar = spark.createDataFrame([(1, 1), (2, 2), (4, 3), (5, 4)], "day int, ordinal int")
    df = bars(spark, [1, 2, 5], skip={(1, 20), (5, 7)})  # closed on 3, suspended on 4
    signals = spark.createDataFrame([("x", "a", 1, 0), ("gap", "a", 1, 18), ("before", "a", 1, 19), ("late", "a", 2, 47), ("none", "b", 1, 0), ("over", "a", 1, 47)], "id string, symbol string, day int, slot int")
    got = {r.id: r for r in M.signal_outcomes(signals, df, calendar, 48).collect()}
    entry = 10 + 1 + 0.01
    assert got["x"].entry == pytest.approx(entry) and got["x"].return_1b == pytest.approx((11.02 + 0.01) / entry - 1)
    assert got["x"].return_1d == pytest.approx((12.47 + 0.01) / entry - 1) and got["x"].mfe_1d == pytest.approx((12.47 + 0.05) / entry - 1)
    assert got["x"].return_2d is None and got["x"].mfe_2d is None and got["x"].return_3d is not None and got["x"].mfe_3d is None  # day 4 has no bars, day 5 isn't whole
    assert got["gap"].entry is not None and got["gap"].return_1b is None  # the bar after the fill is missing
    assert (got["before"].reason, got["before"].entry) == ("no_next_bar", None) and got["late"].reason == "no_next_bar" and got["none"].reason == "no_signal_bar"
    assert got["over"].reason == "ok" and got["over"].entry == pytest.approx(12.0)  # the first bar of the next open day


def test_score_once(spark):
    df = spark.createDataFrame([("s1", "a", 1), ("s2", "a", 1), ("s3", None, 1)], "id string, k string, d int")
    seen = []

    def score(keys):
        seen.append(keys.count())
        return keys.withColumn("x", F.coalesce("k", F.lit("?")))

    assert {(r.id, r.x) for r in M.score_once(df, ["k", "d"], score).collect()} == {("s1", "a"), ("s2", "a"), ("s3", "?")} and seen == [2]


def test_execution_window_reasons(spark):
    df = bars(spark, [1, 2, 3, 4], slots=8, skip={(2, 3)}).withColumns({"volume": F.when(F.col("day") == 3, 0.0).otherwise(F.col("volume")), "high": F.when(F.col("day") == 4, F.col("low")).otherwise(F.col("high"))})
    flat = df.withColumns({c: F.when(F.col("day") == 4, 5.0).otherwise(F.col(c)) for c in ("high", "low")})
    got = {r.day: r.reason for r in M.execution_windows(flat, ["symbol", "day"], "slot", 1, 5).collect()}
    assert got == {1: "ok", 2: "incomplete", 3: "no_flow", 4: "one_price"}


def test_stable_runs_start_anew(spark):
    seq = [(i, t, b) for i, (t, b) in enumerate([(False, False), (True, False), (False, False), (False, False), (False, False), (False, False), (False, True), (False, False), (False, False), (False, False)])]
    df = spark.createDataFrame([([{"slot": i, "touched": t, "below": b} for i, t, b in seq],)], "bars array<struct<slot:int,touched:boolean,below:boolean>>")
    assert df.select(stable_hits(F.col("bars"), 3)).first()[0] == [3, 9]


def test_lags_in_blocks(spark):
    df = spark.createDataFrame([(k, i, i % 7) for k in ("a", None) for i in range(50)], "k string, t int, v int")
    got = {(r.k, r.t): r.old for r in W.lagged(df, ["k"], F.floor(F.col("t") / 8), ["t"], "v", "old").collect()}
    assert got == {(k, i): (i - 1) % 7 if i else None for k in ("a", None) for i in range(50)}


def test_quantiles_by_running_counts(spark):
    import random
    import statistics

    rng = random.Random(5)
    values = [rng.choice([1.0, -3.5, 1e9, rng.random(), rng.gauss(0, 1e4)]) for _ in range(999)]
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("one", 2.0), ("none", None)], "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).collect()}
    assert got["k"].m == pytest.approx(statistics.median(values)) and got["one"].m == 2.0 and "none" not in got
    top = sorted(values)[: len(values) - 10]
    assert {r.k: r.trimmed for r in trimmed_mean(df, ["k"], "v").collect()}["k"] == pytest.approx(sum(top) / len(top))


def test_nearest_controls_with_ties(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [(rng.choice("xy"), i, rng.choice([5.0, 5.0, 6.0, 7.5, rng.uniform(1, 20), None, -1.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, id long, m double")
    got = {(r.signal, r.nth): r.control for r in nearest_controls(df.where("id % 3 = 0"), df, ["g"], "id", "m", 1.5, 4).collect()}
    want = {}
    for g, i, m in rows:
        if i % 3 or not m or m <= 0:
            continue
        near = sorted((round(abs(math.log(m) - math.log(x)), 9), j) for h, j, x in rows if h == g and j != i and x and x > 0 and abs(math.log(m) - math.log(x)) <= math.log(1.5))
        want |= {(i, n): j for n, (_, j) in enumerate(near[:4], 1)}
    assert got == want


def test_student_p():
    for t, df, p in ((2.0, 10, 0.073388), (0.0, 5, 1.0), (12.706, 1, 0.05), (1.96, 10**6, 0.049996), (-3.0, 20, 0.007076)):
        assert student_p(t, df) == pytest.approx(p, abs=2e-5)


def test_aliases_and_normaliser(spark):
    df = spark.createDataFrame([("a", "1")], "`代码` string, Date string")
    only = {"symbol": ALIASES["symbol"], "trade_date": ALIASES["trade_date"]}
    assert aliased(df, only).columns == ["symbol", "trade_date"]
    with pytest.raises(ValueError, match="symbol"):
        aliased(df.withColumn("code", F.lit("b")), only)
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), (None, 3, 7.0)], "k string, at int, v double")
    assert [tuple(r) for r in normalised(rows, {"k": F.col("k"), "v": F.col("v")}, ["k"], "at").collect()] == [("a", 6.0)]


def test_day_vector_of_one_bar(spark):
    r = day_vector(bars(spark, [1], slots=1), ["symbol", "day"], "slot", 24).first()
    assert r.n == 1 and r.last_5m_ret is None and r.realised_vol is None and r.pm_ret is None and r.high_time is None and r.top_share == 1.0


def test_long_windows_are_what_frames_give(spark):
    import random

    rng = random.Random(11)
    rows = [(k, i, rng.choice([None, rng.gauss(0, 3), rng.gauss(0, 3), 2.0, -5.0])) for k in "ab" for i in range(120)] + [("flat", i, 7.25) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    spec, windows = W.along(["k"], "t"), (2, 3, 5, 8, 30)
    fast = W.long_windows(df, spec, windows, {"mean": "v"}, {"sd": "v"}, {"hi": "v"}, {"lo": "v"})
    slow = df.withColumns({f"{name}{n}": W.complete(agg, F.col("v"), spec, -(n - 1), 0) for n in windows for name, agg in (("mean", F.avg), ("sd", F.stddev_samp), ("hi", F.max), ("lo", F.min))})
    by = lambda d: {(r.k, r.t): r.asDict() for r in d.collect()}
    got, want = by(fast), by(slow)
    assert set(got) == set(want)
    for at, r in want.items():
        for c, x in r.items():
            assert (got[at][c] is None) == (x is None) and (x is None or got[at][c] == x or got[at][c] == pytest.approx(x, abs=1e-6))
    assert sum(r["hi5"] is not None for r in want.values()) > 40


def test_overlap_counts(spark):
    import random

    from tidemark.operators.joins import overlap_counts

    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), i, (s := rng.randrange(300)), s + rng.choice([0, 1, 5, 90])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, s int, e int")
    got = {r.i: r.overlaps for r in overlap_counts(df, "k", "i", "s", "e", 16).collect()}
    assert got == {i: sum(1 for k2, j, s2, e2 in rows if k2 == k and j != i and s <= e2 and s2 <= e) for k, i, s, e in rows}
