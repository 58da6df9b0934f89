"""Joins, windows and aggregates against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A, joins as J, windows as W
from tidemark.sources.tables import overlapping


@pytest.mark.parametrize("period", [1, 8, 500])
@pytest.mark.parametrize("strict,forward", [(False, False), (True, False), (False, True), (True, True)])
def test_asof(spark, period, strict, forward):
    rng = random.Random(period)
    right = {(k, t): rng.choice([None, *range(9)]) for k in "ab" for t in range(-50, 100) if rng.random() < 0.2}
    left = [(i, rng.choice("abc"), rng.choice([None, *range(-60, 120)])) for i in range(120)]
    lf = spark.createDataFrame(left, "i int, k string, t int")
    rf = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, rt int, v int")
    got = {r.i: (r.rt, r.v) for r in J.asof_join(lf, rf, ["k"], "t", "rt", ["rt", "v"], strict, forward, period).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        fit = [x for kk, x in right if kk == k and t is not None and ((x > t if strict else x >= t) if forward else (x < t if strict else x <= t))]
        at = (min(fit) if forward else max(fit)) if fit else None
        assert got[i] == (at, right.get((k, at)))


@pytest.mark.parametrize("period", [1, 16])
def test_intervals_and_overlaps(spark, period):
    rng = random.Random(period)
    spans = [(i, rng.choice("ab"), s := rng.randrange(-40, 40), rng.choice([None, s + rng.randrange(0, 60)])) for i in range(60)]
    events = [(i, rng.choice("ab"), rng.randrange(-50, 60)) for i in range(60)]
    sf, ef = spark.createDataFrame(spans, "n int, k string, s int, e int"), spark.createDataFrame(events, "i int, k string, t int")
    got = sorted((r.i, r.n) for r in J.interval_join(ef, sf, ["k"], "t", "s", "e", ["n"], period).collect())
    assert got == sorted((i, n) for i, k, t in events for n, kk, s, e in spans if k == kk and s <= t and (e is None or t <= e))
    closed = [(n, k, s, s + 20 if e is None else e) for n, k, s, e in spans]
    pairs = sorted((r.id_a, r.id_b) for r in J.overlaps(spark.createDataFrame(closed, "n int, k string, s int, e int"), "k", "n", "s", "e", period).collect())
    assert pairs == sorted((a[0], b[0]) for a in closed for b in closed if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])


def test_nearest_controls(spark):
    rng = random.Random(2)
    pool = [(i, i % 3, rng.uniform(0.1, 100)) for i in range(120)]
    df = spark.createDataFrame(pool, "i int, g int, m double")
    got = {(r.signal, r.nth): r.control for r in J.nearest_controls(df, df, ["g"], "i", "m", 1.5, 2).collect()}
    import math

    for i, g, m in pool:
        near = sorted((round(abs(math.log(m / x)), 9), j) for j, h, x in pool if h == g and j != i and abs(math.log(m / x)) <= math.log(1.5))[:2]
        assert [got.get((i, n)) for n in (1, 2)] == ([j for _, j in near] + [None, None])[:2]


def test_checked_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    assert J.checked_join(left, right.limit(1), ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        J.checked_join(left, right, ["k"]).collect()


def test_windows(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0])], "k string, t int, v double")
    spec = W.along(["k"], "t")
    got = df.select("t", W.complete(F.sum, F.col("v"), spec, -2, 0).alias("s"), W.rolling_median(F.col("v"), spec, 2).alias("m"), W.drawdown(-F.col("v"), spec).alias("d")).orderBy("t").collect()
    assert [r.s for r in got] == [None, None, None, None, None, 15.0, 18.0]
    assert [r.m for r in got] == [None, None, 1.5, None, None, 4.5, 5.5]
    up = W.streaks(df, ["k"], "t", F.col("v") > 3).orderBy("t").collect()
    assert [r.streak for r in up] == [0, 0, 0, 1, 2, 3, 4]
    assert [r.old for r in W.changes(df, ["k"], "t", "v").orderBy("t").collect()][:3] == [None, 1.0, 2.0]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [5, 5, 1, 2, 3, 100]] + [("b", 7.0), ("c", None)], "k string, v double")
    trimmed = {r.k: (r.n, r.trimmed) for r in A.trimmed_mean(df, ["k"], "v", 0.3).collect()}
    assert trimmed == {"a": (6, pytest.approx(11 / 4)), "b": (1, None)}
    summary = {r.k: r for r in A.metric_summary(df, ["k"], "v").collect()}
    assert summary["a"].median == 4.0 and summary["a"].profit_factor is None and summary["c"].n == 0
    q = [r.q for r in A.bh_adjust(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.9,)], "p double"), "p").orderBy("p").collect()]
    assert q == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.9])
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(A.correlation(F.col("x"), F.col("y"))).first()[0] is None


def test_scalars(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (nan, 1.0), (inf, 1.0), (None, 1.0), (-1.0, 4.0)], "a double, b double")
    got = df.select(S.safe_ln(F.col("a")), S.safe_ratio(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.5), (None, None), (None, None), (None, None), (None, None), (None, -0.25)]
    bad = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5), (1.0, 0.9, 0.5, 1.5), (nan, 2.0, 0.5, 1.5), (None, 2.0, 0.5, 1.5)], "o double, h double, l double, c double")
    assert [r[0] for r in bad.select(S.valid_ohlc(F.col("o"), F.col("h"), F.col("l"), F.col("c"))).collect()] == [True, False, False, False]


def test_shard_pruning():
    shards = [{"date_start": "2001-01-01", "date_end": "2001-01-31"}, {"date_start": None, "date_end": None}, {"date_start": "2001-03-01", "date_end": "2001-03-31"}]
    assert overlapping(shards, "2001-01-31", "2001-02-10") == shards[:2]


@pytest.mark.parametrize("with_fresh", [False, True])
def test_densify_snapshots(spark, with_fresh):
    rng = random.Random(5)
    schema, days = "k int, m string, d int", sorted(rng.sample(range(60), 35))
    take = lambda n, span: sorted({(rng.randrange(14), rng.choice("xyz"), rng.randrange(*span)) for _ in range(n)})
    old, fresh = take(60, (-5, 70)), take(15, (10, 40))
    new = {d for _, _, d in fresh} if with_fresh else set()
    rows = [x for x in old if x[2] not in new] + (fresh if with_fresh else [])
    until = lambda k, d: min((e for j, _, e in rows if j == k and e > d), default=1000)
    want = sorted((k, m, x) for k, m, d in rows for x in days if d <= x < until(k, d))
    calendar = spark.createDataFrame([(d,) for d in days + days[:5]], "d int")
    got = J.densify_snapshots(spark.createDataFrame(old, schema), calendar, "k", "m", "d", spark.createDataFrame(fresh, schema) if with_fresh else None)
    assert sorted(tuple(r) for r in got.collect()) == want and len({k for k, _, _ in want}) > 10
