"""The general data operators against plain Python on small and odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.asknown import as_known
from tidemark.operators.counting import counting
from tidemark.operators.diff import blocks, differences, field_differences
from tidemark.operators.grid import regular_grid
from tidemark.operators.history import versions
from tidemark.operators.rolling import trailing_periods

# counting --------------------------------------------------------------------------------------------------------


def test_counting(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 2, 20), (None, 5, 1), (None, None, 2), ("b", None, 3)], "k string, at int, v int")
    got = {(r.k, r.v) for r in counting(df, ["k"], "at", {"v": F.col("v")}).collect()}
    assert got == {("a", 20), (None, 1), ("b", 3)}
    assert counting(df.limit(0), ["k"], "at", {"v": F.col("v")}).collect() == []


# history ---------------------------------------------------------------------------------------------------------

SNAPSHOTS = "k string, t int, name string, flag boolean, extra string"


def brute_versions(rows):
    out = []
    for k in {r[0] for r in rows}:
        known, first = {}, True
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            new = {i: r[i] for i in (2, 3) if r[i] is not None and r[i] != known.get(i)}
            if first or new:
                known |= new
                out.append((k, r[1], known.get(2), known.get(3)))
            first = False
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_versions(spark, seed, chunk):
    rng = random.Random(seed)
    rows = [(k, t, rng.choice(["x", "y", None]), rng.choice([True, False, None, None]), "z") for k in ("a", "b", None) for t in range(-20, 60) if rng.random() < 0.6]
    got = versions(spark.createDataFrame(rows, SNAPSHOTS), "k", "t", ["name", "flag"], chunk).collect()
    assert sorted(((r.k, r.valid_from, r.name, r.flag) for r in got), key=repr) == brute_versions(rows)
    for k in ("a", "b", None):
        own = sorted((r for r in got if r.k == k), key=lambda r: r.valid_from)
        assert [r.valid_to for r in own] == [r.valid_from - 1 for r in own[1:]] + [None]


def test_versions_odd(spark):
    df = spark.createDataFrame([("a", 1, None, None, None), ("a", 2, "long" * 5000, None, None), ("a", None, "q", True, None)], SNAPSHOTS)
    got = sorted((r.valid_from, r.name, r.flag) for r in versions(df, "k", "t", ["name", "flag"]).collect())
    assert got == [(1, None, None), (2, "long" * 5000, None)]
    assert versions(df.limit(0), "k", "t", ["name", "flag"]).collect() == []


# rolling ---------------------------------------------------------------------------------------------------------


def test_trailing(spark):
    rng = random.Random(3)
    open_days = [d for d in range(100) if d % 7 < 5]
    totals = {(e, d): float(rng.randrange(1, 1000)) for e in ("a", "b") for d in range(100) if rng.random() < 0.4 and (e == "a" or 10 <= d <= 80)}
    t = spark.createDataFrame([(e, d, v, "x") for (e, d), v in totals.items()] + [("c", 50, None, "x")], "e string, d int, v double, day string")
    ents = spark.createDataFrame([("a", 0, 99), ("b", 10, 80), ("c", 50, 52)], "e string, first int, last int")
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(open_days)], "d int, ordinal int")
    got = {(r.e, r.d): r for r in trailing_periods(t, ents, cal, "e", "d", "v").collect()}
    at = lambda e, d: totals.get((e, d), 0.0)
    for (e, d), r in got.items():
        assert r.sum_7d == sum(at(e, x) for x in range(d - 6, d + 1))
        assert r.mean_30d == pytest.approx(sum(at(e, x) for x in range(d - 29, d + 1)) / 30)
        if d in open_days:
            before = [at(e, x) for x in open_days if x < d][-20:]
            assert r.prior_median_20 == np.median([0.0] * (20 - len(before)) + before)
        else:
            assert r.prior_median_20 is None
    assert {d for e, d in got if e == "b"} >= {d for d in open_days if 10 <= d <= 80}
    assert got["c", 50].sum_7d == 0
    assert trailing_periods(t.limit(0), ents.limit(0), cal, "e", "d", "v").collect() == []


# as known --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("period", [1, 5, 400])
def test_as_known(spark, period):
    rng = random.Random(period)
    facts = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-30, 60)]), rng.randrange(6), i) for i in range(200)]
    events = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-40, 90)])) for i in range(150)]
    events += events[:3]
    f = spark.createDataFrame(facts, "k string, known_from int, report int, id int")
    e = spark.createDataFrame(events, "id int, k string, at int")
    got = as_known(e, f, "k", "at", "known_from", F.struct("report", "known_from", "id"), period).collect()

    def best(k, at):
        held = [(r, d, i) for kk, d, r, i in facts if kk is not None and kk == k and d is not None and at is not None and d <= at]
        return max(held, default=None)

    assert len(got) == len(events)
    for r in got:
        assert (r.known and tuple(r.known)) == best(r.k, r.at)
    assert as_known(e.limit(0), f, "k", "at", "known_from", F.struct("report")).collect() == []
    assert all(r.known is None for r in as_known(e, f.limit(0), "k", "at", "known_from", F.struct("report")).collect())


# grid ------------------------------------------------------------------------------------------------------------


def grid(df):
    return regular_grid(df, "s", "d", F.col("slot"), F.col("ms"), F.col("v"), 12, rank=2, iterations=4)


def test_grid(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(40, 2)), rng.normal(size=(12, 2)) * 0.02
    truth = 10 * np.exp(u @ v.T)
    rows, held = [], {}
    for i in range(40):
        for s in range(12):
            if rng.random() < 0.75 or s == 0:
                rows.append((f"s{i}", 1, s, s * 10, float(truth[i, s]), "x"))
            else:
                held[f"s{i}", s] = truth[i, s]
    rows += [("s0", 1, 0, -5, 99.0, "x"), ("empty", 1, None, None, None, "x"), ("one", 2, 3, 1, 5.0, "x"), (None, 1, 0, 0, 1.0, "x"), ("s0", None, 0, 0, 1.0, "x"), rows[0]]
    got = {(r.s, r.d, r.slot): r for r in grid(spark.createDataFrame(rows, "s string, d int, slot int, ms int, v double, cells string")).collect()}
    assert len(got) == 42 * 12
    for s, d, slot, ms, v, _ in rows[:-6]:
        assert got[s, d, slot].status == "observed" and got[s, d, slot].value == v
    off = [abs(math.log(got[s, 1, slot].value / x)) for (s, slot), x in held.items()]
    flat = [abs(math.log(np.exp(np.mean([math.log(got[s, 1, j].value) for j in range(12) if got[s, 1, j].status == "observed"])) / x)) for (s, slot), x in held.items()]
    assert all(got[s, 1, slot].status == "filled" for s, slot in held)
    assert np.mean(off) < 0.5 * np.mean(flat)
    assert all(got["empty", 1, j].status == "unsupported" and got["empty", 1, j].value is None for j in range(12))
    assert got["one", 2, 3].status == "observed" and got["one", 2, 4].status == "unsupported"


def test_grid_empty(spark):
    assert grid(spark.createDataFrame([], "s string, d int, slot int, ms int, v double")).collect() == []


# diff ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [1, 8])
def test_differences(spark, buckets):
    rng = random.Random(buckets)
    keys = [(k, d) for k in ("a", "b", None) for d in [None, *range(60)]]
    left = {k: (rng.choice([True, False, None]), rng.choice(["x", "y", None])) for k in keys if rng.random() < 0.8}
    right = {k: (rng.choice([True, False, None]), rng.choice(["x", "y", None])) for k in keys if rng.random() < 0.8}
    frame = lambda m: spark.createDataFrame([(*k, *v, "e") for k, v in m.items()], "k string, d int, p boolean, q string, bucket string")
    found = differences(frame(left), frame(right), ["k", "d"], ["p", "q"], buckets)
    got = {(r.k, r.d, r.field_name) for r in field_differences(found, ["k", "d"], ["p", "q"], "no left", "no right").collect()}
    want = {(*k, "no right") for k in left.keys() - right.keys()} | {(*k, "no left") for k in right.keys() - left.keys()}
    want |= {(*k, n) for k in left.keys() & right.keys() for i, n in enumerate("pq") if left[k][i] != right[k][i]}
    assert got == want
    words = blocks(frame(left), frame(right), ["k", "d"], ["p", "q"], buckets).collect()
    assert sum(bin(w.in_left % 2**64).count("1") for w in words) == len(left) and sum(bin(w.in_right % 2**64).count("1") for w in words) == len(right)


def test_differences_empty(spark):
    df = spark.createDataFrame([("a", 1, True, "x")], "k string, d int, p boolean, q string")
    assert differences(df.limit(0), df.limit(0), ["k", "d"], ["p", "q"]).collect() == []
    assert [r.kind for r in differences(df, df.limit(0), ["k", "d"], ["p", "q"]).collect()] == ["right_missing"]
