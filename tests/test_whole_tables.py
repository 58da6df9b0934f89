"""Queries over all keys of their tables, against brute force; their SQL covers some of the keys."""

import bisect
import math
from collections import Counter
from datetime import datetime

from tidemark.plans import reference


def test_densified_snapshots_all_customers(spark, duck):
    con, folder = duck
    days = [d for d, in con.execute("select distinct cast(l_shipdate as date) from lineitem order by 1").fetchall()]
    snaps = {}
    for k, d, s in con.execute("select o_custkey, cast(o_orderdate as date), max(o_orderstatus) from orders group by 1, 2").fetchall():
        snaps.setdefault(k, []).append((d, s))
    want = set()
    for k, own in snaps.items():
        own.sort()
        for x in days:
            if at := bisect.bisect_right([d for d, _ in own], x):
                want.add((k, own[at - 1][1], str(x)))
    got = [(r.o_custkey, r.status, str(r.day)) for r in reference.QUERIES["densified_snapshots"](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want
    assert len({k for k, _, _ in got}) > 10


def test_matched_control_all_customers(spark, duck):
    con, folder = duck
    pool = con.execute("select c_custkey, c_nationkey, c_acctbal from customer where c_acctbal > 0").fetchall()
    want = set()
    for i, g, m in pool:
        apart = sorted((round(abs(math.log(m) - math.log(x)), 9), j) for j, h, x in pool if h == g and j != i and abs(math.log(m) - math.log(x)) <= math.log(2.0))
        want |= {(i, j, nth) for nth, (_, j) in enumerate(apart[:2], 1)}
    got = [tuple(r) for r in reference.QUERIES["matched_control_nearest"](spark, folder).select("signal", "control", "nth").collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(i % 10 for i, _, _ in got)


def test_matched_control_small_balances(spark, tmp_path):
    rows = [(1, 7, 0.5), (2, 7, 0.75), (3, 7, 0.0), (4, 7, -2.0), (5, 8, 0.5), (6, 7, 1.25)]
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {tuple(r) for r in reference.QUERIES["matched_control_nearest"](spark, str(tmp_path)).select("signal", "control", "nth").collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (2, 6, 2), (6, 2, 1)}


def test_full_outer_reconcile_whole_keys(spark, duck):
    con, folder = duck
    events = Counter((k, str(d)) for k, d in con.execute("select user_id, cast(ts as date) from events").fetchall())
    orders = Counter((k, str(d)) for k, d in con.execute("select o_custkey, cast(o_orderdate as date) from orders").fetchall())
    kind = lambda x: "right_only" if x not in events else "left_only" if x not in orders else "both"
    want = sorted((*x, events[x], orders[x], kind(x)) for x in set(events) | set(orders))
    got = reference.QUERIES["full_outer_reconcile"](spark, folder).collect()
    assert sorted((r.k, str(r.d), r.events, r.orders, r.kind) for r in got) == want


def test_full_outer_reconcile_sides(spark, tmp_path):
    at = lambda d: datetime(2020, 1, d, 12)
    spark.createDataFrame([(1, at(1)), (1, at(1)), (51, at(1)), (2, at(2))], "user_id bigint, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    orders = [(1, at(1), "F"), (61, at(1), "P"), (2, at(3), "O")]
    spark.createDataFrame(orders, "o_custkey bigint, o_orderdate timestamp, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in reference.QUERIES["full_outer_reconcile"](spark, str(tmp_path)).select("k", "d", "events", "orders", "kind").collect()}
    day = lambda d: f"2020-01-0{d}"
    assert got == {(1, day(1), 2, 1, "both"), (51, day(1), 1, 0, "left_only"), (2, day(2), 1, 0, "left_only"), (61, day(1), 0, 1, "right_only"), (2, day(3), 0, 1, "right_only")}
