"""Queries of the subpackage on the smallest tables, against SQL where there is some."""

import pytest
from compare import same

from tidemark.llm.encode import VOCABULARY, encoding
from tidemark.llm.queries import CAPACITY, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    con, folder = duck
    same(QUERIES[name](spark, folder), con, ORACLES[name])


def test_ids(spark, duck):
    con, folder = duck
    enc = encoding(VOCABULARY)
    want = {k: enc.encode_ordinary(t) if t else [] for k, t in con.execute("select doc_id, text from documents").fetchall()}
    assert {r.doc_id: list(r.ids) for r in QUERIES["p8_ids"](spark, folder).collect()} == want


def test_containers(spark, duck):
    con, folder = duck
    rows = QUERIES["p9_containers"](spark, folder).collect()
    full = {}
    for r in rows:
        full[r.container] = full.get(r.container, 0) + r["size"]
    assert max(full.values()) <= CAPACITY
    assert {r.doc_id for r in rows} == {k for k, in con.execute("select doc_id from documents").fetchall()}


def test_containers_are_full(duck, spark):
    con, folder = duck
    enc = encoding(VOCABULARY)
    need = sum(len(enc.encode_ordinary(t)) for t, in con.execute("select text from documents where text is not null").fetchall())
    full = {}
    for r in QUERIES["p9_containers"](spark, folder).collect():
        full.setdefault(r.container, []).append((r.offset, r.offset + r["size"]))
    for places in full.values():  # no two items overlap
        taken = sorted(p for p in places if p[0] < p[1])
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
    used = [sum(b - a for a, b in p) for p in full.values()]
    assert sum(used) == need
    assert len(full) <= -(-need // CAPACITY) + 1  # no more than one container above the least possible number


def test_best(spark, duck):
    rows = QUERIES["p4_best"](spark, duck[1]).collect()
    found = {(r.source_report_key, r.field_name): r.record_id for r in QUERIES["p4_found"](spark, duck[1]).collect()}
    assert {(r.source_report_key, r.field_name) for r in rows} == set(found)
    assert all(1 <= r.votes <= r.known <= r.deliveries and r.deliveries > 1 for r in rows)
    alone = [r for r in rows if r.known == r.votes]
    assert alone and all(found[r.source_report_key, r.field_name] == r.record_id for r in alone)  # without a contradiction, vote and order agree


def test_found_and_rates(spark, duck):
    found = {r.doc_id for r in QUERIES["p10_found"](spark, duck[1]).collect()}
    by = {r.source: r for r in QUERIES["p10_rates"](spark, duck[1]).collect()}
    assert found and sum(r.cut for r in by.values()) == len(found)
    assert sum(r.texts for r in by.values()) == duck[0].execute("select count(*) from documents").fetchone()[0]
