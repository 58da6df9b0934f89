"""Every core query that has SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

from compare import same
from tidemark.plans import audits, audits_sql, dealt, dealt_sql, evaluation, evaluation_sql, market, market_sql, reference, reference_sql, repair, repair_sql, stores, stores_sql

CORE = {k: f for m in (dealt, reference, market, audits, repair, evaluation, stores) for k, f in m.QUERIES.items()}
SQL = {k: s for m in (dealt_sql, reference_sql, market_sql, audits_sql, repair_sql, evaluation_sql, stores_sql) for k, s in m.ORACLES.items()}


def test_no_name_twice():
    assert len(CORE) == sum(len(m.QUERIES) for m in (dealt, reference, market, audits, repair, evaluation, stores))
    assert set(SQL) <= set(CORE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    con, folder = duck
    same(CORE[name](spark, folder), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, duck, name):
    assert CORE[name](spark, duck[1]).limit(5).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).limit(3).collect()) == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
