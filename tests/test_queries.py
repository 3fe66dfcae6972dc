"""Every query of the core against its SQL, and the driver's contract."""

from __future__ import annotations

import pytest

from folioscale.plans import catalog
from tests.oracle import assert_same, connect

QUERIES, ORACLE = catalog.queries(), catalog.oracle()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, data, con):
    assert_same(QUERIES[name](spark, data).toPandas(), con.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(name, spark, data):
    assert QUERIES[name](spark, data).columns


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["direction", "core", "important", "backup", "total"]


def test_no_nested_loops_in_equality_plans(spark, data):
    for name in ("selected_entries", "blocked_match", "unmatched_report", "flatten_unique", "direction_summary"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
