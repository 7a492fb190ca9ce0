"""Every query with SQL against DuckDB on the same tables; of the others it is only seen that they run; some have tests of their own."""

from __future__ import annotations

import pytest

from seatrace.plans import registry

from .oracle import SF, connection, difference

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert not difference(registry.queries()[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() > 0
