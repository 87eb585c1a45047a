"""Every core query with SQL equals it on the smallest data; all others run."""

from __future__ import annotations

import pytest
from oracle import SMALL, compare, connect

from engramlake.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    compare(spark, con, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, con, name):
    assert QUERIES[name](spark, SMALL).columns
    QUERIES[name](spark, SMALL).collect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
