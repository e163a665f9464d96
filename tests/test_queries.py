"""Every core query runs, and equals its SQL where it has one."""

import pytest
from oracle import DATA, compare, connection

from quern.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
