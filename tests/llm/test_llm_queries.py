"""The queries of the subpackage on the smallest tables; those with SQL equal it."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import DATA, compare, connection  # noqa: E402

from quern.llm import queries  # noqa: E402

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(spark, connection(), QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_are_distinct(spark, name):
    rows = QUERIES[name](spark, DATA)
    found = rows.collect()
    if name.endswith("_found"):
        assert len(found) == len(set(map(tuple, found)))
