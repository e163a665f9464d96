"""Holds a query's rows against the rows of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")


def connection(folder: str = DATA):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{folder}/{name}'")
    return con


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return repr(value)
    if isinstance(value, float):
        return repr(float(int(value))) if math.isfinite(value) and value == int(value) else repr(value)
    if isinstance(value, int):
        return repr(float(value))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted(tuple(canonical(row[columns.index(c)]) for c in order) for row in rows)


def compare(spark, con, run, sql: str, folder: str = DATA) -> None:
    found = run(spark, folder)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert got == rows_of(columns, result.fetchall())
