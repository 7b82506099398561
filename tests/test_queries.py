"""Registered queries against their SQL in DuckDB on the smallest tables, and those without SQL for shape."""

from __future__ import annotations

import glob
import os

import pytest

from corvane.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else repr(x)
    if isinstance(x, list):
        return str([plain(y) for y in x])
    return None if x is None else str(x)


def rows(table, names):
    return sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toArrow()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.num_columns > 0
        return
    want = duck.sql(sql).to_arrow_table()
    names = sorted(got.schema.names)
    assert names == sorted(want.schema.names)
    assert rows(got, names) == rows(want, names)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
