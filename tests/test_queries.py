"""Every registered query against DuckDB on the smallest tables, and the entry point."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from __spark_entry__ import QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_equals_sql(spark, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr) == got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
