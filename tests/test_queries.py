"""Every query with an SQL twin against DuckDB on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    return round(float(v), 9) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(str([plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns]) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() == 10
