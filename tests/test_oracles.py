"""Every query with SQL against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from monthloom.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    at = [rel.columns.index(c) for c in cols]
    want = sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=str)
    assert got == want


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "mae" in df.columns


def test_registered_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
