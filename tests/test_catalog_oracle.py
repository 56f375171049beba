"""Every query with SQL equals DuckDB on the same tables."""

import os
from glob import glob

import duckdb
import pytest

import __spark_entry__ as entry
from pointspark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
    assert {c: got[c].dtype.kind for c in got} == {c: want[c].dtype.kind for c in got}


def test_entry(spark):
    assert entry.entry(spark).count() == 40


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
