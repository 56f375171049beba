"""The operators' queries equal their SQL in DuckDB on the same tables."""

import os
from glob import glob

import duckdb
import pytest

from pointspark.llm import queries, sql

QUERIES, SQL = queries.queries(), sql.oracle_sql()


def comparable(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, sf, name):
    duck = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert comparable(got) == comparable(want)
    assert {c: got[c].dtype.kind for c in got} == {c: want[c].dtype.kind for c in got}
