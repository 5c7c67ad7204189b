"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from attestor.queries import QUERIES
from attestor.queries_sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}'")
    return con


def rows(df):
    cell = lambda x: "" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, int | float) or hasattr(x, "dtype") else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
