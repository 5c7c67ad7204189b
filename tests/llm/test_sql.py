"""Corpus queries that SQL can express against DuckDB on the smallest tables."""

import duckdb
import pytest

from attestor.llm.queries import QUERIES, SQL
from tests.test_queries import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
