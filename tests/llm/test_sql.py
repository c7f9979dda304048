"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from skywindow.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    b = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in want.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == b
