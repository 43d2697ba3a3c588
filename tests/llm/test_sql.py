"""The queries that SQL can express, against DuckDB over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from quarrymill.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for n in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    df = queries.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())
