"""The queries that SQL can express, against DuckDB on the same documents."""

import duckdb
import pytest

from pathloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{DATA}/documents.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.select(*names).fetchall())
