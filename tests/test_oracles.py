"""Every diary query that SQL can express, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from pathloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if math.isnan(v) else float(v) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SELECT))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, str(DATA))
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    k = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in k) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(v) for v in r) for r in want.select(*k).fetchall()), key=repr)
    assert a == b


def test_every_query_has_sql():
    assert set(catalogue.NAMES) == set(catalogue.SELECT)
