"""Means that are halves at the last decimal kept: the same rows however the input is split, and those of SQL that reads it in order."""

import duckdb

from pathloom.plans import catalogue

COPIES = "(select event_id + i * 100000 as event_id, ts, user_id + i * 1500 as user_id, event_type, value, props from range(4) x(i), '/root/testdata/sf0.1/events.parquet' order by i, event_id)"


def test_split_input_has_the_means_of_sql(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute("set timezone='UTC'; set threads=1")
    (tmp_path / "events.parquet").mkdir()
    duck.execute(f"create table events as from {COPIES}")
    for part in range(3):
        duck.execute(f"copy (from events where event_id % 3 = {part} order by event_id) to '{tmp_path}/events.parquet/{2 - part}.parquet' (format parquet)")
    sql = catalogue.oracle_sql()["location_distance_matrix"]
    means = sql[: sql.rindex("select user_id, a.location_id")] + "select user_id, location_id, lon, lat from comp"
    got = {tuple(r) for r in catalogue.computed_places(spark, str(tmp_path)).select("user_id", "location_id", "lon", "lat").collect()}
    assert got == set(duck.execute(means).fetchall())
    assert {tuple(r) for r in catalogue.location_distance_matrix(spark, str(tmp_path)).collect()} == set(duck.execute(sql).fetchall())
