"""Kernels against plain versions, sources on invented files, and the known oddities."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators import clean, compare, days, decode, segment
from pathloom.operators import episodes as ep
from pathloom.params import Params
from pathloom.plans.diary import diary, write_files
from pathloom.sources import readers

P = Params()
POINT = "user_id string, t bigint, ord bigint, acc double, lon double, lat double"


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5), st.integers(2, 3), st.integers(0, 999))
def test_viterbi_is_the_best_path(n, s, seed):
    rng = np.random.default_rng(seed)
    emit, start, move = rng.integers(-3, 1, (n, s)).astype(float), decode.start_probabilities(s), decode.transition_matrix(s)
    score = lambda q: start[q[0]] + emit[0, q[0]] + sum(move[a, b] + emit[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(q)))
    assert np.isclose(score(decode.viterbi(emit, start, move)), max(score(q) for q in itertools.product(range(s), repeat=n)))


def test_viterbi_ties_go_to_the_highest_state():
    assert decode.viterbi(np.zeros((3, 3)), np.zeros(3), np.zeros((3, 3))).tolist() == [2, 2, 2]


def test_collapse_between_unlike_neighbours_moves_the_next_start_later():
    assert ep.collapse([0, 1000, 1100, 5000], ["travel", "home", "work", "unknown"], P) == ([0, 2, 3], [0, 1000, 1150.0, 5000])
    assert ep.collapse([0, 1000, 1100, 5000], ["travel", "home", "work", "unknown"], Params(semantics="corrected"))[1][2] == 1050.0


def test_collapse_between_like_neighbours_and_at_the_start():
    assert ep.collapse([0, 1000, 1100, 5000], ["travel", "home", "travel", "unknown"], P)[0] == [0, 3]
    assert ep.collapse([0, 100, 5000], ["home", "travel", "unknown"], P)[0] == [1, 2]


def test_matching_skips_in_reference_semantics_only():
    pairs = [(1.0, 1, 1), (2.0, 1, 2), (3.0, 2, 1), (9.0, 2, 2)]
    assert compare.match(pairs, 2, "corrected") == [1.0, 9.0]
    assert compare.match(pairs, 2, "reference") == [1.0, 3.0]


def test_spike_and_exact_return_are_outliers():
    lat = [43.65, 43.65, 43.66, 43.65, 43.65]
    lon = [-79.40, -79.401, -79.401, -79.401, -79.402]
    assert clean.Chain(lat, lon, P).outlier() == 2


def test_projection_constants_and_roundtrip(spark):
    q = spark.createDataFrame([(-79.4, 43.65), (-123.1, 49.2)], "lon double, lat double")
    x, y = geo.project(F.col("lon"), F.col("lat"))
    q = q.withColumns({"x": x, "y": y})
    lon, lat = geo.unproject(F.col("x"), F.col("y"))
    rows = q.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert (round(rows[0].x, 3), round(rows[0].y, 3)) == (7223526.949, 928071.382)
    assert all(abs(r.lon - r.lon2) < 1e-11 and abs(r.lat - r.lat2) < 1e-11 for r in rows)


def two_places(n=140):
    """Stays at one place, walks to another and stays there."""
    rows = []
    for i in range(n):
        f = min(1.0, max(0.0, (i - 60) / 20))
        rows.append(("u", 1_500_000_000 + 60 * i, i, 10.0, -79.40 + 0.01 * f + (i % 3) * 1e-6, 43.65 + (i % 2) * 1e-6))
    return rows


def test_diary_finds_one_trip(spark, tmp_path):
    places = spark.createDataFrame([("u", "home", -79.40, 43.65), ("u", "work", -79.39, 43.65)], "user_id string, name string, lon double, lat double")
    out = diary(spark.createDataFrame(two_places(), POINT), places, P)
    assert [r.type for r in out["episodes"].orderBy("sequence").collect()] == ["home", "travel", "work", "unknown"]
    day = out["days"].collect()
    assert sum(r.trip_count for r in day) == 1
    episodes = out["episodes"].agg(F.sum("duration")).first()[0]
    assert abs(sum(r.total_time for r in day) * 60 - episodes) < 1e-6
    n = out["points"].where("not interpolated").count()
    assert n == 140
    write_files(out, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/days", header=True).columns[:5] == ["user_id", "date", "DoW", "total_time", "total_count"]


def test_diary_without_places_or_points(spark):
    none = spark.createDataFrame([], "user_id string, name string, lon double, lat double")
    out = diary(spark.createDataFrame(two_places(), POINT), none, P)
    assert {r.description for r in out["locations"].collect()} == {""}
    bad = spark.createDataFrame([(*r[:3], 500.0, *r[4:]) for r in two_places()], POINT)
    assert diary(bad, none, P)["episodes"].count() == 0
    assert diary(spark.createDataFrame([], POINT), none, P)["days"].count() == 0


def test_weights_are_the_eligible_time(spark):
    q = segment.time_weights(segment.with_plane(spark.createDataFrame(two_places(), POINT).withColumn("known_subset", F.lit(0))), P)
    assert q.agg(F.sum("weight")).first()[0] == 60.0 * 139


def test_subway_exempts_a_gap(spark):
    rows = [("u", 60 * i, i, 5.0, -79.40 + (0.02 if i > 2 else 0), 43.65) for i in range(6)]
    stations = spark.createDataFrame([(-79.40, 43.651), (-79.38, 43.651)], "lon double, lat double")
    q = spark.createDataFrame(rows, POINT)
    assert segment.gap_segments(q, P).agg(F.max("segment")).first()[0] == 1
    assert segment.gap_segments(q, P, stations).agg(F.max("segment")).first()[0] == 0


def test_midnight_and_clock_change(spark):
    q = spark.createDataFrame([("u", 0, "home", 1509854400.0 - 3600, 3600.0), ("u", 1, "work", 1509854400.0, 90_000.0)], "user_id string, sequence int, type string, start double, duration double")
    rows = days.day_slices(q, P).orderBy("sequence", "date").collect()
    assert [r.minutes for r in rows][:2] == [60.0, 0.0]
    assert str(rows[1].date) == "2017-11-05"


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("extra,uuid,timestamp_epoch,h_accuracy,longitude,latitude\nx,a,10,5.5,-79.4,43.6\n")
    assert readers.coordinates(spark, str(tmp_path / "c.csv")).collect()[0][:2] == ("a", 10)
    (tmp_path / "s.csv").write_text("uuid,location_home_lon,location_home_lat,location_work_lon,location_work_lat\na,1,2,,\na,-79,43,-80,44\nb,,,5,6\n")
    got = {(r.user_id, r.name): (r.lon, r.lat) for r in readers.survey(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {("a", "home"): (-79.0, 43.0), ("a", "work"): (-80.0, 44.0), ("b", "work"): (5.0, 6.0)}
    node = '<node id="{}" lat="43.65" lon="-79.4"><tag k="railway" v="station"/><tag k="station" v="{}"/></node>'
    (tmp_path / "o.xml").write_text(f"<osm>{node.format(1, 'subway')}{node.format(2, 'train')}<way id='3'></way></osm>")
    assert [tuple(r) for r in readers.stations(spark, str(tmp_path / "o.xml")).collect()] == [(-79.4, 43.65)]
    (tmp_path / "e.csv").write_text("user_id,sequence,location_id,mode,unknown,local_start_time,unix_start_time\nu,0,,walk,True,x,5\nu,1,2,,,y,9.5\n")
    assert [(r.location_id, r.unknown, r.start) for r in readers.episodes(spark, str(tmp_path / "e.csv")).orderBy("sequence").collect()] == [(None, True, 5.0), (2, False, 9.5)]


def test_truth_against_itself(spark):
    q = spark.createDataFrame([("u", 0, None, True, 0.0), ("u", 1, 1, False, 100.0), ("u", 2, None, False, 300.0), ("u", 3, None, True, 400.0)], "user_id string, sequence int, location_id int, unknown boolean, start double")
    r = compare.ratios(q, q).first()
    assert (r.identified_unknown, r.identified_travel, r.identified_location, r.misidentified_location) == (1.0, 1.0, 1.0, 0.0)
    s = compare.strings(q, q).first()
    assert s.true_eps == "UAT" and s.comp_eps == "UA"
