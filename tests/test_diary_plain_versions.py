"""Plain versions of the steps that depend on those before, each gone through as a list, against the operators on random cases."""

import math
import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from pathloom.functions.geo import RADIUS
from pathloom.operators import clean, compare, days, locate
from pathloom.params import Params
from pathloom.plans import tables

P = Params()


class Fix:
    def __init__(self, lat, lon, t, acc):
        self.lat, self.lon, self.t, self.acc = lat, lon, t, acc
        self.near = self.far = self.angle = None
        self.inter, self.why = False, None


def metres(a, b):
    p, q, d = math.radians(a.lat), math.radians(b.lat), math.radians(b.lon - a.lon)
    x, y = math.cos(q) * math.sin(d), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d)
    return RADIUS * math.atan2(math.hypot(x, y), math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(d))


def course(a, b):
    p, q, d = math.radians(a.lat), math.radians(b.lat), math.radians(b.lon - a.lon)
    return (math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) + 360) % 360


def look_around(trace, i):
    if not 0 < i < len(trace) - 1:
        return
    here = trace[i]
    same = lambda o: (o.lat, o.lon) == (here.lat, here.lon)
    back, ahead = i - 1, i + 1
    while same(trace[back]) and back > 0:
        back -= 1
    while same(trace[ahead]) and ahead < len(trace) - 1:
        ahead += 1
    here.near, here.far = metres(here, trace[back]), metres(here, trace[ahead])
    if here.near * here.far == 0:
        here.angle = 180
    else:
        turn = abs(course(here, trace[back]) - course(here, trace[ahead]))
        here.angle = min(turn, 360 - turn)
    if same(trace[i - 1]) and same(trace[i + 1]):
        here.inter = True


def plain_cleaning(points):
    trace = [Fix(*x) for x in points]
    whole = list(trace)
    for i in range(len(trace)):
        look_around(trace, i)

    def take(i, why):
        trace.pop(i).why = why
        look_around(trace, i - 1)
        look_around(trace, i)

    def take_all(test, why):
        for i in [i for i, x in enumerate(trace) if test(x)][::-1]:
            take(i, why)

    def worst():
        for i, x in enumerate(trace):
            if x.angle == 0:
                return i
        for i, x in enumerate(trace[1:-1], 1):
            if x.angle < 15 and min(x.near, x.far) > 100:
                return i
        return 0

    seen = set()
    take_all(lambda x: (x.lat, x.lon, x.t) in seen or seen.add((x.lat, x.lon, x.t)), "repeated")
    take_all(lambda x: x.acc > 100, "error")
    take_all(lambda x: x.inter, "sequence")
    while i := worst():
        take(i, "outlier")
    take_all(lambda x: x.inter, "sequence")
    return [x.why for x in whole]


def random_trace(rng):
    """Few places, so that runs, exact returns and stale marks are frequent."""
    places = [(43.65 + rng.choice((0, 0.001, 0.002, 0.0001)), -79.4 + rng.choice((0, 0.002, 0.004))) for _ in range(rng.randint(1, 5))]
    t, out = 0, []
    for _ in range(rng.randint(1, 40)):
        t += rng.choice((0, 0, 60, 60, 300))
        out.append((*(rng.choice(places) if rng.random() < 0.6 or not out else out[-1][:2]), t, rng.choice((5.0, 5.0, 20.0, 100.0, 150.0))))
    return out


def test_cleaning_is_as_the_plain_version():
    rng = random.Random(5)
    for _ in range(3000):
        trace = random_trace(rng)
        lat, lon, t, acc = map(list, zip(*trace, strict=True))
        assert clean.removals(lat, lon, t, acc, P) == plain_cleaning(trace), trace


def test_marks_of_one_step_wait_for_the_next():
    place, other = (43.65, -79.4), (43.66, -79.41)
    trace = [(*place, 0, 5.0), (*place, 60, 5.0), (*other, 120, 500.0), (*place, 180, 500.0)]
    assert clean.removals(*map(list, zip(*trace, strict=True)), P) == [None, None, "error", "error"]


def test_a_phone_at_rest_costs_no_square():
    import time

    n = 200_000
    lat = [43.65 + (0 if i < n // 2 else (i * 7919 % 1000) * 1e-5) for i in range(n)]
    lon = [-79.4 + (0 if i < n // 2 else (i * 104_729 % 1000) * 1e-5) for i in range(n)]
    began = time.time()
    why = clean.removals(lat, lon, list(range(n)), [500.0 if i % 3 == 0 else 5.0 for i in range(n)], P)
    assert time.time() - began < 60
    assert sum(w is None for w in why[: n // 2]) <= 2


def plain_matching(pairs, wanted):
    pairs, out = sorted(pairs), []
    for _ in range(wanted):
        if not pairs:
            break
        best = pairs.pop(0)
        out.append(best[0])
        for x in pairs:
            if x[1] == best[1] or x[2] == best[2]:
                pairs.remove(x)
    return out


def test_matching_is_as_the_plain_version():
    assert compare.match([(1.0, 1, 1), (2.0, 1, 2), (3.0, 2, 1), (9.0, 2, 2)], 2, "reference") == [1.0, 3.0]
    rng = random.Random(6)
    for _ in range(2000):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        pairs = [(float(rng.randint(1, 12)), a, b) for a in range(n) for b in range(m)]
        assert compare.match(pairs, min(n, m), "reference") == plain_matching(pairs, min(n, m))
        found = compare.match(pairs, min(n, m), "corrected")
        assert len(found) == min(n, m) and found == sorted(found)


def plain_slices(start, duration, zone):
    """Minutes on each date, by steps from one local midnight to the next."""
    out, now, end = [], start, start + duration
    day = datetime.fromtimestamp(start, zone).date()
    while True:
        after = datetime.combine(day + timedelta(days=1), datetime.min.time(), zone).timestamp()
        out.append((str(day), (min(after, end) - now) / 60))
        if end < after:
            return out
        now, day = after, day + timedelta(days=1)


def test_days_at_clock_changes(spark):
    zone = ZoneInfo(P.zone)
    midnight = lambda *d: datetime(*d, tzinfo=zone).timestamp()
    cases = [(midnight(2017, 11, 5), 25 * 3600.0), (midnight(2017, 11, 4) + 3600, 200_000.5), (midnight(2018, 3, 11), 23 * 3600.0), (midnight(2018, 3, 10) + 7200, 172_800.0), (midnight(2017, 6, 1), 86_400.0), (midnight(2017, 11, 5) + 4000.25, 7200.0)]
    rows = [("u", i, "home", a, d) for i, (a, d) in enumerate(cases)]
    q = spark.createDataFrame(rows, "user_id string, sequence int, type string, start double, duration double")
    for session_zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        try:
            got = {}
            for r in days.day_slices(q, P).orderBy("sequence", "date").collect():
                got.setdefault(r.sequence, []).append((str(r.date), r.minutes))
            text = [r[0] for r in q.orderBy("sequence").select(days.local_text(F.col("start"), P)).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        for i, (a, d) in enumerate(cases):
            want = plain_slices(a, d, zone)
            assert [x for x, _ in got[i]] == [x for x, _ in want]
            assert all(abs(x - y) < 1e-6 for (_, x), (_, y) in zip(got[i], want, strict=True))
            assert abs(sum(m for _, m in got[i]) * 60 - d) < 1e-6
            assert text[i] == str(datetime.fromtimestamp(a, zone))
    assert got[0] == [("2017-11-05", 1500.0), ("2017-11-06", 0.0)]
    assert got[2][0] == ("2018-03-11", 1380.0)


def test_density_of_many_points_is_near_the_exact_one(spark):
    rng = random.Random(7)
    rows = [("u", 0, float(i), i, 5.0, -79.4, 43.65, rng.gauss(0, 20) + rng.choice((0, 150)), rng.gauss(0, 20), False, 0, rng.random() * 60) for i in range(600)]
    rows = [(*r[:5], r[7] / 1e5, r[8] / 1e5, *r[7:]) for r in rows]
    q = spark.createDataFrame(rows, "user_id string, known_subset int, t double, ord long, acc double, lon double, lat double, x double, y double, synthetic boolean, j long, weight double")
    exact = {(r.x, r.y): r.kde for r in locate.kde(q, P).collect()}
    binned = {(r.x, r.y): r.kde for r in locate.kde(q, Params(kde_limit=500)).collect()}
    plain = lambda x, y: sum(r[-1] * math.exp(-((x - r[7]) ** 2 + (y - r[8]) ** 2) / 1250) for r in rows) / (sum(r[-1] for r in rows) * 2 * math.pi * 625)
    peak = 1 / (2 * math.pi * 625)
    assert exact.keys() == binned.keys() and len(exact) == 600
    assert all(abs(v - plain(*k)) < 1e-12 for k, v in exact.items())
    worst = max(abs(exact[k] - binned[k]) for k in exact)
    assert 0 < worst < peak / (4 * locate.BINS**2)


def test_peaks_are_as_the_plain_version(spark):
    rng = random.Random(8)
    rows = [(u, -79.4 + rng.randint(0, 60) * 1e-4, 43.65 + rng.randint(0, 60) * 1e-4, rng.randint(1, 40) / 1e6, 5e-6) for u in "uv" for _ in range(150)]
    rows = list({r[:3]: r for r in rows}.values())
    got = {(r.user_id, r.lon, r.lat) for r in locate.peaks(spark.createDataFrame(rows, "user_id string, lon double, lat double, kde double, threshold double"), P).collect()}
    high = [r for r in rows if r[3] >= r[4]]
    fix = lambda r: Fix(r[2], r[1], 0, 0)
    want = {r[:3] for r in high if not any(o[0] == r[0] and o[3] > r[3] and metres(fix(r), fix(o)) <= 100 for o in high)}
    assert got == want


@pytest.mark.parametrize("accuracy", [10.0, 30.0])
def test_a_stay_of_the_least_time_reaches_the_threshold(spark, accuracy):
    """One stay of minimum_activity seconds in a long trace: its simulated density peak lies near the threshold, and above half of it in 9 of 10 runs."""
    rng, total, above = random.Random(9), 86_400.0, 0
    limit = spark.range(1).select(locate.peak_threshold(F.lit(accuracy), F.lit(total), P)).first()[0]
    for _ in range(50):
        at = [(rng.gauss(0, accuracy), rng.gauss(0, accuracy)) for _ in range(60)]
        weight = P.minimum_activity / len(at)
        peak = max(sum(weight * math.exp(-((x - a) ** 2 + (y - b) ** 2) / 1250) for a, b in at) for x, y in at) / (total * 2 * math.pi * 625)
        above += peak > limit / 2
    assert above >= 45


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            tables.shared_folder(Elsewhere)
