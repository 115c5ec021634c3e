"""The diary operators as queries over the driver's tables, and SQL that gives the same rows. Floating results are rounded in both."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import clean, compare, days, decode, locate, segment
from ..operators import episodes as ep
from ..params import Params
from ..sources import readers
from ..sources.readers import gps_from_events
from .diary import diary, file_table, stage_counts
from .sql_geometry import RHO, THETA, course_sql, metres_sql
from .stepwise_sql import CLEANING, DIARY, collapse_sql, matching_sql, near_station, viterbi_sql
from .tables import shared_folder, written

P = Params()
#: Invented stations, some of them at the ends of long steps.
STATIONS = [(-79.400, 43.651), (-79.384, 43.651), (-79.376, 43.651), (-79.388, 43.654), (-79.380, 43.6575)]
#: Made more selective than the defaults, which all derived segments pass.
SEGMENTS = Params(segment_points=80, segment_seconds=80_000.0)
STAYS = Params(minimum_activity=4000.0)


def gps(spark: SparkSession, d: str) -> DataFrame:
    return gps_from_events(spark.read.parquet(f"{d}/events.parquet"))


def good(spark: SparkSession, d: str) -> DataFrame:
    return clean.known_error(gps(spark, d), P)


def r(c, n: int = 3):
    return F.round(c, n)


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATIONS, "lon double, lat double")


def plane(spark, d) -> DataFrame:
    """One segment a user, on the projected plane."""
    return segment.with_plane(clean.exact_duplicates(good(spark, d)).withColumn("known_subset", F.lit(0)))


def weighted(spark, d) -> DataFrame:
    return segment.time_weights(plane(spark, d), P)


def real_places(users: DataFrame, names: int = 4) -> DataFrame:
    """The places that traces are made around: (user_id, location_id, lon, lat)."""
    each = users.select("user_id").distinct().withColumn("location_id", F.explode(F.sequence(F.lit(1), F.lit(names))))
    return each.select("user_id", "location_id", (-79.40 + 0.008 * (F.col("location_id") - 1)).alias("lon"), (43.65 + 0.001 * (F.col("user_id") % 10)).alias("lat"))


def named_places(users: DataFrame) -> DataFrame:
    return real_places(users, 3).select("user_id", F.element_at(F.array(*map(F.lit, locate.NAMES)), F.col("location_id")).alias("name"), "lon", "lat")


def simple_states(spark, d, half: bool = False) -> DataFrame:
    """Points with a state from the distance to the nearest real place: its number within 100 m, else travel."""
    q = plane(spark, d)
    q = q.where("ord % 2 = 0") if half else q
    places = real_places(q)
    m = geo.great_circle(F.col("p.lat"), F.col("p.lon"), F.col("c.lat"), F.col("c.lon"))
    near = q.alias("p").join(places.alias("c"), "user_id").groupBy("user_id", "ord").agg(F.min(F.struct(r(m).alias("m"), "location_id")).alias("b"))
    return q.join(near, ["user_id", "ord"]).withColumn("state", F.when(F.col("b.m") <= 100, F.col("b.location_id")).otherwise(0)).drop("b")


def names_of(users: DataFrame) -> DataFrame:
    return real_places(users, 3).select("user_id", "location_id", F.array(F.element_at(F.array(*map(F.lit, locate.NAMES)), F.col("location_id"))).alias("names"))


def simple_episodes(spark, d, half: bool = False) -> DataFrame:
    q = simple_states(spark, d, half)
    return ep.with_durations(ep.with_types(ep.state_changes(q), names_of(q)))


def density(spark, d) -> DataFrame:
    return locate.kde(weighted(spark, d), P)


def limits(spark, d) -> DataFrame:
    total = weighted(spark, d).groupBy("user_id").agg(F.sum("weight").alias("total"))
    return locate.rms_accuracy(plane(spark, d)).join(total, "user_id").withColumn("threshold", locate.peak_threshold(F.col("rms"), F.col("total"), STAYS))


def scan_gps(s, d):
    return gps(s, d)


def min_points_gate(s, d):
    return clean.min_points_gate(gps(s, d), Params(min_points=330)).groupBy("user_id").agg(F.count("*").alias("n"))


def known_error_filter(s, d):
    return good(s, d).select("user_id", "ord", "acc")


def exact_dedup(s, d):
    q = gps(s, d).drop("place")
    again = q.where("ord % 10 = 0").withColumn("ord", F.col("ord") + 1_000_000_000)
    return clean.exact_duplicates(q.unionByName(again)).select("user_id", "t", "ord", "lon", "lat")


def distinct_geometry(s, d):
    return clean.distinct_geometries(good(s, d)).select("user_id", "t", "ord", "lon", "lat")


def duplicate_locations(s, d):
    return clean.repeated_geometries(good(s, d))


def user_allow_split(s, d):
    allowed, others = clean.split_users(gps(s, d), s.range(0, 1_000_000, 3).withColumnRenamed("id", "user_id"))
    count = lambda q, side: q.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.sum("ord").alias("ords"))
    return count(allowed, "allowed").unionByName(count(others, "others"))


def neighbor_distance_angle(s, d):
    return clean.neighbours(good(s, d)).select("user_id", "ord", r("d_ante").alias("d_ante"), r("d_post").alias("d_post"), r("angle", 2).alias("angle"), "inter")


def sequential_dup_filter(s, d):
    return clean.sequential_duplicates(good(s, d)).select("user_id", "ord")


def positional_outlier_candidates(s, d):
    return clean.outlier_candidates(good(s, d), P).select("user_id", "ord", r("angle", 2).alias("angle"))


def positional_outlier_loop(s, d):
    return clean.clean_users(gps(s, d).drop("place"), P).select("user_id", "ord", F.coalesce("removed_by", F.lit("kept")).alias("step"))


def near_subway(s, d):
    return segment.near_subway(good(s, d), stations(s), P).where("near_subway").select("user_id", "ord")


def gap_segments(s, d):
    return segment.gap_segments(good(s, d), P, stations(s)).select("user_id", "ord", F.col("segment").cast("bigint").alias("segment"))


def segment_stats(s, d):
    return segment.segment_stats(segment.gap_segments(good(s, d), P, stations(s))).select("user_id", F.col("segment").cast("bigint").alias("segment"), "n_points", "seconds")


def known_segments(s, d):
    q = segment.known_segments(segment.gap_segments(good(s, d), P, stations(s)), SEGMENTS).where("known_subset is not null")
    return q.groupBy("user_id", F.col("known_subset").cast("bigint").alias("known_subset")).agg(F.count("*").alias("n_points"))


def project_lcc(s, d):
    return plane(s, d).select("user_id", "ord", r("x").alias("x"), r("y").alias("y"))


def unproject_lcc_roundtrip(s, d):
    lon, lat = geo.unproject(F.col("x"), F.col("y"))
    return plane(s, d).select("user_id", "ord", r(lon, 9).alias("lon"), r(lat, 9).alias("lat"))


def spatial_interpolation(s, d):
    return segment.spatial_points(plane(s, d), P).select("user_id", "ord", r("t").alias("t"), r("acc", 6).alias("acc"), r("x").alias("x"), r("y").alias("y"))


def temporal_interpolation(s, d):
    return segment.temporal_points(plane(s, d), P).select("user_id", "ord", r("t").alias("t"), r("acc", 6).alias("acc"), r("x").alias("x"), r("y").alias("y"))


def time_weights(s, d):
    return weighted(s, d).select("user_id", "ord", "weight")


def rms_accuracy(s, d):
    return locate.rms_accuracy(good(s, d)).select("user_id", r("rms", 6).alias("rms"))


def peak_threshold(s, d):
    return limits(s, d).select("user_id", "total", r(F.col("threshold") * 1e9).alias("threshold"))


def kde_density(s, d):
    return density(s, d).select("user_id", "lon", "lat", r(F.col("kde") * 1e9, 2).alias("kde"))


def density_peaks(s, d):
    return locate.peaks(density(s, d).join(limits(s, d), "user_id"), P).select("user_id", "lon", "lat")


def nearest_named_place(s, d):
    q = good(s, d)
    found = clean.distinct_geometries(q).withColumn("location_id", F.col("ord"))
    return locate.nearest_named(named_places(q), found, P).select("user_id", "name", "location_id", r("metres").alias("metres"))


def emission_probs(s, d):
    q = decode.travel_emission(plane(s, d))
    c = real_places(q).alias("c")
    m = geo.great_circle(F.col("p.lat"), F.col("p.lon"), F.col("c.lat"), F.col("c.lon"))
    return q.alias("p").join(c, "user_id").select("user_id", "ord", F.col("c.location_id").cast("bigint").alias("location_id"), r("travel_emit", 6).alias("travel_emit"), r(decode.location_emission(m, P)).alias("place_emit"))


def transition_matrix(s, d):
    q = s.range(5).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("b"))
    return q.select("a", "b", r(decode.transition(F.col("a"), F.col("b"), F.lit(5.0)), 9).alias("logp"))


def viterbi_states(s, d):
    q = decode.travel_emission(plane(s, d))
    return decode.states(q, real_places(q), P).select("user_id", "ord", F.col("state").cast("bigint").alias("state"))


def state_changes_episodes(s, d):
    return simple_episodes(s, d).select("user_id", F.col("sequence").cast("bigint").alias("sequence"), r("start").alias("start"), F.col("location_id").cast("bigint").alias("location_id"), "unknown")


def episode_types(s, d):
    return simple_episodes(s, d).select("user_id", F.col("sequence").cast("bigint").alias("sequence"), "type")


def episode_durations(s, d):
    return simple_episodes(s, d).select("user_id", F.col("sequence").cast("bigint").alias("sequence"), r("duration").alias("duration"))


def short_episode_candidates(s, d):
    return ep.short_stops(simple_episodes(s, d).drop("sequence", "duration"), STAYS).select("user_id", F.col("sequence").cast("bigint").alias("sequence"), r("duration").alias("duration"))


def short_episode_collapse(s, d):
    q = ep.without_short_stops(simple_episodes(s, d).drop("sequence", "duration"), P)
    return q.select("user_id", F.col("sequence").cast("bigint").alias("sequence"), r("start").alias("start"), F.col("location_id").cast("bigint").alias("location_id"), "unknown", "type", r("duration").alias("duration"), r("linked_duration").alias("linked_duration"))


def day_slices(s, d):
    q = days.day_slices(simple_episodes(s, d), P)
    return q.select("user_id", F.col("sequence").cast("bigint").alias("sequence"), F.col("date").cast("string").alias("date"), r("minutes").alias("minutes"))


def day_summary(s, d):
    return day_columns(days.day_summary(days.day_slices(simple_episodes(s, d), P)))


def location_dwell(s, d):
    return ep.location_dwell(simple_episodes(s, d)).select("user_id", F.col("location_id").cast("bigint").alias("location_id"), r("seconds").alias("seconds"))


def used_locations(s, d):
    return ep.used_locations(simple_states(s, d)).select("user_id", F.col("location_id").cast("bigint").alias("location_id"))


def mean_in_order(points: str, c: str):
    """The mean of c over an array of points, added in their order, to seven decimals as SQL rounds: halves by the product in a double, not by its digits."""
    return F.round(F.aggregate(points, F.lit(0.0), lambda total, p: total + p[c]) / F.size(points) * 1e7) / 1e7


def computed_places(s, d) -> DataFrame:
    """The mean of the points made for each place. Many means are halves at the eighth decimal, where the order of a sum decides; so the points are added
    in order of ord, however the input is split."""
    points = F.array_sort(F.collect_list(F.struct("ord", "lon", "lat"))).alias("points")
    q = good(s, d).groupBy("user_id", (F.col("place") + 1).alias("location_id")).agg(points)
    return q.select("user_id", "location_id", mean_in_order("points", "lon").alias("lon"), mean_in_order("points", "lat").alias("lat"))


def location_distance_matrix(s, d):
    q = compare.distance_matrix(real_places(good(s, d)), computed_places(s, d))
    return q.select("user_id", F.col("true_id").cast("bigint").alias("true_id"), F.col("comp_id").cast("bigint").alias("comp_id"), r("metres", 1).alias("metres"))


def rounded_quality(q: DataFrame) -> DataFrame:
    return q.select("user_id", *[r(c, 4).alias(c) for c in q.columns[1:]])


def scattered_places(s, d) -> DataFrame:
    """Places between the real ones, so that pairs conflict."""
    each = good(s, d).select("user_id").distinct().withColumn("location_id", F.explode(F.sequence(F.lit(1), (F.col("user_id") % 5 + 2).cast("int"))))
    return each.select("user_id", "location_id", (-79.40 + 0.0043 * F.col("location_id")).alias("lon"), (43.6507 + 0.001 * (F.col("user_id") % 10) + 0.0003 * (F.col("location_id") * 7 % 4)).alias("lat"))


def location_quality(s, d):
    return rounded_quality(compare.location_quality(real_places(good(s, d)), scattered_places(s, d), P))


def greedy_match(s, d):
    return rounded_quality(compare.location_quality(real_places(good(s, d)), scattered_places(s, d), Params(semantics="corrected")))


def both(s, d):
    """Two sides to compare, each made once."""
    return written(simple_episodes(s, d), "truth"), written(simple_episodes(s, d, half=True), "computed")


def episode_overlap(s, d):
    q = compare.overlaps(*both(s, d))
    return q.select("user_id", *[(r if c in ("start", "finish") else lambda x: x.cast("bigint") if "id" in c else x)(F.col(f"{side}.{c}")).alias(f"{side}_{c}") for side in "tc" for c in ("start", "finish", "location_id", "unknown")], r("seconds").alias("seconds"))


def episode_ratios(s, d):
    q = compare.ratios(*both(s, d))
    return q.select("user_id", *[r(c, 6).alias(c) for c in q.columns[1:]])


def episode_strings(s, d):
    return compare.strings(*both(s, d))


def edit_distance(s, d):
    return compare.strings(*both(s, d)).select("user_id", F.levenshtein("true_eps", "comp_eps").cast("bigint").alias("edit_distance"), F.length("true_eps").cast("bigint").alias("record_length"), F.length("comp_eps").cast("bigint").alias("computed_length"))


def comparison_report(s, d):
    truth, computed = both(s, d)
    quality = compare.location_quality(real_places(good(s, d)), scattered_places(s, d), P)
    q = compare.report(quality, compare.ratios(truth, computed), compare.strings(truth, computed))
    return q.select(*[F.col(c).cast("bigint").alias(c) if kind == "int" else F.col(c) for c, kind in q.dtypes])


def marked_lines(s, d):
    lines = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("line_no"), F.concat_ws(",", "event_type", F.col("user_id").cast("string")).alias("value"))
    return compare.mark_repeated_lines(lines)


def full_diary(s, d, result: str) -> DataFrame:
    q = gps(s, d)
    return diary(q.drop("place"), named_places(q), P, stations(s), (result,))[result]


def full_diary_locations(s, d):
    q = full_diary(s, d, "locations")
    return q.select("user_id", F.col("location_id").cast("bigint").alias("location_id"), r("lon", 7).alias("lon"), r("lat", 7).alias("lat"), "description", "used", r("duration").alias("duration"))


def full_diary_episodes(s, d):
    q = full_diary(s, d, "episodes")
    return q.select("user_id", F.col("sequence").cast("bigint").alias("sequence"), r("start").alias("start"), F.col("location_id").cast("bigint").alias("location_id"), "unknown", "type", r("duration").alias("duration"), r("linked_duration").alias("linked_duration"))


def day_columns(q: DataFrame) -> DataFrame:
    return q.select("user_id", F.col("date").cast("string").alias("date"), F.col("dow").cast("bigint").alias("dow"), *[r(c, 4).alias(c) if c.endswith("time") else F.col(c) for c in ("total_time", "total_count", *[x for k in days.KINDS.values() for x in k])])


def full_diary_days(s, d):
    return day_columns(full_diary(s, d, "days"))


def full_diary_points(s, d):
    """Speeds of under a millionth of a metre an hour are rounding errors of the projection and count as none; places made midway
    stand right between two decimals, and are moved a millimetre before they are rounded."""
    q = full_diary(s, d, "points")
    return q.select("user_id", r("unix_time").alias("unix_time"), F.col("known_subset").cast("bigint").alias("known_subset"), r(F.col("lon") + 1.234e-8, 7).alias("lon"), r(F.col("lat") + 1.234e-8, 7).alias("lat"), r("x").alias("x"), r("y").alias("y"), r("weight").alias("weight"), "removed", "interpolated", F.col("state").cast("bigint").alias("state"), F.when(F.col("kde") < 0, -1.0).otherwise(r(F.col("kde") * 1e9, 1)).alias("kde"), F.when(F.col("travel_emit_prob") < -20, -100.0).otherwise(r("travel_emit_prob", 4)).alias("travel_emit_prob"))


def diary_stage_counts(s, d):
    return stage_counts(gps(s, d).drop("place"), P)


def users_only_in_truth(s, d):
    return compare.only_in_truth(simple_episodes(s, d), simple_episodes(s, d).where("user_id % 3 <> 0"))


def episode_timeline(s, d):
    q = compare.timeline(*both(s, d))
    return q.select("user_id", "side", F.col("sequence").cast("bigint").alias("sequence"), r("start").alias("start"), r("finish").alias("finish"), "class")


def start_probabilities(s, d):
    """Of one to six states, from the kernel's own function."""
    rows = [(n, i, float(x)) for n in range(1, 7) for i, x in enumerate(decode.start_probabilities(n))]
    return s.createDataFrame(rows, "states bigint, state bigint, logp double").select("states", "state", r("logp", 9).alias("logp"))


def weight_eligibility(s, d):
    """Weights where points made by interpolation come between, some with long steps between two of them."""
    q = plane(s, d)
    q = segment.time_weights(segment.interpolated(q, segment.spatial_points(q, P)), P)
    return q.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("synthetic").alias("made"), r(F.sum("weight")).alias("weight"))


def local_times(s, d):
    """Times with their offset, from every hour of 2017 and 2018."""
    q = s.range(17_520).select((F.lit(1_483_228_800) + F.col("id") * 3600 + F.col("id") % 4 / 4.0).cast("double").alias("t"))
    return q.select("t", days.local_text(F.col("t"), P).alias("text"), days.day_of(F.col("t"), P).cast("string").alias("day"), days.day_start(days.day_of(F.col("t"), P), P).alias("day_start"))


def shared_csv(s: SparkSession, df: DataFrame, what: str) -> str:
    """df as a CSV folder among the plans' tables."""
    path = f"{shared_folder(s)}/pathloom/{what}-{uuid.uuid4().hex}"
    df.write.csv(path, header=True)
    return path


def csv_coordinates(s, d):
    q = gps(s, d).select(F.lit("x").alias("extra"), F.col("lat").alias("latitude"), F.concat(F.lit("u"), F.col("user_id")).alias("uuid"), F.col("t").alias("timestamp_epoch"), F.col("acc").alias("h_accuracy"), F.col("lon").alias("longitude"))
    return readers.coordinates(s, shared_csv(s, q, "coordinates")).select("user_id", "t", "acc", "lon", "lat")


def csv_survey(s, d):
    q = named_places(gps(s, d)).where("name <> 'school' or user_id % 2 = 0").groupBy("user_id").pivot("name", list(locate.NAMES)).agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    cells = [F.col(f"{n}_{x}").alias(f"location_{c}_{x}") for n, c in readers.PLACES.items() for x in ("lon", "lat")]
    return readers.survey(s, shared_csv(s, q.select(F.col("user_id").alias("uuid"), *cells), "survey")).select(F.col("user_id").cast("bigint").alias("user_id"), "name", "lon", "lat")


def csv_prompts(s, d):
    q = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("int").alias("id"), F.col("user_id").cast("string").alias("uuid"), F.col("event_type").alias("response"), (F.col("event_id") % 2 + 1).cast("int").alias("prompt_num"))
    return readers.prompts(s, shared_csv(s, q, "prompts")).select(F.col("id").cast("bigint").alias("id"), "uuid", "response", F.col("prompt_num").cast("bigint").alias("prompt_num"), "latitude")


def csv_locations(s, d):
    q = real_places(good(s, d)).select("user_id", "location_id", "lon", "lat", F.lit("home/work").alias("description"), F.lit("True").alias("used"))
    return readers.locations(s, shared_csv(s, q, "locations")).select(F.col("user_id").cast("bigint").alias("user_id"), F.col("location_id").cast("bigint").alias("location_id"), "lon", "lat", "description", "used")


def csv_episodes(s, d):
    q = simple_episodes(s, d).withColumn("linked_duration", F.col("duration"))
    q = file_table("episodes", q, P).withColumn("location_id", F.coalesce(F.col("location_id").cast("string"), F.when(F.col("sequence") % 2 == 0, "None")))
    return readers.episodes(s, shared_csv(s, q, "episodes")).select(F.col("user_id").cast("bigint").alias("user_id"), F.col("sequence").cast("bigint").alias("sequence"), F.col("location_id").cast("bigint").alias("location_id"), "unknown", r("start").alias("start"))


def xml_stations(s, d):
    """Nodes of invented map data: every third is a subway station."""
    tag = lambda k, v: F.struct(F.lit(k).alias("_k"), v.alias("_v"))
    q = s.range(300).select(F.col("id").alias("_id"), (43.5 + F.col("id") / 1000.0).alias("_lat"), (-79.5 + F.col("id") / 500.0).alias("_lon"), F.array(tag("railway", F.lit("station")), tag("station", F.when(F.col("id") % 3 == 0, "subway").otherwise("train"))).alias("tag"))
    path = f"{shared_folder(s)}/pathloom/stations-{uuid.uuid4().hex}"
    q.write.format("xml").option("rowTag", "node").option("rootTag", "osm").save(path)
    return readers.stations(s, path)


def file_of(s, q: DataFrame, name: str) -> DataFrame:
    """A result table written as its text file and read back as text: the columns and forms that users of the files see."""
    return s.read.csv(shared_csv(s, file_table(name, q, P), name), header=True)


def file_locations(s, d):
    q = file_of(s, full_diary(s, d, "locations"), "locations")
    return q.select("user_id", "location_id", r(F.col("lon").cast("double"), 7).alias("lon"), r(F.col("lat").cast("double"), 7).alias("lat"), "description", "used", r(F.col("duration").cast("double")).alias("duration"))


def file_episodes(s, d):
    q = file_of(s, full_diary(s, d, "episodes"), "episodes")
    # local times are compared to the second
    return q.select("user_id", "sequence", "location_id", "mode", "unknown", F.regexp_replace("local_start_time", r"\.[0-9]+", "").alias("local_start_time"), r(F.col("unix_start_time").cast("double")).alias("unix_start_time"), r(F.col("duration").cast("double")).alias("duration"))


def file_points(s, d):
    q = file_of(s, full_diary(s, d, "points"), "points")
    return q.groupBy("user_id", "known_subset", "removed", "interpolated", "state", F.substring("timestamp", 1, 13).alias("hour"), F.right("timestamp", F.lit(6)).alias("offset")).agg(F.count("*").alias("n"), r(F.sum(F.col("weight").cast("double")), 2).alias("weight"))


def file_days(s, d):
    q = file_of(s, full_diary(s, d, "days"), "days")
    return q.select("user_id", "date", "DoW", *[r(F.col(c).cast("double"), 4).alias(c) if c.endswith("time") else F.col(c) for c in q.columns[3:]])


def file_comparison(s, d):
    path = f"{shared_folder(s)}/pathloom/comparison-{uuid.uuid4().hex}"
    compare.write_comparison(comparison_report(s, d), path)
    q = s.read.csv(path, header=True)
    return q.select(*[F.col(c).cast("double").alias(c) if c[:4] in ("perc", "mean", "medi") else F.col(c) for c in q.columns])


NAMES = """scan_gps min_points_gate known_error_filter exact_dedup distinct_geometry duplicate_locations user_allow_split neighbor_distance_angle
sequential_dup_filter positional_outlier_candidates positional_outlier_loop near_subway gap_segments segment_stats known_segments project_lcc
unproject_lcc_roundtrip spatial_interpolation temporal_interpolation time_weights rms_accuracy peak_threshold kde_density density_peaks
nearest_named_place emission_probs transition_matrix viterbi_states state_changes_episodes episode_types episode_durations
short_episode_candidates short_episode_collapse day_slices day_summary location_dwell used_locations location_distance_matrix location_quality
greedy_match episode_overlap episode_ratios episode_strings edit_distance comparison_report marked_lines full_diary_episodes full_diary_days
full_diary_locations full_diary_points diary_stage_counts users_only_in_truth episode_timeline start_probabilities weight_eligibility local_times
csv_coordinates csv_survey csv_prompts csv_locations csv_episodes xml_stations file_locations file_episodes file_points file_days
file_comparison""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


# SQL


#: Common table expressions, each of which may use those before it.
WITH = {
    "e": "select event_id, user_id // 5 as u, event_type, value, cast(floor((epoch_us(ts) - 1704067200000000) / 10000000.0::double) as bigint) as rel from events",
    "b": "select *, rel // 14400 as blk, rel % 14400 as off from e",
    "c": "select *, (blk*7 + u*3) % 4 as place, ((blk-1)*7 + u*3 + 28) % 4 as prev_place, least(1.0::double, off / 3600.0::double) as frac from b",
    "gps": """select u as user_id, 1704067200 + rel as t, event_id as ord, value as acc,
      round((-79.40)::double + 0.008::double*(prev_place + frac*(place - prev_place)) + case when event_type = 'signup' and frac = 1 then 0.0::double else (event_id % 11 - 5)*0.00001::double end, 7) as lon,
      round(43.65::double + 0.001::double*(u % 10) + case when event_id % 37 = 0 then 0.004::double else 0.0::double end + case when event_type = 'signup' and frac = 1 then 0.0::double else (event_id % 7 - 3)*0.00001::double end, 7) as lat,
      place from c""",
    "ok": "select * from gps where acc <= 100",
    "pairs": "select *, lag(struct_pack(lat := lat, lon := lon)) over w as p, lead(struct_pack(lat := lat, lon := lon)) over w as n from ok window w as (partition by user_id order by t, ord)",
    "runs": "select *, sum(case when p is null or p.lat <> lat or p.lon <> lon then 1 else 0 end) over (partition by user_id order by t, ord) as run from pairs",
    "heads": "select user_id, run, any_value(lat) as lat, any_value(lon) as lon from runs group by all",
    "around": "select *, lag(struct_pack(lat := lat, lon := lon)) over w as p, lead(struct_pack(lat := lat, lon := lon)) over w as n from heads window w as (partition by user_id order by run)",
    "turns": f"""select g.user_id, g.ord, g.p is not null and g.n is not null as inside, a.p is null or a.n is null as edge,
      {metres_sql("a", "a.p")} as da, {metres_sql("a", "a.n")} as dp, ({course_sql("a", "a.p")} - {course_sql("a", "a.n")}) as turn, coalesce(g.p.lat = g.lat and g.p.lon = g.lon and g.n.lat = g.lat and g.n.lon = g.lon, false) as inter
      from runs g join around a using (user_id, run)""",
    "near": "select user_id, ord, case when inside then coalesce(da, 0.0) end as d_ante, case when inside then coalesce(dp, 0.0) end as d_post, case when not inside then null when edge then 180.0::double else least((turn + 720) % 360, 360 - (turn + 720) % 360) end as angle, inter from turns",
    "stations": f"select * from (values {', '.join(map(str, STATIONS))}) s(lon, lat)",
    "stops": f"select user_id, ord from ok o where {near_station('o')}",
    "pairs2": "select *, lag(ord) over (partition by user_id order by t, ord) as ord0 from pairs",
    "steps": f"select g.*, coalesce({metres_sql('p', 'g')} > 1000 and not (a.ord is not null and b.ord is not null), false) as gap from pairs2 g left join stops a on a.user_id = g.user_id and a.ord = g.ord left join stops b on b.user_id = g.user_id and b.ord = g.ord0",
    "segs": "select *, cast(sum(case when gap then 1 else 0 end) over (partition by user_id order by t, ord) as bigint) as segment from steps",
    "one": "select * from ok qualify row_number() over (partition by user_id, lon, lat, t order by ord) = 1",
    "pl": f"select user_id, t::double as t, ord, acc, lon, lat, {geo.FALSE_EAST!r}::double + {RHO}*sin{THETA} as x, {geo.FALSE_NORTH + geo.RHO_ORIGIN!r}::double - {RHO}*cos{THETA} as y from one",
    "nx": "select *, lead(struct_pack(t := t, acc := acc, lon := lon, lat := lat, x := x, y := y)) over (partition by user_id order by t, ord) as n from pl",
    "wt": "select *, coalesce((t - lag(t) over w)/2, 0) + coalesce((lead(t) over w - t)/2, 0) as weight from pl window w as (partition by user_id order by t, ord)",
    "lim": "select user_id, sqrt(avg(acc*acc)) as rms, sum(weight) as total from wt group by all",
    "thr": f"select *, exp(-0.25::double/(rms*rms + 625)) / (2*pi()*(rms*rms + 625)) * {STAYS.minimum_activity}::double / total as threshold from lim",
    "geom": "select user_id, lon, lat, any_value(x) as x, any_value(y) as y, sum(weight) as w from wt group by user_id, lon, lat",
    "dens": "select a.user_id, a.lon, a.lat, sum(b.w * exp(-(pow(a.x-b.x, 2) + pow(a.y-b.y, 2)) / 1250)) / (any_value(l.total) * 2 * pi() * 625) as kde from geom a join geom b using (user_id) join lim l using (user_id) group by all",
    "high": "select d.*, round(kde * 1e9, 6) as h from dens d join thr using (user_id) where kde >= threshold",
    "places": "select user_id, k as location_id, (-79.40)::double + 0.008::double*(k-1) as lon, 43.65::double + 0.001::double*(user_id % 10) as lat from (select distinct user_id from ok), (select unnest([1,2,3,4]) as k)",
}


def states_sql(name: str, where: str) -> dict[str, str]:
    return {
        f"st{name}": f"select p.user_id, p.t, p.ord, arg_min(c.location_id, (round({metres_sql('p', 'c')}, 3), c.location_id)) as k, min(round({metres_sql('p', 'c')}, 3)) as m from pl p join places c using (user_id) where {where} group by all",
        f"sx{name}": f"select user_id, t, ord, case when m <= 100 then k else 0 end as state from st{name}",
        f"sl{name}": f"select *, lag(state) over w as before, lag(t) over w as t0, lead(t) over w is null as last from sx{name} window w as (partition by user_id order by t, ord)",
        f"su{name}": f"select user_id, case when before is null then t else t0 + (t - t0)/2 end as start, nullif(state, 0) as location_id, false as unknown from sl{name} where before is null or before <> state union all select user_id, t, null, true from sl{name} where last",
        f"ep{name}": f"""select *, row_number() over w - 1 as sequence, lead(start) over w as finish, lead(start) over w - start as duration,
          case when unknown then 'unknown' when location_id is null then 'travel' when location_id = 1 then 'home' when location_id = 2 then 'work' when location_id = 3 then 'school' else 'other' end as type
          from su{name} window w as (partition by user_id order by start, unknown, location_id nulls first)""",
    }


def slices_sql(source: str) -> str:
    """Pieces between instants: each local midnight is put back into the zone."""
    return f"""select user_id, sequence, type, date, (least(start + duration, epoch_us(timezone('{P.zone}', (date + 1)::timestamp)) / 1e6::double) - greatest(start, epoch_us(timezone('{P.zone}', date::timestamp)) / 1e6::double)) / 60 as minutes from (
      select *, unnest(generate_series(timezone('{P.zone}', to_timestamp(start))::date::timestamp, timezone('{P.zone}', to_timestamp(start + duration))::date::timestamp, interval 1 day))::date as date from {source} where duration is not null)"""


WITH |= states_sql("1", "true") | states_sql("2", "p.ord % 2 = 0")
WITH |= {
    "sli": slices_sql("ep1"),
    "comp": "select user_id, place + 1 as location_id, round(avg(lon), 7) as lon, round(avg(lat), 7) as lat from ok group by all",
    "win": "select user_id, greatest(a.s, b.s) as low, least(a.f, b.f) as high from (select user_id, min(start) as s, max(start) as f from ep1 group by all) a join (select user_id, min(start) as s, max(start) as f from ep2 group by all) b using (user_id)",
    "ov": """select t.user_id, t.start as ts, t.finish as tf, c.start as cs, c.finish as cf, t.location_id as tl, t.unknown as tu, c.location_id as cl, c.unknown as cu, least(t.finish, c.finish, high) - greatest(t.start, c.start, low) as seconds
      from ep1 t join ep2 c on t.user_id = c.user_id and t.start < c.finish and c.start < t.finish join win w on w.user_id = t.user_id where least(t.finish, c.finish, high) > greatest(t.start, c.start, low)""",
    "sc": """select user_id, sum(seconds) filter (tu and cu) as s0, sum(seconds) filter (tl is null and cl is null) as s1, sum(seconds) filter (tl is not null and cl is not null) as s2, sum(seconds) filter (tu) as s3,
      sum(seconds) filter (tl is null) as s4, sum(seconds) filter (tl is not null) as s5, sum(seconds) filter (cu and not tu) as s6, sum(seconds) filter (tl is not null and cl is null) as s7, sum(seconds) filter (tl is null and cl is not null) as s8 from ov group by all""",
    "sa": "select user_id, string_agg(case when unknown then 'U' when location_id is not null then 'A' else 'T' end, '' order by start, sequence) as s from ep1 join win using (user_id) where finish >= low and finish <= high group by all",
    "sb": "select user_id, string_agg(case when unknown then 'U' when location_id is not null then 'A' else 'T' end, '' order by start, sequence) as s from ep2 e join win using (user_id) where finish >= low and finish <= high and (finish < high or not exists (select 1 from ep1 x where x.user_id = e.user_id and x.start = high)) group by all",
    "strs": "select user_id, coalesce(sa.s, '') as true_eps, coalesce(sb.s, '') as comp_eps from win left join sa using (user_id) left join sb using (user_id)",
}

SPEED = {s: f"{metres_sql('p', s)} / case when abs(p.t - {s}.t) = 0 then 1 else abs(p.t - {s}.t) end" for s in ("b", "n")}
WITH |= CLEANING | {"homes": "select * from places where location_id <= 3"} | DIARY | {
    "vem": f"""select p.user_id, 0 as seg, row_number() over (partition by p.user_id order by p.t, p.ord) as n, p.ord, [case when b is null or n is null then ln(0.25::double) when v > 0 then ln(1 - exp(-v/2)) else -100.0::double end] || e as e
      from (select *, ({SPEED['b']} + {SPEED['n']})/2 as v from (select *, lag(struct_pack(t := t, lon := lon, lat := lat)) over (partition by user_id order by t, ord) as b from nx) p) p
      join (select p.user_id, p.ord, list(-pow({metres_sql('p', 'c')}, 2)/11250 order by c.location_id) as e from pl p join places c using (user_id) group by all) x on x.user_id = p.user_id and x.ord = p.ord""",
    **viterbi_sql("_v", "vem"),
    **collapse_sql("_s", "ep1"),
    "scattered": "select user_id, k as location_id, (-79.40)::double + 0.0043::double*k as lon, 43.6507::double + 0.001::double*(user_id % 10) + 0.0003::double*(k*7 % 4) as lat from (select user_id, unnest(range(1, user_id % 5 + 3)) as k from (select distinct user_id from ok))",
    "tc": f"select user_id, a.location_id as t, b.location_id as c, {metres_sql('a', 'b')} as m from places a join scattered b using (user_id)",
    **matching_sql("_r", "tc", True),
    **matching_sql("_c", "tc", False),
    "size": "select user_id, count(distinct t) as n, count(distinct c) as k from tc group by all",
    "quality": "select user_id, any_value((k - n) / n) as excess, avg(m) as mean_distance, median(m) as median_distance from matched_r join size using (user_id) group by user_id",
    "ratio": """select user_id, coalesce(s0, 0)/nullif(s3, 0) as identified_unknown, coalesce(s1, 0)/nullif(s4, 0) as identified_travel, coalesce(s2, 0)/nullif(s5, 0) as identified_location,
      coalesce(s6, 0)/nullif(high - low - coalesce(s0, 0), 0) as misidentified_unknown, coalesce(s7, 0)/nullif(high - low - coalesce(s1, 0), 0) as misidentified_travel, coalesce(s8, 0)/nullif(high - low - coalesce(s2, 0), 0) as misidentified_location
      from win join sc using (user_id)""",
    "report": f"""select user_id, {', '.join(f"round_even({c}, 2) as {c}" for c in list(compare.COMPARISON.values())[1:10])}, true_eps, comp_eps, levenshtein(true_eps, comp_eps)::bigint as edit_distance, length(true_eps)::bigint as record_length, length(comp_eps)::bigint as computed_length
      from quality join ratio using (user_id) join strs using (user_id)""",
    "sli_d": slices_sql("stays_d"),
    "dwell_d": "select user_id, location_id, sum(coalesce(linked_duration, 0)) as s from stays_d where location_id is not null group by all",
    "used_d": "select distinct user_id, state as location_id from j1 where state > 0",
    "places_d": "select l.user_id, l.location_id, round(lon, 7) as lon, round(lat, 7) as lat, coalesce(names, '') as description, u.location_id is not null as used, round(coalesce(s, 0), 3) as duration from h5 l left join h7 using (user_id, location_id) left join used_d u using (user_id, location_id) left join dwell_d using (user_id, location_id)",
    "marks": "select user_id, first.seg as seg, first.t as t, first.synthetic as synthetic, first.ord as ord, first.j as j, kde from h3",
    # places that only points in time add have no density: the first point of a place among all
    "firsts": "select *, row_number() over (partition by user_id, lon, lat order by seg, t, synthetic, ord, j) = 1 as leads from j1",
    "points_d": f"""select f.user_id, t as unix_time, case when not synthetic then seg end as known_subset, f.lon, f.lat, x, y, weight, false as removed, synthetic as interpolated, state, case when leads then coalesce(d.kde, -1) else -1 end as kde, travel as travel_emit_prob
      from firsts f left join h3 d on d.user_id = f.user_id and d.lon = f.lon and d.lat = f.lat
      union all select user_id, t, null, lon, lat, {geo.FALSE_EAST!r}::double + {RHO}*sin{THETA}, {geo.FALSE_NORTH + geo.RHO_ORIGIN!r}::double - {RHO}*cos{THETA}, 0, true, false, null, -1, null from clean where why is not null""",
}

_MID = "round((acc + n.acc)/2, 6) as acc, round(x + j/parts*(n.x - x), 3) as x, round(y + j/parts*(n.y - y), 3) as y"
_DAY = ", ".join(f"round(coalesce(sum(minutes) filter (type = '{k}'), 0), 4) as {t}, count(*) filter (type = '{k}') as {c}" for k, (t, c) in days.KINDS.items())

_STAYS = "user_id, sequence, round(start, 3) as start, location_id::bigint as location_id, unknown, type, round(duration, 3) as duration, round(linked_duration, 3) as linked_duration"
_HALVES = {s: f"case when abs(f.t - {s}.t) < 500 or not f.synthetic or not {s}.synthetic then abs(f.t - {s}.t)/2 else 0 end" for s in ("b", "n")}
_PARTS = f"(select *, unnest(case when parts > 5 then [1, 2, parts-2, parts-1] else range(1, parts) end)::double as j from (select *, cast(ceil(d/30) as bigint) as parts from (select g.*, {metres_sql('g', 'n')} as d from nx g) where d > 30))"
_WHEN = f"case when d >= (n.t - t)*{P.walking_speed!r}::double then t + j/parts*(n.t - t) else n.t - (1 - j/parts)*d/{P.walking_speed!r}::double end"

_DAY_TEXT = ", ".join(f"round(coalesce(sum(minutes) filter (type = '{k}'), 0), 4) as {t}, (count(*) filter (type = '{k}'))::varchar as {c}" for k, (t, c) in days.KINDS.items())
SELECT = {
    "scan_gps": "select user_id, t, ord, acc, lon, lat, place from gps",
    "min_points_gate": "select user_id, count(*) as n from gps group by user_id having count(*) > 330",
    "known_error_filter": "select user_id, ord, acc from ok",
    "exact_dedup": "select user_id, t, ord, lon, lat from (select * from gps union all select user_id, t, ord + 1000000000, acc, lon, lat, place from gps where ord % 10 = 0) qualify row_number() over (partition by user_id, lon, lat, t order by ord) = 1",
    "distinct_geometry": "select user_id, t, ord, lon, lat from ok qualify row_number() over (partition by user_id, lon, lat order by t, ord) = 1",
    "duplicate_locations": "select user_id, lon, lat, count(*) as n from ok group by all having count(*) > 1",
    "user_allow_split": "select case when user_id % 3 = 0 then 'allowed' else 'others' end as side, count(*) as n, sum(ord)::bigint as ords from gps group by all",
    "neighbor_distance_angle": "select user_id, ord, round(d_ante, 3) as d_ante, round(d_post, 3) as d_post, round(angle, 2) as angle, inter from near",
    "sequential_dup_filter": "select user_id, ord from near where not inter",
    "positional_outlier_candidates": "select user_id, ord, round(angle, 2) as angle from near where round(angle, 6) = 0 or (round(angle, 6) < 15 and least(d_ante, d_post) > 100)",
    "near_subway": "select user_id, ord from stops",
    "gap_segments": "select user_id, ord, segment from segs",
    "segment_stats": "select user_id, segment, count(*) as n_points, max(t) - min(t) as seconds from segs group by all",
    "known_segments": "select user_id, row_number() over (partition by user_id order by segment) - 1 as known_subset, n_points from (select user_id, segment, count(*) as n_points, max(t) - min(t) as s from segs group by all) where n_points >= 80 and s > 80000",
    "project_lcc": "select user_id, ord, round(x, 3) as x, round(y, 3) as y from pl",
    "unproject_lcc_roundtrip": "select user_id, ord, round(lon, 9) as lon, round(lat, 9) as lat from pl",
    "spatial_interpolation": f"""select user_id, ord, round(case when d >= (n.t - t)*{P.walking_speed!r}::double then t + j/parts*(n.t - t) else n.t - (1 - j/parts)*d/{P.walking_speed!r}::double end, 3) as t, {_MID} from (
      select *, unnest(case when parts > 5 then [1, 2, parts-2, parts-1] else range(1, parts) end)::double as j from (select *, cast(ceil(d/30) as bigint) as parts from (select g.*, {metres_sql('g', 'n')} as d from nx g) where d > 30))""",
    "temporal_interpolation": f"select user_id, ord, round(t + j/parts*(n.t - t), 3) as t, {_MID} from (select *, unnest(range(1, parts))::double as j from (select *, cast(ceil((n.t - t)/600) as bigint) as parts from nx where n.t - t > 600))",
    "time_weights": "select user_id, ord, weight from wt",
    "rms_accuracy": "select user_id, round(sqrt(avg(acc*acc)), 6) as rms from ok group by all",
    "peak_threshold": "select user_id, total, round(threshold * 1e9, 3) as threshold from thr",
    "kde_density": "select user_id, lon, lat, round(kde * 1e9, 2) as kde from dens",
    "density_peaks": f"select user_id, lon, lat from high a where not exists (select 1 from high b where b.user_id = a.user_id and b.h > a.h and {metres_sql('a', 'b')} <= 100)",
    "nearest_named_place": f"""select user_id, name, location_id, round(m, 3) as metres from (select c.user_id, ['home', 'work', 'school'][c.location_id] as name, g.ord as location_id, round({metres_sql('c', 'g')}, 6) as m
      from places c join (select * from ok qualify row_number() over (partition by user_id, lon, lat order by t, ord) = 1) g using (user_id) where c.location_id <= 3) where true qualify row_number() over (partition by user_id, name order by m, location_id) = 1 and m <= 200""",
    "emission_probs": f"""select p.user_id, p.ord, c.location_id::bigint as location_id, round(case when b is null or n is null then ln(0.25) when v > 0 then ln(1 - exp(-v/2)) else -100 end, 6) as travel_emit, round(-pow({metres_sql('p', 'c')}, 2)/11250, 3) as place_emit
      from (select *, ({SPEED['b']} + {SPEED['n']})/2 as v from (select *, lag(struct_pack(t := t, lon := lon, lat := lat)) over (partition by user_id order by t, ord) as b from nx) p) p join places c using (user_id)""",
    "transition_matrix": "select a, b, round(case when a = 0 and b = 0 then ln(0.95) when a = 0 then ln(0.05/5) when b = 0 or a = b then ln(0.5) else -100 end, 9) as logp from range(5) x(a), range(5) y(b)",
    "state_changes_episodes": "select user_id, sequence, round(start, 3) as start, location_id::bigint as location_id, unknown from ep1",
    "episode_types": "select user_id, sequence, type from ep1",
    "episode_durations": "select user_id, sequence, round(duration, 3) as duration from ep1",
    "short_episode_candidates": "select user_id, sequence, round(duration, 3) as duration from ep1 where type not in ('unknown', 'travel') and duration < 4000",
    "day_slices": "select user_id, sequence, date::varchar as date, round(minutes, 3) as minutes from sli",
    "day_summary": f"select user_id, date::varchar as date, isodow(date) - 1 as dow, round(sum(minutes), 4) as total_time, count(*) as total_count, {_DAY} from sli group by user_id, sli.date",
    "positional_outlier_loop": "select user_id, ord, coalesce(why, 'kept') as step from clean",
    "diary_stage_counts": "select user_id, coalesce(why, 'kept') as step, count(*) as n from clean group by all",
    "viterbi_states": "select v.user_id, v.ord, p.state from vem v join path_v p using (user_id, seg, n)",
    "short_episode_collapse": f"select {_STAYS} from stays_s",
    "location_quality": "select user_id, round(excess, 4) as excess, round(mean_distance, 4) as mean_distance, round(median_distance, 4) as median_distance from quality",
    "greedy_match": "select user_id, round(any_value((k - n) / n), 4) as excess, round(avg(m), 4) as mean_distance, round(median(m), 4) as median_distance from matched_c join size using (user_id) group by user_id",
    "comparison_report": "select * from report",
    "full_diary_episodes": f"select {_STAYS} from stays_d",
    "full_diary_days": f"select user_id, date::varchar as date, isodow(date) - 1 as dow, round(sum(minutes), 4) as total_time, count(*) as total_count, {_DAY} from sli_d group by user_id, sli_d.date",
    "full_diary_locations": "select * from places_d",
    "full_diary_points": "select user_id, round(unix_time, 3) as unix_time, known_subset, round(lon + 1.234e-8, 7) as lon, round(lat + 1.234e-8, 7) as lat, round(x, 3) as x, round(y, 3) as y, round(weight, 3) as weight, removed, interpolated, state, case when kde < 0 then -1 else round(kde * 1e9, 1) end as kde, case when travel_emit_prob < -20 then -100 else round(travel_emit_prob, 4) end as travel_emit_prob from points_d",
    "users_only_in_truth": "select distinct user_id from ep1 where user_id % 3 = 0",
    "episode_timeline": " union all ".join(f"select user_id, '{side}' as side, sequence, round(start, 3) as start, round(finish, 3) as finish, case when unknown then 'U' when location_id is not null then 'A' else 'T' end as class from {ep} where finish is not null" for side, ep in (("truth", "ep1"), ("computed", "ep2"))),
    "start_probabilities": "select n as states, s as state, round(case when s = 0 then ln(0.5) else ln(0.5 / n) end, 9) as logp from (select n, unnest(range(n)) as s from range(1, 7) x(n))",
    "weight_eligibility": f"""select user_id, count(*) as n, count(*) filter (synthetic) as made, round(sum(weight), 3) as weight from (
      select f.user_id, f.synthetic, coalesce(case when b is not null then {_HALVES['b']} end, 0) + coalesce(case when n is not null then {_HALVES['n']} end, 0) as weight from (select *, lag(struct_pack(t := t, synthetic := synthetic)) over w as b, lead(struct_pack(t := t, synthetic := synthetic)) over w as n from (
        select user_id, t, ord, false as synthetic, 0 as j from pl union all select user_id, {_WHEN} as t, ord, true, j from {_PARTS}) window w as (partition by user_id order by t, synthetic, ord, j)) f) group by user_id""",
    "local_times": f"""select t, strftime(here, '%Y-%m-%d %H:%M:%S') || case when microsecond(here) % 1000000 = 0 then '' else strftime(here, '.%f') end || format('-{{:02d}}:00', cast((epoch_us(timezone('UTC', to_timestamp(t))) - epoch_us(here)) / 3600000000 as int)) as text, here::date::varchar as day,
      epoch_us(timezone('{P.zone}', here::date::timestamp)) / 1e6::double as day_start from (select t, timezone('{P.zone}', to_timestamp(t)) as here from (select (1483228800 + i * 3600 + i % 4 / 4.0)::double as t from range(17520) x(i)))""",
    "csv_coordinates": "select 'u' || user_id as user_id, t, acc, lon, lat from gps",
    "csv_survey": "select user_id, ['home', 'work', 'school'][location_id] as name, lon, lat from (select user_id, k as location_id, (-79.40)::double + 0.008::double*(k-1) as lon, 43.65::double + 0.001::double*(user_id % 10) as lat from (select distinct user_id from gps), (select unnest([1,2,3]) as k)) where location_id < 3 or user_id % 2 = 0",
    "csv_prompts": "select event_id as id, user_id::varchar as uuid, event_type as response, event_id % 2 + 1 as prompt_num, null::double as latitude from events",
    "csv_locations": "select user_id, location_id::bigint as location_id, lon, lat, 'home/work' as description, 'True' as used from places",
    "csv_episodes": "select user_id, sequence, location_id::bigint as location_id, unknown, round(start, 3) as start from ep1",
    "xml_stations": "select round(-79.5 + i / 500.0::double, 7) as lon, round(43.5 + i / 1000.0::double, 7) as lat from range(0, 300, 3) x(i)",
    "file_locations": "select user_id::varchar as user_id, location_id::varchar as location_id, lon, lat, nullif(description, '') as description, used::varchar as used, duration from places_d",
    "file_episodes": f"select user_id::varchar as user_id, sequence::varchar as sequence, location_id::varchar as location_id, null::varchar as mode, case when unknown then 'True' end as unknown, strftime(timezone('{P.zone}', to_timestamp(floor(start))), '%Y-%m-%d %H:%M:%S') || '-05:00' as local_start_time, round(start, 3) as unix_start_time, nullif(round(linked_duration, 3), 0) as duration from stays_d",
    "file_points": f"""select user_id::varchar as user_id, known_subset::varchar as known_subset, removed::varchar as removed, interpolated::varchar as interpolated, state::varchar as state, strftime(timezone('{P.zone}', to_timestamp(unix_time)), '%Y-%m-%d %H') as hour, '-05:00' as "offset", count(*) as n, round(sum(weight), 2) as weight from points_d group by all""",
    "file_days": f"select user_id::varchar as user_id, date::varchar as date, (isodow(date) - 1)::varchar as DoW, round(sum(minutes), 4) as total_time, count(*)::varchar as total_count, {_DAY_TEXT} from sli_d group by user_id, sli_d.date",
    "file_comparison": f"select {', '.join(f'{v}::varchar as {k}' if k in ('user', 'edit_distance', 'record_length', 'computed_length') else f'nullif({v}, chr(0)) as {k}' if k.endswith('eps') else f'{v} as {k}' for k, v in compare.COMPARISON.items())} from report".replace("'user'", "user"),
    "location_dwell": "select user_id, location_id::bigint as location_id, round(sum(coalesce(duration, 0)), 3) as seconds from ep1 where location_id is not null group by all",
    "used_locations": "select distinct user_id, state::bigint as location_id from sx1 where state > 0",
    "location_distance_matrix": f"select user_id, a.location_id::bigint as true_id, b.location_id::bigint as comp_id, round({metres_sql('a', 'b')}, 1) as metres from places a join comp b using (user_id)",
    "episode_overlap": "select user_id, round(ts, 3) as t_start, round(tf, 3) as t_finish, tl::bigint as t_location_id, tu as t_unknown, round(cs, 3) as c_start, round(cf, 3) as c_finish, cl::bigint as c_location_id, cu as c_unknown, round(seconds, 3) as seconds from ov",
    "episode_ratios": f"select user_id, {', '.join(f'round({c}, 6) as {c}' for c in list(compare.COMPARISON.values())[4:10])} from ratio",
    "episode_strings": "select * from strs",
    "edit_distance": "select user_id, levenshtein(true_eps, comp_eps)::bigint as edit_distance, length(true_eps)::bigint as record_length, length(comp_eps)::bigint as computed_length from strs",
    "marked_lines": "select event_id as line_no, event_type || ',' || user_id as value, event_type || ',' || user_id || case when row_number() over (partition by event_type, user_id order by event_id) > 1 then ' *' else '' end as marked from events",
}


#: Tables that several others use, or that are dear: made once.
ONCE = {"gps", "ok", "pl", "h1", "h3", "h5", "g9", "i3", "i4", "j1", "j4", "clean", "ep1", "ep2", "vem", "stays_d", "forward_d", "forward_v", "cleaning", "f6", "dens"}


def needed(text: str) -> list[str]:
    """The CTEs that a text uses, in order, each with those that it uses itself."""
    found, todo = set(), [text]
    while todo:
        for name in set(re.findall(r"[a-z_0-9]+", todo.pop())) & WITH.keys() - found:
            found.add(name)
            todo.append(WITH[name])
    return [k for k in WITH if k in found]


def oracle_sql() -> dict[str, str]:
    """Each query's SQL with the CTEs that it uses."""
    out = {}
    for k, v in SELECT.items():
        head = ",\n".join(f"{n} as {'materialized ' if n in ONCE else ''}({WITH[n]})" for n in needed(v))
        out[k] = f"with recursive {head}\n{v}" if head else v
    return out
