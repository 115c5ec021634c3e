"""The travel diary as one plan: clean, segment, interpolate, locate, decode, name, collapse, sum by day; and its output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, days, decode, locate, segment
from ..operators import episodes as ep
from ..params import Params
from .tables import remove, written


RESULTS = ("locations", "episodes", "points", "days")


def diary(points: DataFrame, places: DataFrame, p: Params | None = None, stations: DataFrame | None = None, results: tuple[str, ...] = RESULTS) -> dict[str, DataFrame]:
    """points (user_id, t, ord, acc, lon, lat) and named places (user_id, name, lon, lat) to locations, episodes, points and days, of which
    only those asked for are made.

    Users without points left, without locations or without named places have no or fewer rows, and raise nothing. Tables that the results
    asked for don't read are removed; close() removes the others, once the results have been used.
    """
    p = p or Params()
    cleaned = written(clean.clean_users(clean.min_points_gate(points.where("lon is not null and lat is not null"), p), p), "cleaned")
    kept = cleaned.where("removed_by is null").drop("removed_by")
    known = segment.known_segments(segment.gap_segments(kept, p, stations), p)
    plane = segment.with_plane(known.where("known_subset is not null"))
    filled = written(segment.time_weights(segment.interpolated(plane, segment.spatial_points(plane, p)), p), "filled")
    density = written(locate.kde(filled, p), "density")
    # errors count of all points kept, also of those in segments that aren't known
    limits = locate.rms_accuracy(kept).join(filled.groupBy("user_id").agg(F.sum("weight").alias("total")), "user_id")
    limits = limits.select("user_id", locate.peak_threshold(F.col("rms"), F.col("total"), p).alias("threshold"))
    order = filled.groupBy("user_id", "lon", "lat").agg(F.min(F.struct("known_subset", "t", "synthetic", "ord", "j")).alias("first"))
    found = locate.peaks(density.join(limits, "user_id"), p).join(order, ["user_id", "lon", "lat"])
    locations = written(locate.numbered(found, ["first"]).select("user_id", "location_id", "lon", "lat"), "locations")
    names = locate.location_names(locate.nearest_named(places, locations, p))
    dense = segment.interpolated(filled, segment.temporal_points(filled, p)).fillna({"weight": 0.0})
    states = written(decode.states(decode.travel_emission(dense), locations, p), "states")
    out, used = {}, set()
    if set(results) - {"points"}:
        typed = ep.with_types(ep.state_changes(states), names)
        stays = written(ep.without_short_stops(typed, p), "episodes")
        out |= {"episodes": stays, "days": days.day_summary(days.day_slices(stays, p)), "locations": location_table(locations, names, states, stays)}
        used |= {"stays"}
    if "points" in results:
        out["points"] = point_table(states, density, cleaned.where("removed_by is not null"), p)
        used |= {"cleaned", "density", "states"}
    if "locations" in results:
        used |= {"locations", "states"}
    made = {"cleaned": cleaned, "filled": filled, "density": density, "locations": locations, "states": states} | ({"stays": out["episodes"]} if "episodes" in out else {})
    remove(*[t for k, t in made.items() if k not in used])
    return {k: out[k] for k in results}


def close(tables: dict[str, DataFrame]) -> None:
    """Remove what the results of diary() are read from."""
    folders = {f.rsplit("/", 1)[0]: df for df in tables.values() for f in df.inputFiles()}
    for folder, df in folders.items():
        if folder.rsplit("/", 2)[-2] == "pathloom":
            remove(df.sparkSession.read.parquet(folder))


def location_table(locations: DataFrame, names: DataFrame, states: DataFrame, episodes: DataFrame) -> DataFrame:
    used = ep.used_locations(states).withColumn("used", F.lit(True))
    dwell = ep.location_dwell(episodes, "linked_duration")
    q = locations.join(names, ["user_id", "location_id"], "left").join(used, ["user_id", "location_id"], "left").join(dwell, ["user_id", "location_id"], "left")
    return q.select("user_id", "location_id", "lon", "lat", F.coalesce(F.array_join("names", "/"), F.lit("")).alias("description"), F.coalesce("used", F.lit(False)).alias("used"), F.coalesce("seconds", F.lit(0.0)).alias("duration"))


def point_table(states: DataFrame, density: DataFrame, removed: DataFrame, p: Params) -> DataFrame:
    """Points that were kept, then those removed. The density stands on the first point of each place, -1 on all others."""
    x, y = segment.project(F.col("lon"), F.col("lat"))
    first = states.groupBy("user_id", "lon", "lat").agg(F.min(F.struct("known_subset", "t", "synthetic", "ord", "j")).alias("f"))
    marks = first.join(density.select("user_id", "lon", "lat", "kde"), ["user_id", "lon", "lat"]).select("user_id", "f.*", "kde")
    keys = ["user_id", "known_subset", "t", "synthetic", "ord", "j"]
    kept = states.join(marks, keys, "left").select("user_id", F.col("t").alias("unix_time"), F.when(~F.col("synthetic"), F.col("known_subset")).alias("known_subset"), "lon", "lat", "x", "y", "weight", F.lit(False).alias("removed"), F.col("synthetic").alias("interpolated"), "state", F.coalesce("kde", F.lit(-1.0)).alias("kde"), F.col("travel_emit").alias("travel_emit_prob"))
    gone = removed.select("user_id", F.col("t").cast("double").alias("unix_time"), "lon", "lat", x.alias("x"), y.alias("y"), F.lit(0.0).alias("weight"), F.lit(True).alias("removed"), F.lit(False).alias("interpolated"), F.lit(-1.0).alias("kde"))
    return kept.unionByName(gone, allowMissingColumns=True).withColumn("timestamp", days.local_text(F.col("unix_time"), p))


#: The columns of the text files, in order, and where they come from.
FILES = {
    "locations": ["user_id", "location_id", "lon", "lat", "description", "used", "duration"],
    "episodes": ["user_id", "sequence", "location_id", "mode", "unknown", "local_start_time", "unix_start_time", "duration"],
    "points": ["user_id", "unix_time", "known_subset", "lon", "lat", "x", "y", "weight", "removed", "timestamp", "interpolated", "state", "kde", "travel_emit_prob"],
    "days": ["user_id", "date", "DoW", "total_time", "total_count", *[c for pair in days.KINDS.values() for c in pair]],
}


def file_table(name: str, df: DataFrame, p: Params) -> DataFrame:
    """A diary table as its text file has it."""
    if name == "episodes":
        text = days.local_text(F.col("start"), p)
        spent = F.when(F.col("linked_duration") != 0, F.col("linked_duration"))
        df = df.select("user_id", "sequence", "location_id", F.lit("").alias("mode"), F.when(F.col("unknown"), "True").alias("unknown"), text.alias("local_start_time"), F.col("start").alias("unix_start_time"), spent.alias("duration"))
    if name == "days":
        df = df.withColumnRenamed("dow", "DoW")
    return df.select(FILES[name])


def write_files(tables: dict[str, DataFrame], folder: str, p: Params | None = None) -> None:
    """Each table as CSV with a header, one file a task."""
    for name, df in tables.items():
        file_table(name, df, p or Params()).write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def stage_counts(points: DataFrame, p: Params) -> DataFrame:
    """How many points each cleaning step removes from each user."""
    return clean.clean_users(points, p).groupBy("user_id", F.coalesce("removed_by", F.lit("kept")).alias("step")).agg(F.count("*").alias("n"))
