"""Cutting a trace at data gaps, interpolation in space and time, and time weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle, project, unproject
from ..params import Params
from .clean import by_time


def near_subway(points: DataFrame, stations: DataFrame | None, p: Params) -> DataFrame:
    """Adds near_subway: a station closer than subway_radius. Stations are put into every grid cell that their circle may touch, so that
    points find them by an equi-join whichever side is large."""
    if stations is None:
        return points.withColumn("near_subway", F.lit(False))
    # a cell is at least as wide as the radius between the polar circles
    high, wide = p.subway_radius / 111_000, p.subway_radius / 44_000
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    grid = stations.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).withColumn("_i", F.explode(F.transform(steps, lambda d: F.floor(F.col("_lat") / high) + d))).withColumn("_j", F.explode(F.transform(steps, lambda d: F.floor(F.col("_lon") / wide) + d)))
    key = points.select("user_id", "ord", "lon", "lat", F.floor(F.col("lat") / high).alias("_i"), F.floor(F.col("lon") / wide).alias("_j"))
    close = great_circle(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) < p.subway_radius
    found = key.join(grid, ["_i", "_j"]).where(close).select("user_id", "ord").distinct().withColumn("near_subway", F.lit(True))
    return points.join(found, ["user_id", "ord"], "left").fillna({"near_subway": False})


def gap_segments(points: DataFrame, p: Params, stations: DataFrame | None = None) -> DataFrame:
    """Adds segment, from 0: a new one begins where the step from the point before is over gap_distance, unless both ends are near a subway
    station (and, if min_gap_seconds is set, only where it lasts so long)."""
    w = by_time()
    q = near_subway(points, stations, p)
    step = great_circle(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    gap = (step > p.gap_distance) & ~(F.col("near_subway") & F.lag("near_subway").over(w))
    if p.min_gap_seconds is not None:
        gap = gap & (F.col("t") - F.lag("t").over(w) > p.min_gap_seconds)
    q = q.withColumn("_gap", F.coalesce(gap.cast("int"), F.lit(0)))
    return q.withColumn("segment", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "near_subway")


def known_segments(segments: DataFrame, p: Params) -> DataFrame:
    """Segments with enough points that last long enough, renumbered from 0 as known_subset; the others' points get null."""
    size = segments.groupBy("user_id", "segment").agg(F.count("*").alias("_n"), (F.max("t") - F.min("t")).alias("_s"))
    good = size.where((F.col("_n") >= p.segment_points) & (F.col("_s") > p.segment_seconds))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("segment")) - 1
    return segments.join(good.select("user_id", "segment", rank.alias("known_subset")), ["user_id", "segment"], "left").drop("segment")


def segment_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("user_id", "segment").agg(F.count("*").alias("n_points"), (F.max("t") - F.min("t")).alias("seconds"))


def with_plane(points: DataFrame) -> DataFrame:
    """Adds x and y, projected metres, and what points made later have: synthetic, and j, their order among equal times."""
    x, y = project(F.col("lon"), F.col("lat"))
    return points.select("user_id", "known_subset", F.col("t").cast("double").alias("t"), "ord", "acc", "lon", "lat", x.alias("x"), y.alias("y"), F.lit(False).alias("synthetic"), F.lit(0).cast("bigint").alias("j"))


def segment_order():
    return Window.partitionBy("user_id", "known_subset").orderBy("t", "synthetic", "ord", "j")


def _steps(points: DataFrame) -> DataFrame:
    """Adds the next point of the segment as n."""
    return points.withColumn("n", F.lead(F.struct("t", "acc", "lon", "lat", "x", "y")).over(segment_order())).where("n is not null")


def _between(steps: DataFrame, j: Column, share: Column, t: Column, stage: int) -> DataFrame:
    """Synthetic points: the place linear in projected metres, the error the mean of both ends."""
    q = steps.withColumn("j2", F.explode(j)).withColumns({"f": share, "t2": t})
    q = q.withColumns({"x2": F.col("x") + F.col("f") * (F.col("n.x") - F.col("x")), "y2": F.col("y") + F.col("f") * (F.col("n.y") - F.col("y"))})
    lon, lat = unproject(F.col("x2"), F.col("y2"))
    return q.select("user_id", "known_subset", F.col("t2").alias("t"), "ord", ((F.col("acc") + F.col("n.acc")) / 2).alias("acc"), lon.alias("lon"), lat.alias("lat"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(True).alias("synthetic"), (F.lit(stage) * 1_000_000 + F.col("j") * 1_000 + F.col("j2")).cast("bigint").alias("j"))


def spatial_points(points: DataFrame, p: Params) -> DataFrame:
    """Points to add so that steps are interpolation_distance long; of more than five parts only the two at either end. A step at walking speed
    or faster is spread evenly over its time; a slower one is walked at the end of its time."""
    d = great_circle(F.col("lat"), F.col("lon"), F.col("n.lat"), F.col("n.lon"))
    q = _steps(points).withColumn("d", d).where(F.col("d") > p.interpolation_distance)
    q = q.withColumn("parts", F.ceil(F.col("d") / p.interpolation_distance))
    j = F.when(F.col("parts") > 5, F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), F.col("parts") - 2, F.col("parts") - 1)).when(F.col("parts") > 1, F.sequence(F.lit(1).cast("bigint"), F.col("parts") - 1))
    share = F.col("j2") / F.col("parts")
    dt = F.col("n.t") - F.col("t")
    even = F.col("t") + share * dt
    walked = F.col("n.t") - (1 - share) * F.col("d") / p.walking_speed
    return _between(q, j, share, F.when(F.col("d") >= dt * p.walking_speed, even).otherwise(walked), 1)


def temporal_points(points: DataFrame, p: Params) -> DataFrame:
    """Points to add so that steps last temporal_gap seconds at most."""
    q = _steps(points).withColumn("dt", F.col("n.t") - F.col("t")).where(F.col("dt") > p.temporal_gap)
    q = q.withColumn("parts", F.ceil(F.col("dt") / p.temporal_gap))
    j = F.when(F.col("parts") > 1, F.sequence(F.lit(1).cast("bigint"), F.col("parts") - 1))
    share = F.col("j2") / F.col("parts")
    return _between(q, j, share, F.col("t") + share * F.col("dt"), 2)


def interpolated(points: DataFrame, added: DataFrame) -> DataFrame:
    return points.unionByName(added, allowMissingColumns=True)


def time_weights(points: DataFrame, p: Params) -> DataFrame:
    """Adds weight: half of the time to each neighbour in the segment, but for steps of weight_cutoff or more between two synthetic points."""
    w = segment_order()

    def half(side) -> Column:
        dt = F.abs(F.col("t") - side("t").over(w))
        counts = (dt < p.weight_cutoff) | ~F.col("synthetic") | ~side("synthetic").over(w)
        return F.coalesce(F.when(counts, dt / 2), F.lit(0.0))

    return points.withColumn("weight", half(F.lag) + half(F.lead))
