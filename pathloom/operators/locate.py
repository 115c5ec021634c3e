"""Activity locations: weighted density, its peaks, and the names of the places nearest to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle
from ..params import Params


def rms_accuracy(points: DataFrame) -> DataFrame:
    """(user_id, rms): root mean square of the reported errors."""
    return points.groupBy("user_id").agg(F.sqrt(F.avg(F.col("acc") * F.col("acc"))).alias("rms"))


def peak_threshold(rms: Column, total: Column, p: Params) -> Column:
    """The density that minimum_activity seconds at one place reach, half a metre off it; null for a total no longer than that."""
    v = rms * rms + p.kernel_bandwidth**2
    return F.when(total > p.minimum_activity, F.exp(-0.25 / v) / (2 * math.pi * v) * p.minimum_activity / total)


#: Bins a bandwidth where weights are summed in bins.
BINS = 10


def kde(points: DataFrame, p: Params) -> DataFrame:
    """(user_id, lon, lat, x, y, kde): the density of the weights at each different place, per square metre.

    Weights are summed by place first. Kernels reach kde_cells bandwidths, beyond which they are below 2e-22 of their peak: places meet by grid
    cells of that size, each place at its own cell and those around, so no user's places are crossed as a whole. Of a user with more than kde_limit
    points the weights are summed in bins of a BINS-th of the bandwidth, at their mean place, before places meet: a cell then has a bounded number
    of sources however many places it has, and each source's kernel is off by 1 / (4 * BINS**2) of its peak at most.
    """
    reach, bin_ = p.kernel_bandwidth * p.kde_cells, p.kernel_bandwidth / BINS
    at = points.groupBy("user_id", "lon", "lat").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("weight").alias("w"), F.count("*").alias("n"))
    total = at.groupBy("user_id").agg(F.sum("w").alias("total"), (F.sum("n") > p.kde_limit).alias("large"))
    bins = lambda c: F.when(F.col("large"), F.floor(F.col(c) / bin_).cast("double")).otherwise(F.col(c))
    mean = lambda c: F.when(F.first("large"), F.sum(F.col("w") * F.col(c)) / F.sum("w")).otherwise(F.first(c))
    source = at.where("w > 0").join(total, "user_id").groupBy("user_id", bins("x").alias("bx"), bins("y").alias("by")).agg(mean("x").alias("sx"), mean("y").alias("sy"), F.sum("w").alias("w"))
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    source = source.select("user_id", "sx", "sy", "w", F.explode(F.transform(steps, lambda d: F.floor(F.col("sx") / reach) + d)).alias("i"))
    source = source.select("*", F.explode(F.transform(steps, lambda d: F.floor(F.col("sy") / reach) + d)).alias("k"))
    square = (F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2
    h2 = p.kernel_bandwidth**2
    term = F.when(square <= reach * reach, F.col("w") * F.exp(-square / (2 * h2)))
    where = at.select("user_id", "lon", "lat", "x", "y", F.floor(F.col("x") / reach).alias("i"), F.floor(F.col("y") / reach).alias("k"))
    sums = where.join(source, ["user_id", "i", "k"]).groupBy("user_id", "lon", "lat", "x", "y").agg(F.sum(term).alias("s"))
    return sums.join(total, "user_id").select("user_id", "lon", "lat", "x", "y", (F.coalesce("s", F.lit(0.0)) / (F.col("total") * 2 * math.pi * h2)).alias("kde"))


def peaks(density: DataFrame, p: Params) -> DataFrame:
    """Rows of (user_id, lon, lat, kde, threshold, ...) at or above their threshold with no higher one within location_distance. Densities that
    differ in the last bits alone are equal.

    Only the highest rows of a cell so small that all in it are near each other can be peaks. These few are compared with all rows around them, so
    a cell with very many rows costs as many comparisons, not their square."""
    high = density.where(F.col("kde") >= F.col("threshold")).withColumn("h", F.round(F.col("kde") * 1e9, 6))
    small = p.location_distance / 160_000
    top = high.withColumn("_top", F.max("h").over(Window.partitionBy("user_id", F.floor(F.col("lat") / small), F.floor(F.col("lon") / small)))).where("h = _top").drop("_top")
    tall, wide = p.location_distance / 111_000, p.location_distance / 44_000
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    cell = {"i": F.floor(F.col("lat") / tall), "k": F.floor(F.col("lon") / wide)}
    around = top.withColumns(cell).select("user_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("h").alias("h1"), F.explode(F.transform(steps, lambda d: F.col("i") + d)).alias("i"), "k")
    around = around.select("user_id", "lon1", "lat1", "h1", "i", F.explode(F.transform(steps, lambda d: F.col("k") + d)).alias("k"))
    near = great_circle(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")) <= p.location_distance
    lower = around.join(high.withColumns(cell).select("user_id", "lon", "lat", "h", "i", "k"), ["user_id", "i", "k"]).where((F.col("h") > F.col("h1")) & near)
    lower = lower.select("user_id", F.col("lon1").alias("lon"), F.col("lat1").alias("lat")).distinct()
    return top.join(lower, ["user_id", "lon", "lat"], "left_anti").drop("h")


def numbered(found: DataFrame, order: list[str]) -> DataFrame:
    """Adds location_id, from 1 in the order given within a user."""
    return found.withColumn("location_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def nearest_named(places: DataFrame, locations: DataFrame, p: Params) -> DataFrame:
    """(user_id, name, location_id, metres): for each named place the nearest location within naming_radius; of equals the lowest id."""
    b = locations.select("user_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "location_id")
    q = places.join(b, "user_id").withColumn("metres", F.round(great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6))
    best = q.groupBy("user_id", "name").agg(F.min(F.struct("metres", "location_id")).alias("b"))
    return best.where(F.col("b.metres") <= p.naming_radius).select("user_id", "name", "b.location_id", "b.metres")


#: The order in which a location's names are joined, and in which they decide an episode's type.
NAMES = ("home", "work", "school")


def location_names(named: DataFrame) -> DataFrame:
    """(user_id, location_id, names): the names of each location, home before work before school."""
    each = named.groupBy("user_id", "location_id").agg(F.collect_set("name").alias("_n"))
    return each.select("user_id", "location_id", F.filter(F.array(*map(F.lit, NAMES)), lambda n: F.array_contains("_n", n)).alias("names"))
