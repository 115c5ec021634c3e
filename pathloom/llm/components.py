"""Connected components of a link table by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of links (a, b) the smallest node that it reaches.

    Alternating large-star and small-star steps: every node passes its larger, then its smaller neighbours on to the least it knows. The number of
    rounds grows with the logarithm of the longest chain; each round's links are written to the shared folder. Aggregates have partial
    sums on the map side, and the joins are plain equi-joins that Spark may split, so a hub with very many links is no task's own.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        # large star: each neighbour above u goes to the least node known around u
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        remove(edges)
        edges = new
        if same:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
