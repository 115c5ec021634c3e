"""Cleaning a trace: gates, duplicates, known errors, neighbours and positional outliers.

Tables have (user_id, t, ord, acc, lon, lat); ord decides ties in time.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, great_circle, inner_angle
from ..params import Params

ORDER = ("t", "ord")


def by_time():
    return Window.partitionBy("user_id").orderBy(*ORDER)


def min_points_gate(points: DataFrame, p: Params) -> DataFrame:
    """Users with more than min_points points: counted with partial sums, then a semi-join."""
    enough = points.groupBy("user_id").count().where(F.col("count") > p.min_points)
    return points.join(enough, "user_id", "left_semi")


def known_error(points: DataFrame, p: Params) -> DataFrame:
    """Points with an error of max_accuracy at most."""
    return points.where(F.col("acc") <= p.max_accuracy)


def exact_duplicates(points: DataFrame) -> DataFrame:
    """Of the points of a user with the same place and time, the first in input order."""
    w = Window.partitionBy("user_id", "lon", "lat", "t").orderBy("ord")
    return points.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_geometries(points: DataFrame) -> DataFrame:
    """The first point of each place of a user."""
    w = Window.partitionBy("user_id", "lon", "lat").orderBy(*ORDER)
    return points.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeated_geometries(points: DataFrame) -> DataFrame:
    """Places with more than one point, and how many."""
    return points.groupBy("user_id", "lon", "lat").agg(F.count("*").alias("n")).where("n > 1")


def split_users(points: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the users listed, all others)."""
    return points.join(users, "user_id", "left_semi"), points.join(users, "user_id", "left_anti")


def neighbours(points: DataFrame) -> DataFrame:
    """Adds d_ante and d_post, metres to the nearest different place before and after; angle there; inter, whether both points next to it are at
    the same place. Null on the first and last point; a distance is 0 where a run of equal places touches the trace's end, and the angle is 180."""
    w = by_time()
    same = lambda k: (k("lon").over(w) == F.col("lon")) & (k("lat").over(w) == F.col("lat"))
    q = points.withColumns({"_s": same(F.lag), "_e": same(F.lead)})
    # the last point before the run began, and the first after it ends
    here = F.struct("lon", "lat")
    q = q.withColumns({"_p": F.when(~F.col("_s"), F.lag(here).over(w)), "_n": F.when(~F.col("_e"), F.lead(here).over(w))})
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # looking ahead is looking back in the opposite order: a frame that grows, not one that is gone through for every row
    ahead = Window.partitionBy("user_id").orderBy(*[F.desc(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = q.withColumns({"_p": F.last("_p", ignorenulls=True).over(back), "_n": F.last("_n", ignorenulls=True).over(ahead)})
    inside = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    far = lambda c: F.coalesce(great_circle(F.col("lat"), F.col("lon"), F.col(f"{c}.lat"), F.col(f"{c}.lon")), F.lit(0.0))
    angle = inner_angle(F.col("lat"), F.col("lon"), F.col("_p.lat"), F.col("_p.lon"), F.col("_n.lat"), F.col("_n.lon"))
    return q.withColumns({"d_ante": F.when(inside, far("_p")), "d_post": F.when(inside, far("_n")), "angle": F.when(inside, F.coalesce(angle, F.lit(180.0))), "inter": F.coalesce(F.col("_s") & F.col("_e"), F.lit(False))}).drop("_s", "_e", "_p", "_n")


def sequential_duplicates(points: DataFrame) -> DataFrame:
    """Of a run of equal places the first and the last point."""
    return neighbours(points).where("not inter").drop("d_ante", "d_post", "angle", "inter")


def outlier_candidates(points: DataFrame, p: Params) -> DataFrame:
    """Points that one pass of the outlier rule would remove: there and exactly back, or a sharp turn far from both neighbours."""
    angle, near = F.round("angle", 6), F.least("d_ante", "d_post")
    return neighbours(points).where((angle == 0) | (angle < p.outlier_angle) & (near > p.outlier_distance))


class Chain:
    """One user's points as a linked list with neighbour annotations, which removals refresh just around the gap.

    A run of equal places is known by its first and last point, so a removal costs the same however long a phone lies still, and points that the
    outlier rules ask for wait in two heaps.
    """

    def __init__(self, lat, lon, p: Params):
        n = len(lat)
        self.p, self.n = p, n
        self.lat, self.lon = list(lat), list(lon)
        self.before, self.after = list(range(-1, n - 1)), [*range(1, n), -1][:n]
        self.ante, self.post, self.angle, self.inter, self.gone = [None] * n, [None] * n, [None] * n, [False] * n, [False] * n
        self.run, self.low, self.high = list(range(n)), list(range(n)), list(range(n))
        self.flat, self.sharp = [], []
        for i in range(1, n):
            if self.same(i - 1, i):
                self.run[i] = r = self.run[i - 1]
                self.high[r] = i
        for i in range(1, n - 1):
            self.observe(i)

    def metres(self, i: int, j: int) -> float:
        a, b, d = math.radians(self.lat[i]), math.radians(self.lat[j]), math.radians(self.lon[j] - self.lon[i])
        across, along = math.cos(b) * math.sin(d), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d)
        return RADIUS * math.atan2(math.hypot(across, along), math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(d))

    def course(self, i: int, j: int) -> float:
        """Degrees from 0 up to 360."""
        a, b, d = math.radians(self.lat[i]), math.radians(self.lat[j]), math.radians(self.lon[j] - self.lon[i])
        return (math.degrees(math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))) + 360) % 360

    def same(self, i: int, j: int) -> bool:
        return self.lat[i] == self.lat[j] and self.lon[i] == self.lon[j]

    def run_of(self, i: int) -> int:
        """The number that stands for the run; runs that meet are joined."""
        run = self.run
        while run[i] != i:
            run[i] = run[run[i]]
            i = run[i]
        return i

    def observe(self, i: int) -> None:
        if i < 0 or self.before[i] < 0 or self.after[i] < 0:
            return
        r = self.run_of(i)
        if self.low[r] != i != self.high[r]:
            self.inter[i] = True
        j, k = self.before[self.low[r]], self.after[self.high[r]]
        self.ante[i] = 0.0 if j < 0 else self.metres(i, j)
        self.post[i] = 0.0 if k < 0 else self.metres(i, k)
        if self.ante[i] * self.post[i] == 0:
            self.angle[i] = 180.0
        else:
            turn = abs(self.course(i, j) - self.course(i, k))
            self.angle[i] = min(turn, 360 - turn)
        if self.angle[i] == 0:
            heapq.heappush(self.flat, i)
        elif self.angle[i] < self.p.outlier_angle and min(self.ante[i], self.post[i]) > self.p.outlier_distance:
            heapq.heappush(self.sharp, (self.rank(i), i))

    def rank(self, i: int) -> float:
        """What decides between sharp turns: their order alone, or how sharp and how far they are."""
        return 0.0 if self.p.semantics == "reference" else -min(self.ante[i], self.post[i]) / self.angle[i]

    def remove(self, i: int) -> None:
        p, n, r = self.before[i], self.after[i], self.run_of(i)
        self.gone[i] = True
        if p >= 0:
            self.after[p] = n
        if n >= 0:
            self.before[n] = p
        if self.low[r] == i == self.high[r]:
            if p >= 0 and n >= 0 and self.same(p, n):
                a, b = self.run_of(p), self.run_of(n)
                self.run[b] = a
                self.high[a] = self.high[b]
        elif self.low[r] == i:
            self.low[r] = n
        elif self.high[r] == i:
            self.high[r] = p
        self.observe(p)
        self.observe(n)

    def live(self) -> list[int]:
        return [i for i in range(self.n) if not self.gone[i]]

    def outlier(self) -> int | None:
        """The next point to go: the first that is there and exactly back, else a sharp turn."""
        while self.flat:
            i = self.flat[0]
            if not self.gone[i] and self.angle[i] == 0:
                # a first point that has kept an old angle ends the search, as its place counts as none
                return None if self.before[i] < 0 and self.p.semantics == "reference" else i
            heapq.heappop(self.flat)
        while self.sharp:
            rank, i = self.sharp[0]
            inside = not self.gone[i] and self.before[i] >= 0 and self.after[i] >= 0
            if inside and 0 < self.angle[i] < self.p.outlier_angle and min(self.ante[i], self.post[i]) > self.p.outlier_distance and rank == self.rank(i):
                return i
            heapq.heappop(self.sharp)
        return None


def removals(lat: list[float], lon: list[float], t: list, acc: list[float], p: Params) -> list[str | None]:
    """Why each of a user's points, in order, is removed; None where it stays.

    A step first lists what goes and then removes it from the back, so what its own removals mark waits for the step after it."""
    chain, why = Chain(lat, lon, p), [None] * len(lat)

    def drop(found: list[int], reason: str) -> None:
        for i in reversed(found):
            why[i] = reason
            chain.remove(i)

    seen, again = set(), []
    for i, key in enumerate(zip(lat, lon, t, strict=True)):
        if key in seen:
            again.append(i)
        seen.add(key)
    drop(again, "repeated")
    drop([i for i in chain.live() if acc[i] > p.max_accuracy], "error")
    drop([i for i in chain.live() if chain.inter[i]], "sequence")
    while (i := chain.outlier()) is not None:
        drop([i], "outlier")
    drop([i for i in chain.live() if chain.inter[i]], "sequence")
    return why


def clean_users(points: DataFrame, p: Params) -> DataFrame:
    """All cleaning steps of a user in one pass, with removed_by (null where a point stays): repeated, error, sequence, outlier.

    The steps share annotations that a removal refreshes only next to it, so a later step may see what an earlier one left behind; that is why
    they run together, on one user's points in memory, as a grouped function on Arrow batches. Its time grows with the points and the logarithm
    of the outliers.
    """
    names = [f.name for f in points.schema.fields]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "ord"], kind="stable").reset_index(drop=True)
        why = removals(*(frame[c].tolist() for c in ("lat", "lon", "t", "acc")), p)
        return frame.assign(removed_by=np.array(why, dtype=object))[[*names, "removed_by"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields) + ", removed_by string"
    return points.groupBy("user_id").applyInPandas(one, schema)
