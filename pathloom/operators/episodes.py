"""Episodes: construction from states, types, durations, and the removal of short stops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from .locate import NAMES
from .segment import segment_order


def state_changes(points: DataFrame) -> DataFrame:
    """(user_id, start, location_id, unknown) of points with state: an episode begins with a segment, midway between two states, and, unknown, with
    the last point of a segment. location_id is null when travelling or unknown."""
    w = segment_order()
    q = points.withColumns({"before": F.lag("state").over(w), "t0": F.lag("t").over(w), "last": F.lead("t").over(w).isNull()})
    place = F.when(F.col("state") > 0, F.col("state"))
    begins = q.where("before is null or before <> state").select("user_id", F.when(F.col("before").isNull(), F.col("t")).otherwise(F.col("t0") + (F.col("t") - F.col("t0")) / 2).cast("double").alias("start"), place.alias("location_id"), F.lit(False).alias("unknown"))
    ends = q.where("last").select("user_id", F.col("t").cast("double").alias("start"), F.lit(None).cast("int").alias("location_id"), F.lit(True).alias("unknown"))
    return begins.unionByName(ends)


#: Ties in time keep the order in which episodes are made: what is known before what isn't.
def episode_order():
    return Window.partitionBy("user_id").orderBy("start", "unknown", F.col("location_id").asc_nulls_first())


def episode_type(unknown: Column, location: Column, names: Column) -> Column:
    """unknown, travel, the first of home, work and school among the names, or other."""
    out = F.when(unknown, "unknown").when(location.isNull(), "travel")
    for n in NAMES:
        out = out.when(F.array_contains(names, n), n)
    return out.otherwise("other")


def with_types(episodes: DataFrame, names: DataFrame) -> DataFrame:
    q = episodes.join(names, ["user_id", "location_id"], "left")
    return q.withColumn("type", episode_type(F.col("unknown"), F.col("location_id"), F.coalesce("names", F.array().cast("array<string>")))).drop("names")


def with_durations(episodes: DataFrame) -> DataFrame:
    """Adds sequence, from 0, and duration: the time to the next episode, null for the last."""
    w = episode_order()
    return episodes.withColumns({"sequence": F.row_number().over(w) - 1, "duration": F.lead("start").over(w) - F.col("start")})


def short_stops(episodes: DataFrame, p: Params) -> DataFrame:
    """Episodes at a location that are shorter than minimum_activity, but for a user's last."""
    return with_durations(episodes).where(~F.col("type").isin("unknown", "travel") & (F.col("duration") < p.minimum_activity))


def collapse(starts: list[float], types: list[str], p: Params) -> tuple[list[int], list[float]]:
    """(the episodes that stay, in order, and the start of every one): the first short stop dissolves until none is left.

    Between two episodes of one type both it and the next go; else the next begins later by half of what went, and with semantics "corrected"
    in the middle of it. A first episode just goes.
    """
    start = list(starts)
    live = list(range(len(start)))
    while True:
        live.sort(key=lambda e: start[e])
        at = next((i for i in range(len(live) - 1) if types[live[i]] not in ("unknown", "travel") and start[live[i + 1]] - start[live[i]] < p.minimum_activity), None)
        if at is None:
            return live, start
        if at == 0:
            del live[0]
        elif types[live[at - 1]] == types[live[at + 1]]:
            del live[at : at + 2]
        else:
            half = (start[live[at + 1]] - start[live[at]]) / 2
            start[live[at + 1]] += half if p.semantics == "reference" else -half
            del live[at]


def without_short_stops(episodes: DataFrame, p: Params) -> DataFrame:
    """Episodes (with type) after the collapse, with sequence, duration and linked_duration: the latter ends where the episode that came next before
    any removal begins now, even if that one has gone. A user's episodes are few; each removal depends on those before it."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sequence", kind="stable").reset_index(drop=True)
        live, start = collapse(frame["start"].tolist(), frame["type"].tolist(), p)
        linked = [start[e + 1] - start[e] if e + 1 < len(start) else None for e in live]
        out = frame.iloc[live].assign(start=[start[e] for e in live], sequence=range(len(live)), linked_duration=pd.Series(linked, index=live, dtype="float64"))
        return out.assign(duration=out["start"].shift(-1) - out["start"])[["user_id", "sequence", "start", "location_id", "unknown", "type", "duration", "linked_duration"]]

    kind = episodes.schema["user_id"].dataType.simpleString()
    schema = f"user_id {kind}, sequence int, start double, location_id int, unknown boolean, type string, duration double, linked_duration double"
    q = with_durations(episodes).select("user_id", "sequence", "start", "location_id", "unknown", "type")
    out = q.groupBy("user_id").applyInPandas(one, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("duration", "linked_duration")})


def location_dwell(episodes: DataFrame, column: str = "duration") -> DataFrame:
    """(user_id, location_id, seconds)."""
    return episodes.where("location_id is not null").groupBy("user_id", "location_id").agg(F.sum(F.coalesce(column, F.lit(0.0))).alias("seconds"))


def used_locations(points: DataFrame) -> DataFrame:
    """Locations that some point is classified to."""
    return points.where("state > 0").select("user_id", F.col("state").alias("location_id")).distinct()
