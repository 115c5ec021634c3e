"""Travelling or at a location: emission and transition probabilities, and the most likely states."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, great_circle
from ..params import Params
from .segment import segment_order

STAY, LEAVE, ARRIVE, NEVER = 0.95, 0.05, 0.5, -100.0


def speed(side, w) -> Column:
    """Metres a second to a neighbour; points at the same time count a second."""
    d = great_circle(F.col("lat"), F.col("lon"), side("lat").over(w), side("lon").over(w))
    dt = F.abs(F.col("t") - side("t").over(w))
    return d / F.when(dt == 0, 1.0).otherwise(dt)


def travel_emission(points: DataFrame) -> DataFrame:
    """Adds travel_emit: log(1 - exp(-v / 2)) for the mean speed v to both neighbours; -100 without motion, log(1/4) at a segment's ends."""
    w = segment_order()
    v = (speed(F.lag, w) + speed(F.lead, w)) / 2
    return points.withColumn("travel_emit", F.when(v.isNull(), math.log(0.25)).when(v > 0, F.log(-F.expm1(-v / 2))).otherwise(NEVER))


def location_emission(metres: Column, p: Params) -> Column:
    """Log of a Gaussian of the distance, up to a constant."""
    return -metres * metres / (2 * p.emission_bandwidth**2)


def transition(a: Column, b: Column, states: Column) -> Column:
    """Log-probability of going from state a to state b of so many states (0 is travel)."""
    return (
        F.when((a == 0) & (b == 0), math.log(STAY))
        .when(a == 0, F.log(F.lit(LEAVE) / states))
        .when((b == 0) | (a == b), math.log(ARRIVE))
        .otherwise(NEVER)
    )


def transition_matrix(states: int) -> np.ndarray:
    out = np.full((states, states), NEVER)
    out[0, :] = math.log(LEAVE / states)
    out[:, 0] = math.log(ARRIVE)
    np.fill_diagonal(out, math.log(ARRIVE))
    out[0, 0] = math.log(STAY)
    return out


def start_probabilities(states: int) -> np.ndarray:
    """Travel one half; each location a half divided by the number of states, which doesn't sum to one."""
    return np.array([math.log(0.5)] + [math.log(0.5 / states)] * (states - 1))


def viterbi(emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best path through rows of emissions; of equal ones the highest state, at each step and at the end."""
    n, s = emit.shape
    back = np.zeros((n, s), dtype=np.int64)
    best = start + emit[0]
    for t in range(1, n):
        through = best[:, None] + move
        back[t] = s - 1 - through[::-1].argmax(0)
        best = through[back[t], np.arange(s)] + emit[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = s - 1 - best[::-1].argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def metres(lat, lon, lats, lons) -> np.ndarray:
    a, b, d = np.radians(lat)[:, None], np.radians(lats)[None], np.radians(lons[None] - lon[:, None])
    across, along = np.cos(b) * np.sin(d), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d)
    return RADIUS * np.arctan2(np.sqrt(across**2 + along**2), np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(d))


def states(points: DataFrame, locations: DataFrame, p: Params) -> DataFrame:
    """Adds state to points with travel_emit: 0 for travel, else the location_id. A user's points and locations meet in one grouped function, each
    sent once; a segment is decoded in memory, as each step depends on the one before. A user without locations travels."""
    names = points.columns

    def decoded(frame: pd.DataFrame, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
        d = metres(frame["lat"].to_numpy(float), frame["lon"].to_numpy(float), lats, lons)
        emit = np.column_stack([frame["travel_emit"].to_numpy(float), -(d**2) / (2 * p.emission_bandwidth**2)])
        return viterbi(emit, start_probabilities(emit.shape[1]), transition_matrix(emit.shape[1]))

    def one(frame: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame({c: [] for c in [*names, "state"]})
        frame = frame.sort_values(["known_subset", "t", "synthetic", "ord", "j"], kind="stable").reset_index(drop=True)
        places = places.sort_values("location_id")
        ids = np.append(0, places["location_id"].to_numpy(np.int32))
        parts = [decoded(x, places["lat"].to_numpy(float), places["lon"].to_numpy(float)) for _, x in frame.groupby("known_subset", dropna=False, sort=False)]
        return frame.assign(state=ids[np.concatenate(parts)].astype(np.int32))[[*names, "state"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields) + ", state int"
    found = locations.select("user_id", "location_id", "lat", "lon")
    return points.groupBy("user_id").cogroup(found.groupBy("user_id")).applyInPandas(one, schema)
