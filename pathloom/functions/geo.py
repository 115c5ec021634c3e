"""Geometry as column expressions: great circles, bearings, angles and the Statistics Canada Lambert projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth, metres.
RADIUS = 6_371_009.0
# EPSG:3347 on GRS80 (degrees and metres).
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257222101
LAT_ORIGIN, LON_ORIGIN, PARALLEL_1, PARALLEL_2 = 63.390675, -91.86666666666666, 49.0, 77.0
FALSE_EAST, FALSE_NORTH = 6_200_000.0, 3_000_000.0
ECCENTRICITY = math.sqrt(2 * FLATTENING - FLATTENING**2)


def _narrowing(phi: float) -> float:
    es = ECCENTRICITY * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (ECCENTRICITY / 2)


def _width(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (ECCENTRICITY * math.sin(phi)) ** 2)


_p1, _p2 = math.radians(PARALLEL_1), math.radians(PARALLEL_2)
CONE = (math.log(_width(_p1)) - math.log(_width(_p2))) / (math.log(_narrowing(_p1)) - math.log(_narrowing(_p2)))
SCALE = _width(_p1) / (CONE * _narrowing(_p1) ** CONE)
RHO_ORIGIN = AXIS * SCALE * _narrowing(math.radians(LAT_ORIGIN)) ** CONE


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees, in the form that stays exact for near and for opposite points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    across = F.cos(b) * F.sin(d)
    along = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return RADIUS * F.atan2(F.sqrt(across * across + along * along), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees of the initial course from the first point to the second, from -180 to 180."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def inner_angle(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees, 0 to 180, between the courses from a point to two others."""
    turn = F.pmod(bearing(lat, lon, lat1, lon1) - bearing(lat, lon, lat2, lon2), F.lit(360.0))
    return F.least(turn, F.lit(360.0) - turn)


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres."""
    es = ECCENTRICITY * F.sin(F.radians(lat))
    t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - es) / (1 + es), F.lit(ECCENTRICITY / 2))
    rho = AXIS * SCALE * F.pow(t, F.lit(CONE))
    theta = CONE * F.radians(lon - LON_ORIGIN)
    return FALSE_EAST + rho * F.sin(theta), FALSE_NORTH + RHO_ORIGIN - rho * F.cos(theta)


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees; the latitude by six rounds of its fixed-point equation, after which nothing changes in a double."""
    east, north = x - FALSE_EAST, RHO_ORIGIN - (y - FALSE_NORTH)
    t = F.pow(F.sqrt(east * east + north * north) / (AXIS * SCALE), F.lit(1 / CONE))
    state = math.pi / 2 - 2 * F.atan(t)

    def round_(phi: Column, _: Column) -> Column:
        es = ECCENTRICITY * F.sin(phi)
        return math.pi / 2 - 2 * F.atan(t * F.pow((1 - es) / (1 + es), F.lit(ECCENTRICITY / 2)))

    # a fold rather than six nested copies: each round uses its argument once, and so does the plan
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), state, round_)
    return F.degrees(F.atan2(east, north)) / CONE + LON_ORIGIN, F.degrees(phi)
