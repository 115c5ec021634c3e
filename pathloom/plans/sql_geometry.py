"""Great circles, courses and the projection as SQL text."""

from __future__ import annotations

import math

from ..functions import geo


def metres_sql(a: str, b: str) -> str:
    """Great-circle metres between a.lat, a.lon and b.lat, b.lon."""
    p, q, e = f"radians({a}.lat)", f"radians({b}.lat)", f"radians({b}.lon - {a}.lon)"
    return f"{geo.RADIUS}::double * atan2(sqrt(pow(cos({q})*sin({e}), 2) + pow(cos({p})*sin({q}) - sin({p})*cos({q})*cos({e}), 2)), sin({p})*sin({q}) + cos({p})*cos({q})*cos({e}))"


def course_sql(a: str, b: str) -> str:
    p, q, e = f"radians({a}.lat)", f"radians({b}.lat)", f"radians({b}.lon - {a}.lon)"
    return f"degrees(atan2(sin({e})*cos({q}), cos({p})*sin({q}) - sin({p})*cos({q})*cos({e})))"


_ES = f"({geo.ECCENTRICITY!r}::double * sin(radians(lat)))"
RHO = f"({geo.AXIS * geo.SCALE!r}::double * pow(tan({math.pi / 4!r}::double - radians(lat)/2) / pow((1-{_ES})/(1+{_ES}), {geo.ECCENTRICITY / 2!r}::double), {geo.CONE!r}::double))"
THETA = f"({geo.CONE!r}::double * radians(lon - ({geo.LON_ORIGIN!r})::double))"
