"""Distances and bearings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_MILES = 3958.8
EARTH_KM = 6371.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def half_chord_square(lat1, lon1, lat2, lon2, cos1=None, cos2=None) -> Column:
    """Square of half the chord on the unit sphere; ``cos1`` and ``cos2`` are the cosines of the latitudes where known."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    cos1, cos2 = (F.cos(F.radians(lat)) if known is None else _col(known) for lat, known in ((lat1, cos1), (lat2, cos2)))
    return F.pow(half_lat, 2) + cos1 * cos2 * F.pow(half_lon, 2)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_MILES, form: str = "atan2", cos1=None, cos2=None) -> Column:
    """Great-circle distance; ``form`` is ``atan2`` or ``asin`` (same value, different rounding)."""
    a = half_chord_square(lat1, lon1, lat2, lon2, cos1, cos2)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    angle = F.asin(F.sqrt(a)) if form == "asin" else F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return 2 * radius * angle


def bearing(lat1, lon1, lat2, lon2, known=None) -> Column:
    """Initial bearing in degrees, 0 is north, clockwise; ``known`` are sine and cosine of both latitudes, in order."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    d = F.radians(lon2 - lon1)
    sin1, cos1, sin2, cos2 = map(_col, known or (f(F.radians(x)) for x in (lat1, lat2) for f in (F.sin, F.cos)))
    y = F.sin(d) * cos2
    x = cos1 * sin2 - sin1 * cos2 * F.cos(d)
    turn = F.degrees(F.atan2(y, x)) + 360  # 180 to 540
    return F.when(turn >= 360, turn - 360).otherwise(turn)


def degree_distance(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def rounded(col, digits: int) -> Column:
    """``round`` without a decimal per row, except close to a tie (there it is ``round`` itself): the same doubles."""
    x = _col(col)
    scaled = x * 10.0**digits
    near = F.rint(scaled)
    clear = (F.abs(scaled - near) < 0.499) & (F.abs(scaled) < 1e12)
    return F.when(clear, near / 10.0**digits + F.lit(0.0)).otherwise(F.round(x, digits))


def width_bin(col, width: float) -> Column:
    """Right-closed bucket of equal width; nothing at or below zero."""
    x = _col(col)
    return F.when(x > 0, F.ceil(x / width)).cast("long")
