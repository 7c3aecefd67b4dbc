"""Bearings, wind components and rounding as column expressions. Bearings are degrees clockwise from north, wind is named by where it comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def wrap360(a) -> Column:
    """Into [0, 360)."""
    return F.pmod(col(a).cast("double"), F.lit(360.0))


def signed_gap(a, b) -> Column:
    """a - b the short way round, in (-180, 180]."""
    d = (col(a) - col(b)) % F.lit(360.0)
    return F.when(d > 180, d - 360).when(d <= -180, d + 360).otherwise(d)


def half_open_gap(a, b) -> Column:
    """a - b the short way round, in [-180, 180)."""
    return F.pmod(col(a) - col(b) + F.lit(180.0), F.lit(360.0)) - 180


def unsigned_gap(a, b) -> Column:
    """The angle between two bearings, 0 to 180."""
    return F.abs(signed_gap(a, b))


def east(speed, from_deg) -> Column:
    return -col(speed) * F.sin(F.radians(col(from_deg)))


def north(speed, from_deg) -> Column:
    return -col(speed) * F.cos(F.radians(col(from_deg)))


def bearing_from(e, n, still: float | None = None) -> Column:
    """Where a wind of these components comes from; ``still`` is the answer for the zero vector."""
    return F.when((col(e) == 0) & (col(n) == 0), F.lit(still).cast("double")).otherwise(wrap360(F.degrees(F.atan2(-col(e), -col(n)))))


def circular_mean(d) -> Column:
    """Aggregate: circular mean of signed differences; null for none, or where they cancel."""
    s, c = F.sum(F.sin(F.radians(col(d)))), F.sum(F.cos(F.radians(col(d))))
    return F.when((F.abs(s) < 1e-12) & (F.abs(c) < 1e-12), F.lit(None).cast("double")).otherwise(F.degrees(F.atan2(s, c)))


def round_up(x, places: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    p = float(10**places)
    return F.floor(col(x) * p + 0.5) / p


#: The sixteen points of the compass.
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def compass_point(d) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.floor(col(d) / 22.5 + 0.5), F.lit(16)) + 1).cast("int"))


def grid_to_earth(e, n, lon, lon0: float, cone: float) -> tuple[Column, Column]:
    """Rotates components along the axes of a conic grid to east and north."""
    b = F.radians(signed_gap(lon, lon0) * cone)
    return col(e) * F.cos(b) + col(n) * F.sin(b), col(n) * F.cos(b) - col(e) * F.sin(b)
