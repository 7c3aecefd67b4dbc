"""Wind profiles as documents: grids of along, cross and vertical wind over height and range, checked, sampled, converted.

A profile is JSON text in a column. Checks come in a fixed order and the first that fails names itself.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of a profile, all of which it must have (the last three may be null); its version and frame.
KEYS = ["schemaVersion", "frame", "azimuthDeg", "rangesYards", "heightsAglFt", "uFps", "vFps", "wFps", "source", "terrainResolutionM", "windSourceResolutionM", "confidence"]
VERSION, FRAME = 1, "shooter"

#: Vertical wind that still counts as none (ft/s), and how far two bearings may lie apart (degrees).
STILL, TOLERANCE_DEG = 1e-6, 1.0

#: Limits of components (ft/s), ranges (yards), heights (feet), resolutions (metres) and the length of the source's name.
MOST_FPS, RANGE_LIMITS, HEIGHT_LIMITS, MOST_RESOLUTION_M, SOURCE_CHARS = 300, (0, 20000), (-1000, 30000), 100000, 200


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _axis(x, limits: tuple) -> str | None:
    """Entry by entry: a number, above the one before, within the limits."""
    if not isinstance(x, list) or not x:
        return "malformed-axis"
    for i, v in enumerate(x):
        if not _number(v) or (i and not v > x[i - 1]):
            return "malformed-axis"
        if not limits[0] <= v <= limits[1]:
            return "out-of-range"
    return None


def _grid(g, rows: int, columns: int) -> str | None:
    """Row by row, entry by entry; null stands for zeros."""
    if g is None:
        return None
    if not isinstance(g, list) or len(g) != rows:
        return "malformed-grid"
    for r in g:
        if not isinstance(r, list) or len(r) != columns:
            return "malformed-grid"
        for x in r:
            if not _number(x):
                return "malformed-grid"
            if abs(x) > MOST_FPS:
                return "out-of-range"
    return None


def failure(text: str | None, azimuth: float | None = None) -> str | None:
    """The code of the first rule that a profile breaks, or None. ``azimuth``: the direction that it will be used in."""
    try:
        p = json.loads(text) if text is not None else None
    except ValueError:
        p = None
    if not isinstance(p, dict):
        return "not-an-object"
    if "schemaVersion" not in p:
        return "missing-field"
    if isinstance(p["schemaVersion"], bool) or p["schemaVersion"] != VERSION:
        return "unsupported-version"
    if any(k not in p for k in KEYS):
        return "missing-field"
    if any(k not in KEYS for k in p):
        return "unknown-field"
    if p["frame"] != FRAME:
        return "unsupported-frame"
    for k, limits in (("rangesYards", RANGE_LIMITS), ("heightsAglFt", HEIGHT_LIMITS)):
        if code := _axis(p[k], limits):
            return code
    for k in ("uFps", "vFps", "wFps"):
        if code := _grid(p[k], len(p["heightsAglFt"]), len(p["rangesYards"])):
            return code
    if p["wFps"] is not None and any(abs(x) > STILL for r in p["wFps"] for x in r):
        return "unsupported-vertical-wind"
    if not isinstance(p["source"], str) or not p["source"].strip() or len(p["source"]) > SOURCE_CHARS:
        return "malformed-field"
    for k in KEYS[9:]:
        if p[k] is not None and not (_number(p[k]) and (0 <= p[k] <= 1 if k == "confidence" else 0 < p[k] <= MOST_RESOLUTION_M)):
            return "out-of-range"
    if not _number(p["azimuthDeg"]) or not 0 <= p["azimuthDeg"] <= 360:
        return "out-of-range"
    if azimuth is not None:
        if not _number(azimuth):
            return "azimuth-missing"
        if not 0 <= azimuth <= 360:
            return "out-of-range"
        if abs((azimuth - p["azimuthDeg"] + 180) % 360 - 180) > TOLERANCE_DEG:
            return "azimuth-mismatch"
    return None


def validated(df: DataFrame, profile: str = "profile", azimuth: str | None = None) -> DataFrame:
    """Adds ``code``; null: the profile is good."""

    @F.pandas_udf("string")
    def check(text: pd.Series, az: pd.Series) -> pd.Series:
        return pd.Series([failure(t, None if azimuth is None else a) for t, a in zip(text, az)])

    return df.withColumn("code", check(profile, F.col(azimuth) if azimuth else F.lit(None).cast("double")))


def sampled(grid: str, heights: str, ranges: str, height, at) -> Column:
    """Bilinear value of an array<array<double>> [height][range] at a height and range; flat beyond its edges."""

    def cell(axis: str, x: Column) -> tuple[Column, Column]:
        n = F.size(axis)
        i = F.greatest(F.least(F.size(F.filter(axis, lambda v: v <= x)) - 1, n - 2), F.lit(0))
        a, b = F.get(F.col(axis), i), F.get(F.col(axis), F.least(i + 1, n - 1))
        t = F.when(b > a, F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return i, t

    i, s = cell(heights, F.col(height) if isinstance(height, str) else height)
    j, t = cell(ranges, F.col(at) if isinstance(at, str) else at)
    i2, j2 = F.least(i + 1, F.size(heights) - 1), F.least(j + 1, F.size(ranges) - 1)
    v = lambda a, b: F.get(F.get(F.col(grid), a), b)
    return (v(i, j) * (1 - t) + v(i, j2) * t) * (1 - s) + (v(i2, j) * (1 - t) + v(i2, j2) * t) * s


def nested(rows: DataFrame, by: list[str], height: str, at: str, values: list[str]) -> DataFrame:
    """Rows (height, range, values) of a plane as arrays [height][range], and both axes."""
    line = rows.groupBy(*by, height).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("r"), *values))).alias("l"))
    g = line.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(height).alias("h"), "l"))).alias("g"))
    pick = lambda v: F.transform("g", lambda x: F.transform(x["l"], lambda y: y[v]))
    return g.select(*by, F.transform("g", lambda x: x["h"]).alias("heights"), F.transform(F.get(F.col("g"), F.lit(0))["l"], lambda y: y["r"]).alias("ranges"), *[pick(v).alias(v) for v in values])


def in_feet(grid: str) -> Column:
    """Metres (a second) as feet (a second)."""
    return F.transform(grid, lambda row: F.transform(row, lambda x: x / 0.3048))
