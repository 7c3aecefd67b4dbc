"""Lines through a field: stations on a geodesic by a table function joined laterally, the wind resolved onto the line, planes over heights, published profiles.

A line is a row (line_id, lat, lon, bearing, length, step). What can't be walked or leaves the field is a row that says so (``code``), so that one bad
line doesn't end the others. Stations of a line are spread over tasks with the cells they are read from; only a profile gathers
a line, whose arrays are its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import geo as G
from . import resample
from .contracts import in_feet, nested

#: Metres of a yard and a foot, roughness when none is given.
YARD_M, FOOT_M, ROUGHNESS_M = 0.9144, 0.3048, 0.03
#: Stations that a line may have.
MOST_STATIONS = 1_000_000


class Walk:
    """Rows (dist, lat, lon, bearing, code) of one line: every step from the start, and the end; one row with a code if there is no such line."""

    def eval(self, lat: float, lon: float, bearing: float, length: float, step: float):
        import math

        import numpy as np

        from gustfield.operators.kernels import direct

        def bad(*values):
            return any(v is None or not math.isfinite(v) for v in values)

        code = None
        if bad(lat, lon) or abs(lat) > 90:
            code = "bad-origin"
        elif bad(bearing):
            code = "bad-bearing"
        elif bad(length) or length <= 0:
            code = "bad-length"
        elif bad(step) or step <= 0 or length / step > MOST_STATIONS:
            code = "bad-step"
        if code:
            yield None, None, None, None, code
            return
        n = math.ceil(length / step)
        d = np.append(np.arange(n) * step, length)
        if n > 1 and d[-2] >= length:
            d = np.delete(d, -2)
        one = np.ones(len(d))
        for dist, la, lo, br in zip(d.tolist(), *(a.tolist() for a in direct(lat * one, lon * one, bearing * one, d))):
            yield dist, la, lo, br, None


def stations(lines: DataFrame) -> DataFrame:
    """``lines`` joined laterally with their stations: line_id, dist, lat, lon, bearing (the line's own there), code."""
    walk = F.udtf(Walk, returnType="dist double, lat double, lon double, bearing double, code string")
    args = [F.col(f"l.{c}").cast("double").outer() for c in ("lat", "lon", "bearing", "length", "step")]
    return lines.alias("l").lateralJoin(walk(*args).alias("s")).select("l.line_id", "s.*")


def transect(lines: DataFrame, cells: DataFrame, place: resample.Grid) -> DataFrame:
    """Stations with the field's wind and ground there: east, north, speed, from_deg, along (with the line), cross (to its right), z; ``code`` (outside-domain: no wind there).

    ``cells`` has row, col, east, north, z. The wind is resolved onto the line's bearing at the station, not onto the one it set out with.
    """
    c, b = F.col, F.radians("bearing")
    got = resample.at(stations(lines), place, cells, ["east", "north", "z"])
    here = c("east").isNotNull() & c("north").isNotNull()
    got = got.withColumns({"code": F.coalesce("code", F.when(~here, "outside-domain")), "east": F.when(here, c("east")), "north": F.when(here, c("north"))})
    return got.withColumns({"speed": F.hypot("east", "north"), "from_deg": A.bearing_from("east", "north", 0.0), "along": c("east") * F.sin(b) + c("north") * F.cos(b), "cross": c("east") * F.cos(b) - c("north") * F.sin(b)})


def convergence(lines: DataFrame, line: DataFrame) -> DataFrame:
    """line_id, stations, ``code`` (the first station's that has one) and ``convergence``: how far the line has turned at its end."""
    last = line.groupBy("line_id").agg(F.count("*").alias("stations"), F.max_by("bearing", "dist").alias("_end"), F.min_by("code", F.when(F.col("code").isNotNull(), F.coalesce("dist", F.lit(-1.0)))).alias("code"))
    return last.join(lines.select("line_id", F.col("bearing").alias("_start")), "line_id").select("line_id", "stations", "code", A.signed_gap("_end", "_start").alias("convergence"))


def plane_code(heights: Column, from_height: float | None, roughness: float) -> Column:
    """Why heights (an array) give no plane: null if they do."""
    ascends = F.forall(F.sequence(F.lit(1), F.greatest(F.size(heights) - 1, F.lit(1))), lambda i: (F.size(heights) < 2) | (F.get(heights, i) > F.get(heights, i - 1)))
    reference = F.lit(None if from_height is None else float(from_height)).cast("double")
    return (
        F.when(heights.isNull() | (F.size(heights) < 1) | ~F.coalesce(ascends, F.lit(False)), "bad-heights")
        .when(reference.isNull() | ~(reference > 0), "no-height")
        .when(~F.lit(roughness > 0), "bad-roughness")
        .when(~(reference > roughness) | F.exists(heights, lambda h: ~(h > roughness)), "bad-height")
    )


def plane(line: DataFrame, heights: list[float], from_height: float | None = 10.0, roughness: float = ROUGHNESS_M) -> DataFrame:
    """A transect at several heights: one row for each station and height, with ``factor`` (logarithmic profile) on along, cross and speed, and up = 0.

    Heights that don't ascend or don't clear the roughness, and a field without a height, give rows with a code and no values.
    """
    c, asked = F.col, F.array(*[F.lit(float(h)) for h in heights]).cast("array<double>")
    rows = line.withColumn("code", F.coalesce("code", plane_code(asked, from_height, roughness))).withColumn("height", F.explode_outer(asked))
    factor = F.when(c("code").isNull(), G.log_factor("height", F.lit(from_height).cast("double"), F.lit(roughness)))
    rows = rows.withColumn("factor", factor)
    return rows.select("line_id", "dist", "lat", "lon", "bearing", "height", "code", "factor", *[(c(k) * c("factor")).alias(k) for k in ("along", "cross", "speed")], F.when(c("code").isNull(), F.lit(0.0)).alias("up"))


def profile(lines: DataFrame, plane_rows: DataFrame, source: str, terrain_m: float | None = None, wind_m: float | None = None, confidence: str | None = None) -> DataFrame:
    """line_id and ``json``: the published profile of each whole plane, in yards, feet and feet a second, in the shooter's frame. Lines with a code anywhere have none.

    ``source`` must be named.
    """
    if not (source or "").strip():
        raise ValueError("no-source: a profile names where its field comes from")
    bad = plane_rows.where("code is not null").select("line_id").distinct()
    arrays = nested(plane_rows.join(bad, "line_id", "left_anti"), ["line_id"], "height", "dist", ["along", "cross", "up"])
    body = F.struct(
        F.lit(1).alias("schemaVersion"), F.lit("shooter").alias("frame"), A.wrap360("bearing").alias("azimuthDeg"),
        F.transform("ranges", lambda x: x / YARD_M).alias("rangesYards"), F.transform("heights", lambda x: x / FOOT_M).alias("heightsAglFt"),
        in_feet("along").alias("uFps"), in_feet("cross").alias("vFps"), in_feet("up").alias("wFps"), F.lit(source).alias("source"),
        F.lit(terrain_m).cast("double").alias("terrainResolutionM"), F.lit(wind_m).cast("double").alias("windSourceResolutionM"), F.lit(confidence).cast("string").alias("confidence"),
    )
    return arrays.join(lines.select("line_id", "bearing"), "line_id").select("line_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
