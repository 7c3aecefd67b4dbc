"""A gridded model at points: bilinear in the grid's own index space, profiles over heights, winds beside stations, solved grids against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import geo as G
from ..functions.sizes import small
from . import grid

#: How far, in cells, a point may lie outside and still be read at the edge.
TOLERANCE = 1e-6


def sample(points: DataFrame, cells: DataFrame, conic: G.Conic, shape: tuple[int, int], key: str, values: list[str], level: str | None = None) -> DataFrame:
    """Adds ``values`` at (lat, lon) of ``points`` and ``note``: null, ``outside-volume``, or ``no-value`` beside a hole.

    ``cells`` needs (domain, row, col); shape is (rows, columns). level: a column of ``points`` that names the domain; all of one domain without it.
    """
    x, y = conic.index("lat", "lon")
    rows, cols = shape
    placed = points.withColumns({"x": x, "y": y, "height": F.lit(rows), "width": F.lit(cols), "domain": F.col(level) if level else F.lit("d")})
    inside = F.col("y").between(-TOLERANCE, rows - 1 + TOLERANCE) & F.col("x").between(-TOLERANCE, cols - 1 + TOLERANCE)
    got = grid.sample(placed, cells, values, TOLERANCE, inner=True)
    missing = F.lit(False)
    for v in values:
        missing = missing | F.col(v).isNull()
    return got.withColumn("note", F.when(~F.coalesce(inside, F.lit(False)), "outside-volume").when(missing, "no-value")).drop("height", "width", "domain")


def station_winds(stations: DataFrame, wind: DataFrame, conic: G.Conic, shape: tuple[int, int], key: str) -> DataFrame:
    """Every station with ``model_speed``, ``model_from`` and ``note``; ``wind`` has ``east`` and ``north``."""
    got = sample(stations, wind, conic, shape, key, ["east", "north"])
    return got.withColumns({"model_speed": F.hypot("east", "north"), "model_from": A.bearing_from("east", "north")}).drop("east", "north", "x", "y")


def profile(points: DataFrame, wind: DataFrame, conic: G.Conic, shape: tuple[int, int], key: str, heights: list[float]) -> DataFrame:
    """``profile``: array of (height, east, north) by height for each point; ``wind``'s domain is the height as a string."""
    asked = points.withColumn("_h", F.explode(F.array(*[F.lit(float(h)) for h in sorted(heights)]))).withColumns({"_level": F.col("_h").cast("string"), "_key": F.concat_ws("@", key, "_h")})
    got = sample(asked, wind, conic, shape, "_key", ["east", "north"], "_level")
    return got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_h").alias("height"), "east", "north"))).alias("profile"))


def first_with_value(points: DataFrame, grids: list[DataFrame], key: str, value: str = "z") -> DataFrame:
    """``value`` from the first grid, in order of priority, that has one at the point, and ``source`` (its place in the list; null: none)."""
    out = points
    for k, g in enumerate(grids):
        out = grid.sample(out, g, [value]).withColumnRenamed(value, f"_{k}")
    source = F.lit(None).cast("int")
    for k in reversed(range(len(grids))):
        source = F.when(F.col(f"_{k}").isNotNull(), k).otherwise(source)
    return out.withColumns({value: F.coalesce(*[F.col(f"_{k}") for k in range(len(grids))]), "source": source}).drop(*[f"_{k}" for k in range(len(grids))])


def against_field(stations: DataFrame, cells: DataFrame, north: float, west: float, step: float, shape: tuple[int, int], most_gap_s: float = 3600.0) -> DataFrame:
    """Stations (lat, lon, speed, from_deg, gap_s) beside the nearest cell (row, col, model_speed, model_from) of a regular solved grid; midway the first cell from the north-west is taken.

    ``gap_s``: seconds between the observation and the hour that was solved, null if either is unknown. Adds ``reason`` (why they can't be compared: the first that
    holds; null if they can), ``ratio`` (model over measured, null in a calm) and ``direction_delta`` (-180 up to 180).
    """
    rows, cols = shape
    c = F.col
    inside = c("lat").between(north - (rows - 1) * step, north) & c("lon").between(west, west + (cols - 1) * step)
    first = lambda x: F.ceil(x / step - 0.5).cast("int")
    placed = stations.withColumns({"row": first(F.lit(north) - c("lat")), "col": first(c("lon") - west), "_in": inside})
    j = placed.join(cells.select("row", "col", "model_speed", "model_from"), ["row", "col"], "left")
    reason = F.when(c("speed").isNull(), "nothing-reported").when(~c("_in"), "outside-the-box").when(c("model_speed").isNull(), "nothing-solved-there").when(F.abs("gap_s") > most_gap_s, "hours-apart")
    ok = c("reason").isNull()
    return j.withColumn("reason", reason).withColumns({"ratio": F.when(ok & (c("speed") > 0), c("model_speed") / c("speed")), "direction_delta": F.when(ok, A.half_open_gap("model_from", "from_deg"))}).drop("_in", "row", "col")


def row_spacing(row: Column | str, lat_first: float, step: float) -> tuple[Column, Column]:
    """Metres between columns and rows of a geographic grid whose first row lies at ``lat_first`` (row numbers grow southwards)."""
    lat = F.lit(lat_first) - A.col(row) * step
    return F.lit(step) * G.metres_per_degree_lon(lat), F.lit(step * G.METRES_PER_DEGREE)


def scale_curvature(cells: DataFrame, extent: DataFrame, length: float, dx: float | Column, dy: float | Column, value: str = "z") -> DataFrame:
    """``curvature`` of the scale ``length``: mean of (z - mean of two opposite heights) / length over four axes, half a length out; null if any lies off the grid or at a void.

    ``dx`` and ``dy`` may be columns of the centre's ``row``, as row_spacing gives them for rasters in degrees.
    """
    eta = length / 2
    diag = eta / 2**0.5
    ends = [(0, -eta), (0, eta), (-eta, 0), (eta, 0), (-diag, -diag), (diag, diag), (diag, -diag), (-diag, diag)]
    off = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x / dx).alias("ox"), F.lit(y / dy).alias("oy")) for k, (x, y) in enumerate(ends)]))
    centre = cells.where(F.col(value).isNotNull()).select("domain", "row", "col", F.col(value).alias("_z")).join(small(extent), "domain")
    asked = centre.withColumn("o", off).select("domain", "height", "width", "row", "col", "_z", (F.col("row") + F.col("o.oy")).alias("y"), (F.col("col") + F.col("o.ox")).alias("x"), F.concat_ws("/", "domain", "row", "col", "o.k").alias("_key"))
    got = grid.sample(asked, cells, [value], 0.0)
    sums = got.groupBy("domain", "row", "col").agg(F.first("_z").alias("_z"), F.when(F.count(value) == len(ends), F.sum(value)).alias("_s"))
    return cells.join(sums.select("domain", "row", "col", ((F.col("_z") * 4 - F.col("_s") / 2) / length / 4).alias("curvature")), ["domain", "row", "col"], "left")
