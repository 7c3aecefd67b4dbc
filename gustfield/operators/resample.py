"""Rasters of different reference systems and spacings over each other: a raster's cells read from another grid, a coarse model on fine cells, output grids in degrees.

A cell finds its neighbours in the other grid by the floored index there, which is the key of an equi-join with that grid's quads (``grid.quads``): every cell moves
once, the other grid's cells four times before they are combined. No grid is broadcast or gathered, so both may be of any size; where many fine cells
fall into one coarse quad, Spark splits the join. Inputs without rows give results without values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.angles import bearing_from, col
from . import grid

#: Samples of the lattice for each cell of the model.
SAMPLES_PER_CELL = 32
#: Sides of an output raster.
LEAST_SIDE, MOST_SIDE = 2, 4096


@dataclass(frozen=True)
class Grid:
    """Where a raster lies: origin is the outer corner of the first pixel, steps are signed, rows go south."""

    crs: G.Geographic | G.Utm
    width: int
    height: int
    origin_x: float
    origin_y: float
    step_x: float
    step_y: float

    def centre(self, row, column) -> tuple[Column, Column]:
        """Latitude and longitude of a pixel's centre (also between pixels)."""
        return self.crs.inverse((col(column) + 0.5) * self.step_x + self.origin_x, (col(row) + 0.5) * self.step_y + self.origin_y)

    def index(self, lat, lon) -> tuple[Column, Column]:
        """Fractional row and column; whole numbers are pixel centres."""
        x, y = self.crs.forward(lat, lon)
        return (y - self.origin_y) / self.step_y - 0.5, (x - self.origin_x) / self.step_x - 0.5


def at(points: DataFrame, place: Grid, cells: DataFrame, values: list[str]) -> DataFrame:
    """``points`` (lat, lon) with ``values`` of a raster there: bilinear, null off it or beside a void."""
    y, x = place.index("lat", "lon")
    asked = points.withColumns({"y": y, "x": x, "height": F.lit(place.height), "width": F.lit(place.width), "domain": F.lit("d")})
    return grid.sample(asked, cells.withColumn("domain", F.lit("d")), values).drop("y", "x", "height", "width", "domain")


def anomaly(cells: DataFrame, place: Grid, reference: DataFrame, reference_place: Grid, value: str = "z", against: str = "z") -> DataFrame:
    """``anomaly``: value less what the reference, a raster of its own system and spacing, has at the cell's centre; null where either is void."""
    lat, lon = place.centre("row", "col")
    base = reference.select("row", "col", F.col(against).alias("_base"))
    read = at(cells.withColumns({"lat": lat, "lon": lon}), reference_place, base, ["_base"])
    return read.withColumn("anomaly", F.col(value) - F.col("_base")).drop("lat", "lon", "_base")


@dataclass(frozen=True)
class Volume:
    """A model's horizontal grid: projection, rows, columns, and the size of a cell."""

    conic: G.Conic
    rows: int
    columns: int
    cell_m: float

    def sample(self, points: DataFrame, cells: DataFrame, values: list[str]) -> DataFrame:
        """``points`` (lat, lon) with ``values`` of one level, and ``outside``: off the volume by more than rounding."""
        x, y = self.conic.index("lat", "lon")
        asked = points.withColumns({"y": y, "x": x, "height": F.lit(self.rows), "width": F.lit(self.columns), "domain": F.lit("d")})
        tol = 1e-6
        inside = F.col("y").between(-tol, self.rows - 1 + tol) & F.col("x").between(-tol, self.columns - 1 + tol)
        got = grid.sample(asked, cells.withColumn("domain", F.lit("d")), values, tol, inner=True)
        return got.withColumn("outside", ~inside).drop("y", "x", "height", "width", "domain")


def lattice(place: Grid, cell_m: float, every_m: float | None = None) -> tuple[int, int]:
    """Rows and columns of the lattice on which a model is read over a raster: every ``every_m`` metres or finer, two at least, never more than the raster has."""
    step = cell_m / SAMPLES_PER_CELL if every_m is None else every_m
    if not step > 0:
        raise ValueError("bad-sample: the distance of samples must be positive")
    side = lambda n, size: min(n, max(2, math.ceil(n * abs(size) / step) + 1))
    return side(place.height, place.step_y), side(place.width, place.step_x)


def reference_grid(spark: SparkSession, place: Grid, volume: Volume, wind: DataFrame, every_m: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The model's wind at every cell of a raster, and the lattice it was read on.

    ``wind`` has row, col, east and north (of the earth) of one level. The first result has row, col, east, north (null where a corner of the
    lattice has none), the second row, col, lat, lon, east, north, outside. A corner off the model is a hole, not a failure.
    """
    ny, nx = lattice(place, volume.cell_m, every_m)
    share = lambda k, n, size: k * (max(size - 1, 1) / (n - 1)) if n > 1 else F.lit(0.0)
    knots = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    lat, lon = place.centre(share(F.col("row"), ny, place.height), share(F.col("col"), nx, place.width))
    read = volume.sample(knots.withColumns({"lat": lat, "lon": lon}), wind, ["east", "north"])
    cells = spark.range(place.height * place.width).select(F.floor(F.col("id") / place.width).cast("int").alias("row"), (F.col("id") % place.width).cast("int").alias("col"))
    back = lambda k, n, size: k * ((n - 1) / max(size - 1, 1))
    asked = cells.withColumns({"y": back(F.col("row"), ny, place.height), "x": back(F.col("col"), nx, place.width), "height": F.lit(ny), "width": F.lit(nx), "domain": F.lit("d")})
    got = grid.sample(asked, read.withColumn("domain", F.lit("d")), ["east", "north"], inner=True)
    return got.select("row", "col", "east", "north"), read


def centre_of(box: dict) -> tuple[float, float]:
    return (box["south"] + box["north"]) / 2, (box["west"] + box["east"]) / 2


def reference_wind(spark: SparkSession, volume: Volume, wind: DataFrame, box: dict, scalars: list[str] = ()) -> DataFrame:
    """One row: the model's wind, and surface ``scalars`` of the same grid, at the centre of a box, and how many model cells the box is across."""
    lat, lon = centre_of(box)
    span = max((box["north"] - box["south"]) * G.METRES_PER_DEGREE, (box["east"] - box["west"]) * max(G.METRES_PER_DEGREE * math.cos(math.radians(lat)), 1.0))
    one = spark.range(1).select(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    got = volume.sample(one, wind, ["east", "north", *scalars])
    return got.withColumns({"speed": F.hypot("east", "north"), "from_deg": bearing_from("east", "north"), "cells_across": F.lit(span / volume.cell_m)})


def height_for(box: dict, width: int) -> int:
    """Rows of an output raster whose pixels are square on the ground."""
    lat, _ = centre_of(box)
    across = (box["east"] - box["west"]) * max(G.METRES_PER_DEGREE * math.cos(math.radians(lat)), 1.0)
    return math.floor(width * (box["north"] - box["south"]) * G.METRES_PER_DEGREE / across + 0.5)


def _sides(width: int, height: int) -> None:
    for name, side in (("width", width), ("height", height)):
        if not LEAST_SIDE <= side <= MOST_SIDE:
            raise ValueError(f"bad-{name}: a raster has {LEAST_SIDE} to {MOST_SIDE} pixels a side")


def geographic(spark: SparkSession, cells: DataFrame, place: Grid, box: dict, values: list[str], width: int, height: int | None = None) -> DataFrame:
    """A projected raster on pixels of degrees that fill a box: row, col, lat, lon (centres, north first) and ``values``."""
    height = height_for(box, width) if height is None else height
    _sides(width, height)
    pixels = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    lat = F.lit(box["north"]) - (F.col("row") + 0.5) * ((box["north"] - box["south"]) / height)
    lon = (F.col("col") + 0.5) * ((box["east"] - box["west"]) / width) + box["west"]
    return at(pixels.withColumns({"lat": lat, "lon": lon}), place, cells, values)


def over_box(spark: SparkSession, cells: DataFrame, place: Grid, box: dict, columns: int, rows: int) -> DataFrame:
    """A field's wind (east, north) and ground (z) at points spread over a box, its edges among them: row, col, lat, lon, east, north, speed, from_deg, z; nulls off the field."""
    spread = lambda k, n, a, b: F.lit((a + b) / 2) if n == 1 else F.lit(a) + k * ((b - a) / (n - 1))
    points = spark.range(columns * rows).select(F.floor(F.col("id") / columns).cast("int").alias("row"), (F.col("id") % columns).cast("int").alias("col"))
    points = points.withColumns({"lat": spread(F.col("row"), rows, box["north"], box["south"]), "lon": spread(F.col("col"), columns, box["west"], box["east"])})
    got = at(points, place, cells, ["east", "north", "z"])
    whole = F.col("east").isNotNull() & F.col("north").isNotNull()
    return got.withColumns({"east": F.when(whole, F.col("east")), "north": F.when(whole, F.col("north"))}).withColumns({"speed": F.hypot("east", "north"), "from_deg": bearing_from("east", "north")})


def covered(cells: DataFrame, value: str) -> DataFrame:
    """Share of cells that have a value: ``covered``."""
    return cells.agg(F.count("*").alias("cells"), (F.count(value) / F.count("*")).alias("covered"))
