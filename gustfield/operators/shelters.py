"""Fields of a raster read at points: plain values, downhill bearings through the gradient, shelter between two sectors; where true north lies on a grid.

Points are (domain, y, x, height, width) as ``grid.sample`` takes them; each read is one equi-join by the first corner's cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from . import grid
from .resample import Grid

#: Bearings aren't read between cells: 350 and 10 would make 180.
CIRCULAR = {"aspect_deg", "from_deg"}


def field_at(points: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """``points`` with the field ``name``, bilinear; null off the raster and beside a void. Bearings are refused: see ``aspect_at``."""
    if name in CIRCULAR:
        raise ValueError(f"circular-field: {name} is a bearing")
    if name not in cells.columns:
        raise ValueError(f"no-such-field: {name}")
    return grid.sample(points, cells, [name])


def gradients(stencil: DataFrame, dx: Column | float, dy: Column | float, value: str = "z") -> DataFrame:
    """(domain, row, col, dzdx, dzdy) of a stencil (``grid.neighbours``); void where one of nine cells is."""
    gx, gy = grid.gradient(dx, dy)
    return stencil.select("domain", "row", "col", F.when(grid.whole(value), gx).alias("dzdx"), F.when(grid.whole(value), gy).alias("dzdy"))


def aspect_at(points: DataFrame, slopes: DataFrame) -> DataFrame:
    """``points`` with ``aspect_deg``, the downhill bearing of the gradient there; null off the raster, beside a void and where it is flat."""
    got = grid.sample(points, slopes, ["dzdx", "dzdy"])
    gx, gy = F.col("dzdx"), F.col("dzdy")
    return got.withColumn("aspect_deg", F.when((gx != 0) | (gy != 0), F.pmod(F.degrees(F.atan2(-gx, -gy)), F.lit(360.0)))).drop("dzdx", "dzdy")


def bracket(bearing: Column, centres: list[float]) -> tuple[Column, Column, Column]:
    """Places (from 0) of the centres at or before and after a bearing, around the circle, and how far it lies between them (0 to 1). Centres ascend."""
    if not centres or sorted(set(centres)) != list(centres) or not 0 <= centres[0] <= centres[-1] < 360:
        raise ValueError("bad-sectors: centres must ascend within 0 to 360")
    n, a = len(centres), F.pmod(bearing, F.lit(360.0))
    lower = F.lit(n - 1)
    for i, c in enumerate(centres):
        lower = F.when(a >= c, i).otherwise(lower)
    upper = (lower + 1) % n
    at = lambda i: F.element_at(F.array(*[F.lit(float(c)) for c in centres]), (i + 1).cast("int"))
    ahead = lambda x: F.pmod(x, F.lit(360.0))
    span = F.when(at(upper) == at(lower), 360.0).otherwise(ahead(at(upper) - at(lower)))
    return lower, upper, ahead(a - at(lower)) / span


def shelter_at(points: DataFrame, sx: DataFrame, centres: list[float], bearing: str = "from_deg") -> DataFrame:
    """``points`` with ``shelter_deg`` for a wind from ``bearing``: between the two nearest sectors of ``sx`` (domain, row, col, sector_deg, sx_deg), bilinear in each.

    Centres needn't be evenly spaced. Null where the bearing is null, off the raster, or beside a cell that sees nothing in one of the two sectors (even one
    of weight 0). Sectors of a cell become one row before the join.
    """
    names = [f"_sector_{i}" for i in range(len(centres))]
    lower, upper, t = bracket(F.col(bearing), centres)
    wide = sx.groupBy("domain", "row", "col").agg(*[F.max(F.when(F.col("sector_deg") == c, F.col("sx_deg"))).alias(n) for n, c in zip(names, centres)])
    got = grid.sample(points, wide, names)
    pick = lambda i: F.element_at(F.array(*names), (i + 1).cast("int"))
    return got.withColumn("shelter_deg", F.when(F.col(bearing).isNotNull(), pick(lower) * (1 - t) + pick(upper) * t)).drop(*names)


def convergence(place: Grid) -> Column:
    """Degrees from a grid's own north to true north, as drawn at its centre; 0 for grids in degrees."""
    if isinstance(place.crs, G.Geographic):
        return F.lit(0.0)
    x, y = F.lit(place.origin_x + place.width / 2 * place.step_x), F.lit(place.origin_y + place.height / 2 * place.step_y)
    lat, lon = place.crs.inverse(x, y)
    north_x, north_y = place.crs.forward(lat + 100 / G.METRES_PER_DEGREE, lon)
    return F.degrees(F.atan2(north_x - x, north_y - y))
