"""Rasters as cells: (domain, row, col, z); rows go south, columns east, a void is null. Stencils, samplers, resampling.

A domain's cells are spread over tasks by row and by column for the two passes of a stencil; nothing gathers a domain
in one task. Missing cells must be there as nulls (``dense``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small
from . import places


def dense(cells: DataFrame, extent: DataFrame) -> DataFrame:
    """All cells of each domain of ``extent`` (domain, height, width), void where ``cells`` has none."""
    full = extent.select("domain", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"), "width").select("domain", "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    return full.join(cells, ["domain", "row", "col"], "left")


def neighbours(cells: DataFrame, value: str = "z") -> DataFrame:
    """Adds nw n ne w e sw s se; null at the border and at voids. Two window passes: along rows, then along columns."""
    along = Window.partitionBy("domain", "row").orderBy("col")
    a = cells.withColumn("w", F.lag(value).over(along)).withColumn("e", F.lead(value).over(along))
    down = Window.partitionBy("domain", "col").orderBy("row")
    names = {"n": value, "nw": "w", "ne": "e"}
    above = {k: F.lag(v).over(down) for k, v in names.items()}
    below = {k.replace("n", "s"): F.lead(v).over(down) for k, v in names.items()}
    return a.select("*", *[v.alias(k) for k, v in (above | below).items()])


EIGHT = ["nw", "n", "ne", "w", "e", "sw", "s", "se"]


def whole(value: str = "z") -> Column:
    """All nine cells of the stencil are there."""
    ok = F.col(value).isNotNull()
    for k in EIGHT:
        ok = ok & F.col(k).isNotNull()
    return ok


def gradient(dx: Column | float, dy: Column | float) -> tuple[Column, Column]:
    """Horn's: towards east, towards north."""
    c = F.col
    return ((c("ne") + 2 * c("e") + c("se")) - (c("nw") + 2 * c("w") + c("sw"))) / (8 * dx), ((c("nw") + 2 * c("n") + c("ne")) - (c("sw") + 2 * c("s") + c("se"))) / (8 * dy)


def slope_aspect(st: DataFrame, dx, dy, value: str = "z") -> DataFrame:
    """``slope_deg`` and downhill ``aspect_deg`` (null where flat) of a stencil."""
    gx, gy = gradient(dx, dy)
    aspect = F.when((gx == 0) & (gy == 0), F.lit(None).cast("double")).otherwise(F.pmod(F.degrees(F.atan2(-gx, -gy)), F.lit(360.0)))
    return st.withColumns({"slope_deg": F.when(whole(value), F.degrees(F.atan(F.hypot(gx, gy)))), "aspect_deg": F.when(whole(value), aspect)})


def curvature(st: DataFrame, dx, dy, value: str = "z") -> DataFrame:
    """Zevenbergen-Thorne: ``total_curv``, and ``profile_curv``/``plan_curv`` (null without gradient); convex is positive."""
    c = F.col
    d, e = ((c("e") + c("w")) / 2 - c(value)) / (dx * dx), ((c("n") + c("s")) / 2 - c(value)) / (dy * dy)
    f = (-c("nw") + c("ne") + c("sw") - c("se")) / (4 * dx * dy)
    g, h = (c("e") - c("w")) / (2 * dx), (c("n") - c("s")) / (2 * dy)
    q = g * g + h * h
    ok, steep = whole(value), whole(value) & (q > 0)
    return st.withColumns({"total_curv": F.when(ok, -2 * (d + e)), "profile_curv": F.when(steep, -2 * (d * g * g + e * h * h + f * g * h) / q), "plan_curv": F.when(steep, -2 * (d * h * h + e * g * g - f * g * h) / q)})


def roughness(st: DataFrame, value: str = "z") -> DataFrame:
    """``relief`` (highest less lowest of nine), ``tri`` (root of summed squared differences), ``tpi`` (cell less mean of eight)."""
    all9 = [F.col(value), *map(F.col, EIGHT)]
    square = sum((F.pow(F.col(k) - F.col(value), 2) for k in EIGHT[1:]), F.pow(F.col("nw") - F.col(value), 2))
    mean = sum((F.col(k) for k in EIGHT[1:]), F.col("nw")) / 8
    ok = whole(value)
    return st.withColumns({"relief": F.when(ok, F.greatest(*all9) - F.least(*all9)), "tri": F.when(ok, F.sqrt(square)), "tpi": F.when(ok, F.col(value) - mean)})


def hillshade(st: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """``shade`` 0..1 from slope and aspect, and ``shade_byte`` 1..255 (0: void)."""
    a, s = math.radians(altitude), F.radians("slope_deg")
    lit = F.when(F.col("aspect_deg").isNull(), F.lit(math.sin(a))).otherwise(math.sin(a) * F.cos(s) + math.cos(a) * F.sin(s) * F.cos(F.radians(F.lit(azimuth) - F.col("aspect_deg"))))
    shade = F.when(F.col("slope_deg").isNotNull(), F.greatest(lit, F.lit(0.0)))
    return st.withColumn("shade", shade).withColumn("shade_byte", F.coalesce(F.floor(1 + 254 * F.col("shade") + 0.5), F.lit(0)).cast("int"))


def ground_slope(cells: DataFrame, dx: float, dy: float, limit_deg: float = 45.0, value: str = "z") -> DataFrame:
    """Per domain: steepest gradient between neighbours east and south, and the share of cells past ``limit_deg``."""
    e = F.abs(F.lead(value).over(Window.partitionBy("domain", "row").orderBy("col")) - F.col(value)) / dx
    s = F.abs(F.lead(value).over(Window.partitionBy("domain", "col").orderBy("row")) - F.col(value)) / dy
    g = cells.withColumn("_e", e).withColumn("_s", s).withColumn("_g", F.greatest("_e", "_s"))
    return g.groupBy("domain").agg(F.max("_g").alias("steepest"), (F.count_if(F.degrees(F.atan("_g")) > limit_deg) / F.count("_g")).alias("past_limit"))


def coarsen(cells: DataFrame, factor: int, value: str = "z") -> DataFrame:
    """Blocks of factor x factor from the north-west corner, the mean of what is there; void where nothing is."""
    if factor <= 1:
        return cells
    return cells.groupBy("domain", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg(value).alias(value))


def disc(radius: float, dx: float, dy: float) -> list[tuple[int, int]]:
    """Offsets (row, column) of the cells within ``radius``."""
    ry, rx = int(radius // dy), int(radius // dx)
    return [(r, c) for r in range(-ry, ry + 1) for c in range(-rx, rx + 1) if (r * dy) ** 2 + (c * dx) ** 2 <= radius**2]


def disc_mean(cells: DataFrame, extent: DataFrame, radius: float, dx: float, dy: float, coverage: float = 0.9, value: str = "z") -> DataFrame:
    """Mean over the disc around each cell: ``disc_mean``; null if the disc leaves the grid or fewer than ``coverage`` of it are there.

    Each cell gives its value to the cells around it; sums are combined before the shuffle. For discs of many cells use the kernel.
    """
    off = disc(radius, dx, dy)
    ry, rx = max(r for r, _ in off), max(c for _, c in off)
    to = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in off]))
    given = cells.where(F.col(value).isNotNull()).select("domain", "row", "col", F.col(value).alias("_z"), to.alias("o")).groupBy("domain", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).agg(F.sum("_z").alias("_s"), F.count("*").alias("_n"))
    j = cells.join(small(extent), "domain").join(given, ["domain", "row", "col"], "left")
    inside = (F.col("row") >= ry) & (F.col("row") < F.col("height") - ry) & (F.col("col") >= rx) & (F.col("col") < F.col("width") - rx)
    return j.withColumn("disc_mean", F.when(inside & (F.col("_n") >= coverage * len(off)), F.col("_s") / F.col("_n"))).drop("_s", "_n", "height", "width")


#: Corners of a quad: rows and columns from its first cell on.
CORNERS = {"nw": (0, 0), "ne": (0, 1), "sw": (1, 0), "se": (1, 1)}


def quads(cells: DataFrame, values: list[str]) -> DataFrame:
    """Four neighbours as one row: (domain, row, col) of the north-west one and, for each value v, v_nw, v_ne, v_sw, v_se (null: void or absent).

    Each cell is a corner of four quads; sums are combined before the only shuffle.
    """
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in CORNERS.items()]))
    each = cells.select("domain", "row", "col", *values, at.alias("o")).select("domain", (F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), "o.k", *values)
    return each.groupBy("domain", "row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col(v))).alias(f"{v}_{k}") for v in values for k in CORNERS])


def sample(points: DataFrame, cells: DataFrame, values: list[str], tolerance: float = 0.5, inner: bool = False) -> DataFrame:
    """Bilinear values at fractional ``y``/``x`` (pixel centres at whole numbers); null beyond the edge by more than ``tolerance`` or beside a void.

    ``cells`` needs (domain, row, col) and ``points`` (domain, y, x, height, width). A void corner makes a point void even if its weight is 0. On
    the last row or column the cells before it don't matter, unless ``inner``. One equi-join by domain and first corner: points move once.
    """
    c = F.col
    ok = c("y").between(-tolerance, c("height") - 1 + tolerance) & c("x").between(-tolerance, c("width") - 1 + tolerance)
    clamp = lambda v, size: F.when(ok, F.least(F.greatest(c(v), F.lit(0.0)), c(size) - 1.0))
    first = lambda v, size: F.least(F.floor(v), F.greatest(c(size) - 2, F.lit(0))).cast("int")
    p = points.drop(*values).withColumns({"_y": clamp("y", "height"), "_x": clamp("x", "width")}).withColumns({"_r": first("_y", "height"), "_c": first("_x", "width")})
    q = quads(cells, values).withColumnsRenamed({"domain": "_d", "row": "_qr", "col": "_qc"})
    j = p.join(q, (c("domain") == c("_d")) & (c("_r") == c("_qr")) & (c("_c") == c("_qc")), "left")
    fy, fx = c("_y") - c("_r"), c("_x") - c("_c")
    out = {}
    for v in values:
        total, whole = F.lit(0.0), c("_y").isNotNull()
        for k, (i, n) in CORNERS.items():
            unused = ((fy == 1 - i) & ((fy == 1) | (c("height") == 1))) | ((fx == 1 - n) & ((fx == 1) | (c("width") == 1)))
            total = total + F.coalesce(c(f"{v}_{k}"), F.lit(0.0)) * (fy if i else 1 - fy) * (fx if n else 1 - fx)
            whole = whole & (c(f"{v}_{k}").isNotNull() | (F.lit(False) if inner else unused))
        out[v] = F.when(whole, total)
    return j.withColumns(out).drop("_y", "_x", "_r", "_c", "_d", "_qr", "_qc", *[f"{v}_{k}" for v in values for k in CORNERS])


def mosaic(grids: list[DataFrame], value: str = "z") -> DataFrame:
    """First value that is there, by priority, on the pixels of the first grid; ``source`` says whose (null: void)."""
    out = grids[0].select("domain", "row", "col", F.col(value).alias("_0"))
    for k, g in enumerate(grids[1:], 1):
        out = out.join(g.select("domain", "row", "col", F.col(value).alias(f"_{k}")), ["domain", "row", "col"], "left")
    source = F.lit(None).cast("int")
    for k in reversed(range(len(grids))):
        source = F.when(F.col(f"_{k}").isNotNull(), k).otherwise(source)
    return out.select("domain", "row", "col", F.coalesce(*[F.col(f"_{k}") for k in range(len(grids))]).alias(value), source.alias("source"))


def anomaly(cells: DataFrame, reference: DataFrame, value: str = "z", against: str = "z") -> DataFrame:
    """``anomaly``: value less the reference on the same cells; null where either is."""
    return cells.join(reference.select("domain", "row", "col", F.col(against).alias("_ref")), ["domain", "row", "col"], "left").withColumn("anomaly", F.col(value) - F.col("_ref")).drop("_ref")


def coverage(boxes: DataFrame, tiles: DataFrame, steps: int = 24) -> DataFrame:
    """Share of a box's cell centres (steps x steps, 2 at least) that any tile holds. Boxes and tiles have west, south, east, north."""
    n = max(2, int(steps))
    c = F.col
    g = boxes.select("box_id", "west", "south", "east", "north", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    g = g.select("box_id", "i", "j", (c("west") + (c("j") + 0.5) / n * (c("east") - c("west"))).alias("lon"), (c("south") + (c("i") + 0.5) / n * (c("north") - c("south"))).alias("lat"))
    hit = places.inside(g, tiles, []).select("box_id", "i", "j").distinct()
    return g.groupBy("box_id").agg(F.count("*").alias("n")).join(hit.groupBy("box_id").agg(F.count("*").alias("k")), "box_id", "left").select("box_id", (F.coalesce("k", F.lit(0)) / c("n")).alias("coverage"))
