"""Registered queries over rasters of several reference systems and lines through fields; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import grid, resample, transects
from . import proxies as P
from .catalogue import ORACLES, query
from .comparisons import ROWS, _corners

#: The raster as a projected one: cells of 30 m in zone 13, its north-west corner.
ZONE, EAST, NORTH = G.Utm(13), 470000.0, 4430000.0
#: A coarser raster, means of 8 x 8 cells, laid on degrees; it begins inside the other one.
COARSE, WEST, TOP, STEP_X, STEP_Y = 8, -105.345, 40.02, 0.0026, -0.0022
#: The same means as a model's volume of 3 km cells on a conic projection, from its south-west corner.
CONIC, CELL_M = G.Conic(39.9, -105.36, 3000.0, 3000.0, -97.5, 38.5, 38.5), 3000.0
COARSE_ROWS, COARSE_COLS = f"ceil({ROWS} / {COARSE}.0)", P.WIDTH // COARSE


def rows_of(spark, sf) -> int:
    return P.table(spark, sf, "embeddings").count()


def place(rows: int) -> resample.Grid:
    return resample.Grid(ZONE, P.WIDTH, rows, EAST, NORTH, P.CELL, -P.CELL)


def coarse_place(rows: int) -> resample.Grid:
    return resample.Grid(G.Geographic(), COARSE_COLS, -(-rows // COARSE), WEST, TOP, STEP_X, STEP_Y)


def coarse(spark, sf):
    return grid.coarsen(P.raster(spark, sf), COARSE)


def inverse_sql(source: str, x: str, y: str) -> str:
    """``source`` with lat and lon of projected coordinates."""
    sums = lambda c, f, g, a="xi", b="eta": " + ".join(f"({k!r}) * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, k in enumerate(c, 1))
    one = f"SELECT *, ({y} - {ZONE.false_north!r}) / {ZONE.radius!r} AS xi, ({x} - {ZONE.EAST!r}) / {ZONE.radius!r} AS eta FROM {source}"
    two = f"SELECT *, xi - ({sums(ZONE.beta, 'sin', 'cosh')}) AS xi1, eta - ({sums(ZONE.beta, 'cos', 'sinh')}) AS eta1 FROM ({one})"
    three = f"SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM ({two})"
    series = " + ".join(f"({k!r}) * sin({2 * j} * chi)" for j, k in enumerate(ZONE.delta, 1))
    return f"(SELECT *, degrees(chi + {series}) AS lat, degrees(atan2(sinh(eta1), cos(xi1))) + ({ZONE.meridian!r}) AS lon FROM ({three}))"


def forward_sql(source: str) -> str:
    """``source`` (lat, lon) with the projected px and py."""
    one = f"SELECT *, sinh(atanh(sin(radians(lat))) - {ZONE.k!r} * atanh({ZONE.k!r} * sin(radians(lat)))) AS t, radians(lon - ({ZONE.meridian!r})) AS dl FROM {source}"
    two = f"SELECT *, atan2(t, cos(dl)) AS fxi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS feta FROM ({one})"
    sums = lambda f, g: " + ".join(f"({k!r}) * {f}({2 * j} * fxi) * {g}({2 * j} * feta)" for j, k in enumerate(ZONE.alpha, 1))
    return f"(SELECT *, {ZONE.radius!r} * (feta + {sums('cos', 'sinh')}) + {ZONE.EAST!r} AS px, {ZONE.radius!r} * (fxi + {sums('sin', 'cosh')}) + {ZONE.false_north!r} AS py FROM ({two}))"


def on_raster_sql(source: str) -> str:
    """``source`` (lat, lon) with fractional y and x on the projected raster."""
    return f"(SELECT *, (py - {NORTH!r}) / {-P.CELL!r} - 0.5 AS y, (px - {EAST!r}) / {P.CELL!r} - 0.5 AS x FROM {forward_sql(source)})"


def on_volume_sql(source: str) -> str:
    rho = f"({CONIC.radius * CONIC.f!r} / pow(tan(pi() / 4 + radians(lat) / 2), {CONIC.cone!r}))"
    theta = f"(radians(lon - ({CONIC.lon0!r})) * {CONIC.cone!r})"
    return f"(SELECT *, ({rho} * sin({theta}) - ({CONIC.x0!r})) / {CONIC.dx!r} AS x, (-{rho} * cos({theta}) - ({CONIC.y0!r})) / {CONIC.dy!r} AS y FROM {source})"


COARSE_SQL = f'(SELECT CAST("row" // {COARSE} AS INT) AS "row", CAST(col // {COARSE} AS INT) AS col, avg(z) AS z FROM {P.RASTER_SQL} GROUP BY ALL)'
CENTRES = inverse_sql(P.RASTER_SQL, f"({EAST!r} + (col + 0.5) * {P.CELL!r})", f'({NORTH!r} - ("row" + 0.5) * {P.CELL!r})')
ON_COARSE = f'(SELECT "row" * 64 + col AS id, (lat - {TOP!r}) / ({STEP_Y!r}) - 0.5 AS y, (lon - ({WEST!r})) / {STEP_X!r} - 0.5 AS x FROM {CENTRES})'
BASE = _corners(ON_COARSE, COARSE_SQL, "id", ["z"], COARSE_ROWS, str(COARSE_COLS), 0.5)


# ---- rasters over each other

@query(f'SELECT "row", col, a.z - b.z AS anomaly FROM {P.RASTER_SQL} a LEFT JOIN {BASE} b ON b.id = a."row" * 64 + a.col', "anomaly", "row col", places=2)
def anomaly_resampled(spark, sf):
    rows = rows_of(spark, sf)
    got = resample.anomaly(P.raster(spark, sf), place(rows), coarse(spark, sf), coarse_place(rows))
    return got.select("row", "col", "anomaly")


VOLUME_SQL = f'(SELECT "row", col, CASE WHEN ("row" * 5 + col) % 37 = 5 THEN NULL ELSE z / 2 END AS east, z / 5 + col AS north FROM {COARSE_SQL})'
NY = f"least({ROWS}, greatest(2, ceil({ROWS} * {P.CELL!r} / ({CELL_M!r} / 32)) + 1))"
NX = min(P.WIDTH, max(2, -(-P.WIDTH * P.CELL // (CELL_M / 32)) + 1))
KNOTS = f"(SELECT k AS id, CAST(k // {NX:.0f} AS INT) AS \"row\", CAST(k % {NX:.0f} AS INT) AS col FROM (SELECT unnest(range(CAST({NY} * {NX:.0f} AS BIGINT))) AS k))"
PLACED = on_volume_sql(inverse_sql(KNOTS, f"({EAST!r} + (col * 63.0 / {NX - 1!r} + 0.5) * {P.CELL!r})", f'({NORTH!r} - ("row" * ({ROWS} - 1.0) / ({NY} - 1) + 0.5) * {P.CELL!r})'))
LATTICE = f"(SELECT k.\"row\", k.col, x, y, v.east, v.north FROM {PLACED} k LEFT JOIN {_corners(PLACED, VOLUME_SQL, 'id', ['east', 'north'], COARSE_ROWS, str(COARSE_COLS))} v USING (id))"
BACK = f'(SELECT "row" * 64 + col AS id, "row" * ({NY} - 1.0) / ({ROWS} - 1) AS y, col * {NX - 1!r} / 63 AS x FROM {P.RASTER_SQL})'


def volume(spark, sf):
    c = coarse(spark, sf)
    return c.select("row", "col", F.when((F.col("row") * 5 + F.col("col")) % 37 != 5, F.col("z") / 2).alias("east"), (F.col("z") / 5 + F.col("col")).alias("north"))


def model_grid(rows: int) -> resample.Volume:
    return resample.Volume(CONIC, -(-rows // COARSE), COARSE_COLS, CELL_M)


@query(f'SELECT "row", col, v.east, v.north FROM {P.RASTER_SQL} c LEFT JOIN {_corners(BACK, LATTICE, "id", ["east", "north"], NY, f"{NX:.0f}")} v ON v.id = c."row" * 64 + c.col', "east north", "row col", places=2)
def reference_grid(spark, sf):
    rows = rows_of(spark, sf)
    return resample.reference_grid(spark, place(rows), model_grid(rows), volume(spark, sf))[0]


@query(f"SELECT count(*) AS knots, count(*) FILTER (WHERE NOT (y BETWEEN -1e-6 AND {COARSE_ROWS} - 1 + 1e-6 AND x BETWEEN -1e-6 AND {COARSE_COLS} - 1 + 1e-6)) AS outside, count(east) AS with_wind, avg(north) AS mean_north FROM {LATTICE}", "mean_north", places=4)
def reference_lattice(spark, sf):
    rows = rows_of(spark, sf)
    read = resample.reference_grid(spark, place(rows), model_grid(rows), volume(spark, sf))[1]
    return read.agg(F.count("*").alias("knots"), F.count_if("outside").alias("outside"), F.count("east").alias("with_wind"), F.avg("north").alias("mean_north"))


BOX = {"south": 39.93, "north": 40.025, "west": -105.353, "east": -105.33}
MIDDLE = on_volume_sql(f"(SELECT 0 AS id, {(BOX['south'] + BOX['north']) / 2!r} AS lat, {(BOX['west'] + BOX['east']) / 2!r} AS lon)")


@query(f"SELECT v.east, v.north, v.ground, sqrt(v.east * v.east + v.north * v.north) AS speed, {(BOX['north'] - BOX['south']) * G.METRES_PER_DEGREE / CELL_M!r} AS cells_across FROM {MIDDLE} m LEFT JOIN {_corners(MIDDLE, VOLUME_SQL.replace('AS north FROM', 'AS north, z * 10 AS ground FROM'), 'id', ['east', 'north', 'ground'], COARSE_ROWS, str(COARSE_COLS))} v USING (id)", "east north ground speed cells_across", places=4)
def reference_wind(spark, sf):
    cells = volume(spark, sf).join(coarse(spark, sf).select("row", "col", (F.col("z") * 10).alias("ground")), ["row", "col"])
    return resample.reference_wind(spark, model_grid(rows_of(spark, sf)), cells, BOX, ["ground"]).select("east", "north", "ground", "speed", "cells_across")


W, H = 120, resample.height_for(BOX, 120)
PIXELS = f"(SELECT k AS id, CAST(k // {W} AS INT) AS \"row\", CAST(k % {W} AS INT) AS col, {BOX['north']!r} - (k // {W} + 0.5) * {(BOX['north'] - BOX['south']) / H!r} AS lat, {BOX['west']!r} + (k % {W} + 0.5) * {(BOX['east'] - BOX['west']) / W!r} AS lon FROM (SELECT unnest(range({W * H})) AS k))"


@query(f"SELECT p.\"row\", p.col, p.lat, p.lon, v.z FROM {PIXELS} p LEFT JOIN {_corners(on_raster_sql(PIXELS), P.RASTER_SQL, 'id', ['z'], tolerance=0.5)} v USING (id)", "lat lon z", "row col", places=2)
def geographic_resample(spark, sf):
    rows = rows_of(spark, sf)
    return resample.geographic(spark, P.raster(spark, sf), place(rows), BOX, ["z"], W)


FIELD_SQL = f'(SELECT "row", col, z / 20 AS east, (col - 30) / 10.0 - z / 50 AS north, z FROM {P.RASTER_SQL})'
SPREAD = f"(SELECT k AS id, CAST(k // 40 AS INT) AS \"row\", CAST(k % 40 AS INT) AS col, {BOX['north']!r} + (k // 40) * {(BOX['south'] - BOX['north']) / 49!r} AS lat, {BOX['west']!r} + (k % 40) * {(BOX['east'] - BOX['west']) / 39!r} AS lon FROM (SELECT unnest(range(2000)) AS k))"


def field(spark, sf):
    return P.raster(spark, sf).select("row", "col", (F.col("z") / 20).alias("east"), ((F.col("col") - 30) / F.lit(10.0) - F.col("z") / 50).alias("north"), "z")


@query(f"SELECT p.\"row\", p.col, v.east, v.north, sqrt(v.east * v.east + v.north * v.north) AS speed, v.z FROM {SPREAD} p LEFT JOIN {_corners(on_raster_sql(SPREAD), FIELD_SQL, 'id', ['east', 'north', 'z'], tolerance=0.5)} v USING (id)", "east north speed z", "row col", places=2)
def field_over_box(spark, sf):
    return resample.over_box(spark, field(spark, sf), place(rows_of(spark, sf)), BOX, 40, 50).select("row", "col", "east", "north", "speed", "z")


@query(f"SELECT count(*) AS cells, count(v.z) / count(*) AS covered FROM {PIXELS} p LEFT JOIN {_corners(on_raster_sql(PIXELS), P.RASTER_SQL, 'id', ['z'], tolerance=0.5)} v USING (id)", "covered")
def covered_fraction(spark, sf):
    return resample.covered(geographic_resample_rows(spark, sf), "z")


def geographic_resample_rows(spark, sf):
    return resample.geographic(spark, P.raster(spark, sf), place(rows_of(spark, sf)), BOX, ["z"], W)


# ---- lines

#: Suppliers as lines: from points inside the raster, in all directions, some of no length or without a step.
LINES_SQL = "(SELECT s_suppkey AS line_id, 39.9 + (s_suppkey % 50) * 0.002 AS lat, -105.35 + (s_suppkey % 20) * 0.001 AS lon, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS bearing, CASE WHEN s_suppkey % 41 = 0 THEN 0.0 ELSE 150.0 + s_suppkey % 7 * 90 END AS length, CASE WHEN s_suppkey % 43 = 0 THEN -1.0 ELSE 100.0 END AS step FROM supplier)"


def lines(spark, sf):
    k = F.col("s_suppkey")
    length = F.when(k % 41 == 0, 0.0).otherwise(F.lit(150.0) + k % 7 * 90)
    return P.table(spark, sf, "supplier").select(k.alias("line_id"), (F.lit(39.9) + (k % 50) * 0.002).alias("lat"), (F.lit(-105.35) + (k % 20) * 0.001).alias("lon"), (k * 37 % 360).cast("double").alias("bearing"), length.alias("length"), F.when(k % 43 == 0, -1.0).otherwise(100.0).alias("step"))


def direct_sql(source: str) -> str:
    """``source`` (lat0, lon0, bearing0, dist) with lat, lon and bearing at the end of the geodesic: Vincenty's direct solution, six rounds."""
    f = 1 / 298.257223563
    a = 6378137.0
    b = a * (1 - f)
    s = f"SELECT *, radians(bearing0) AS a1, atan({1 - f!r} * tan(radians(lat0))) AS u1 FROM {source}"
    s = f"SELECT *, atan2(tan(u1), cos(a1)) AS s1, cos(u1) * sin(a1) AS sa FROM ({s})"
    s = f"SELECT *, 1 - sa * sa AS ca2, (1 - sa * sa) * {(a * a - b * b) / (b * b)!r} AS us FROM ({s})"
    s = f"SELECT *, 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us))) AS big, us / 1024 * (256 + us * (-128 + us * (74 - 47 * us))) AS small FROM ({s})"
    s = f"SELECT *, dist / ({b!r} * big) AS sg0 FROM ({s})"
    for k in range(6):
        m, g = f"cos(2 * s1 + sg{k})", f"sg{k}"
        s = f"SELECT *, sg0 + small * sin({g}) * ({m} + small / 4 * (cos({g}) * (-1 + 2 * {m} * {m}) - small / 6 * {m} * (-3 + 4 * sin({g}) * sin({g})) * (-3 + 4 * {m} * {m}))) AS sg{k + 1} FROM ({s})"
    s = f"SELECT *, sg6 AS sg, cos(2 * s1 + sg6) AS m, sin(u1) * sin(sg6) - cos(u1) * cos(sg6) * cos(a1) AS tmp, {f / 16!r} * ca2 * (4 + {f!r} * (4 - 3 * ca2)) AS cc FROM ({s})"
    lon = f"lon0 + degrees(atan2(sin(sg) * sin(a1), cos(u1) * cos(sg) - sin(u1) * sin(sg) * cos(a1)) - (1 - cc) * {f!r} * sa * (sg + cc * sin(sg) * (m + cc * cos(sg) * (-1 + 2 * m * m))))"
    return f"(SELECT *, degrees(atan2(sin(u1) * cos(sg) + cos(u1) * sin(sg) * cos(a1), {1 - f!r} * sqrt(sa * sa + tmp * tmp))) AS lat, {lon} AS lon, fmod(degrees(atan2(sa, -tmp)) + 360, 360) AS bearing FROM ({s}))"


GOOD = f"(SELECT line_id, lat AS lat0, lon AS lon0, bearing AS bearing0, length, step FROM {LINES_SQL} WHERE length > 0 AND step > 0)"
STEPS = f"(SELECT line_id, lat0, lon0, bearing0, k * step AS dist FROM (SELECT *, unnest(range(CAST(ceil(length / step) AS BIGINT))) AS k FROM {GOOD}) UNION SELECT line_id, lat0, lon0, bearing0, length FROM {GOOD})"
STATIONS = f"(SELECT line_id * 1000000 + CAST(dist AS BIGINT) AS id, line_id, dist, lat, lon, bearing FROM {direct_sql(STEPS)})"
BAD = f"(SELECT line_id, CASE WHEN length <= 0 THEN 'bad-length' WHEN step <= 0 THEN 'bad-step' END AS code FROM {LINES_SQL} WHERE length <= 0 OR step <= 0)"
READ = f"(SELECT s.*, v.east, v.north, v.z FROM {STATIONS} s LEFT JOIN {_corners(on_raster_sql(STATIONS), FIELD_SQL, 'id', ['east', 'north', 'z'], tolerance=0.5)} v USING (id))"
TRANSECT = f"""(SELECT line_id, dist, lat, lon, bearing, CASE WHEN east IS NULL OR north IS NULL THEN 'outside-domain' END AS code, sqrt(east * east + north * north) AS speed, east * sin(radians(bearing)) + north * cos(radians(bearing)) AS along, east * cos(radians(bearing)) - north * sin(radians(bearing)) AS "cross", z FROM {READ}
 UNION ALL SELECT line_id, NULL, NULL, NULL, NULL, code, NULL, NULL, NULL, NULL FROM {BAD})"""


def walked(spark, sf):
    return transects.transect(lines(spark, sf), field(spark, sf), place(rows_of(spark, sf)))


@query(f'SELECT line_id, dist, lat, lon, code, speed, along, "cross", z FROM {TRANSECT}', 'dist lat lon speed along "cross" z', places=2)
def transect(spark, sf):
    return walked(spark, sf).select("line_id", "dist", "lat", "lon", "code", "speed", "along", "cross", "z")


@query(f"""SELECT line_id, count(*) AS stations, arg_min(code, coalesce(dist, -1)) FILTER (WHERE code IS NOT NULL) AS code, arg_max(t.bearing, dist) - any_value(l.bearing) AS turned FROM {TRANSECT} t JOIN {LINES_SQL} l USING (line_id) GROUP BY line_id""", "turned")
def line_convergence(spark, sf):
    k = transects.convergence(lines(spark, sf), walked(spark, sf))
    return k.select("line_id", "stations", "code", F.col("convergence").alias("turned"))


HEIGHTS = [2.0, 10.0, 60.0]
PLANE = f"""(SELECT line_id, dist, height, code, CASE WHEN code IS NULL THEN ln(height / 0.03) / ln(10 / 0.03) END AS factor, along, "cross" FROM {TRANSECT}, (SELECT unnest([2.0::DOUBLE, 10.0, 60.0]) AS height))"""


@query(f'SELECT line_id, dist, height, code, factor, along * factor AS along, "cross" * factor AS "cross", CASE WHEN code IS NULL THEN 0.0::DOUBLE END AS up FROM {PLANE}', 'dist height factor along "cross" up', places=2)
def plane(spark, sf):
    return transects.plane(walked(spark, sf), HEIGHTS).select("line_id", "dist", "height", "code", "factor", "along", "cross", "up")


@query(f"""SELECT line_id, CAST(count(*) AS BIGINT) AS nodes, max(dist) / 0.9144 AS last_yards, sum(along * factor) / 0.3048 AS sum_u, sum("cross" * factor) / 0.3048 AS sum_v FROM {PLANE} GROUP BY line_id HAVING count(code) = 0""", "last_yards sum_u sum_v", places=2)
def wind_profile(spark, sf):
    body = "struct<rangesYards:array<double>,heightsAglFt:array<double>,uFps:array<array<double>>,vFps:array<array<double>>>"
    made = transects.profile(lines(spark, sf), transects.plane(walked(spark, sf), HEIGHTS), "raster").withColumn("p", F.from_json("json", body))
    total = lambda g: F.aggregate(F.flatten(g), F.lit(0.0), lambda a, x: a + x)
    return made.select("line_id", F.size(F.flatten("p.uFps")).cast("bigint").alias("nodes"), F.array_max("p.rangesYards").alias("last_yards"), total("p.uFps").alias("sum_u"), total("p.vFps").alias("sum_v"))


#: The lines of geodesic_line, which is registered with the catalogue.
GEODESICS = f"(SELECT id AS line_id, lat AS lat0, lon AS lon0, CAST(id * 17 % 360 AS DOUBLE) AS bearing0, unnest([0.0::DOUBLE, 400, 800, 1200, 1600, 2000, 2400, 2500]) AS dist FROM {P.PLACES_SQL})"
ORACLES["geodesic_line"] = P.rounded_sql(f"SELECT line_id, dist, lat, lon, bearing FROM {direct_sql(GEODESICS)}", ["dist", "lat", "lon", "bearing"])
