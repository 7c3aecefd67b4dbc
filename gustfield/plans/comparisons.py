"""More registered queries: the model at points, tables and filters, comparisons and reports; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import tables as T
from ..operators import grid, model, reports
from . import proxies as P
from .catalogue import query, sql_signed

#: The raster as a model grid on a conic projection: 12 km by 1.5 km a cell.
CONIC = G.Conic(36.6, -109.6, 12000.0, 1500.0, -105.0, 38.5, 38.5)
ROWS = "(SELECT count(*) FROM embeddings)"


def _corners(points: str, cells: str, key: str, values: list[str], rows: str = ROWS, columns: str = "64", tolerance: float = 1e-6, level: str = "") -> str:
    """SQL of bilinear values at (y, x): null beyond the edge or beside a void, even one of weight 0; a tolerance below half a cell is that of models, which always need four cells."""
    y, x = f"least(greatest(y, 0), {rows} - 1)", f"least(greatest(x, 0), {columns} - 1)"
    r, c = f"least(floor({y}), {rows} - 2)", f"least(floor({x}), {columns} - 2)"
    inside = f"y BETWEEN -{tolerance} AND {rows} - 1 + {tolerance} AND x BETWEEN -{tolerance} AND {columns} - 1 + {tolerance}"
    needed = "true" if 0 < tolerance < 0.5 else f"NOT (i = 0 AND {y} - {r} = 1) AND NOT (j = 0 AND {x} - {c} = 1)"
    sums = ", ".join(f"CASE WHEN count(g.{v}) = count(*) THEN sum(g.{v} * w) END AS {v}" for v in values)
    return f"""(SELECT {key}, {sums} FROM (SELECT *, CAST({r} + i AS INT) AS gr, CAST({c} + j AS INT) AS gc, (CASE WHEN i = 1 THEN {y} - {r} ELSE 1 - ({y} - {r}) END) * (CASE WHEN j = 1 THEN {x} - {c} ELSE 1 - ({x} - {c}) END) AS w
  FROM {points}, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE {inside}) k LEFT JOIN {cells} g ON g."row" = gr AND g.col = gc{' AND g.domain = k.domain' if level else ''} WHERE {needed} GROUP BY {key})"""


RHO = f"({CONIC.radius * CONIC.f!r} / pow(tan(pi() / 4 + radians(lat) / 2), {CONIC.cone!r}))"
THETA = f"(radians(lon - ({CONIC.lon0!r})) * {CONIC.cone!r})"
INDEXED = f"(SELECT *, ({RHO} * sin({THETA}) - ({CONIC.x0!r})) / {CONIC.dx!r} AS x, (-{RHO} * cos({THETA}) - ({CONIC.y0!r})) / {CONIC.dy!r} AS y FROM {P.PLACES_SQL})"
WIND = f"(SELECT domain, \"row\", col, z / 20 AS east, (col - 30) / 10.0 - z / 50 AS north FROM {P.RASTER_SQL})"


def wind(spark, sf):
    return P.raster(spark, sf).select("domain", "row", "col", (F.col("z") / 20).alias("east"), ((F.col("col") - 30) / F.lit(10.0) - F.col("z") / 50).alias("north"))


def shape(spark, sf):
    """Rows (one for each vector) and columns."""
    return P.table(spark, sf, "embeddings").count(), P.WIDTH


INSIDE = f"y BETWEEN -1e-6 AND {ROWS} - 1 + 1e-6 AND x BETWEEN -1e-6 AND 63 + 1e-6"


@query(f"SELECT p.id, v.east, v.north, CASE WHEN NOT ({INSIDE}) THEN 'outside-volume' WHEN v.east IS NULL OR v.north IS NULL THEN 'no-value' END AS note FROM {INDEXED} p LEFT JOIN {_corners(INDEXED, WIND, 'id', ['east', 'north'])} v USING (id)", "east north", places=5)
def model_sample(spark, sf):
    return model.sample(P.places(spark, sf), wind(spark, sf), CONIC, shape(spark, sf), "id", ["east", "north"]).select("id", "east", "north", "note")


@query(f"SELECT p.id, sqrt(v.east * v.east + v.north * v.north) AS model_speed, CASE WHEN NOT ({INSIDE}) THEN 'outside-volume' WHEN v.east IS NULL OR v.north IS NULL THEN 'no-value' END AS note FROM {INDEXED} p LEFT JOIN {_corners(INDEXED, WIND, 'id', ['east', 'north'])} v USING (id)", "model_speed", places=5)
def station_model(spark, sf):
    return model.station_winds(P.places(spark, sf), wind(spark, sf), CONIC, shape(spark, sf), "id").select("id", "model_speed", "note")


@query(f"SELECT id, h AS height, v.east * CASE WHEN h = 80 THEN 1.5 ELSE 1.0 END AS east FROM {P.PLACES_SQL} p CROSS JOIN (SELECT unnest([10.0::DOUBLE, 80.0]) AS h) LEFT JOIN {_corners(INDEXED, WIND, 'id', ['east', 'north'])} v USING (id)", "east height", places=5)
def model_profile(spark, sf):
    w = wind(spark, sf)
    levels = w.withColumn("domain", F.lit("10.0")).unionByName(w.withColumns({"domain": F.lit("80.0"), "east": F.col("east") * 1.5}))
    got = model.profile(P.places(spark, sf), levels, CONIC, shape(spark, sf), "id", [80.0, 10.0])
    return got.select("id", F.explode("profile").alias("p")).select("id", "p.height", "p.east")


PTS = f"(SELECT p_partkey AS id, 'd' AS domain, fmod(p_partkey * 0.37::DOUBLE, 499) AS y, fmod(p_partkey * 0.71::DOUBLE, 63) AS x, {ROWS} AS h FROM part)"


def _points(spark, sf):
    rows, columns = shape(spark, sf)
    k = F.col("p_partkey")
    return P.table(spark, sf, "part").select(k.alias("id"), F.lit("d").alias("domain"), ((k * F.lit(0.37)) % 499).alias("y"), ((k * F.lit(0.71)) % 63).alias("x"), F.lit(rows).alias("height"), F.lit(columns).alias("width"))


@query(f"""SELECT p.id, coalesce(a.z, b.z) AS z, CASE WHEN a.z IS NOT NULL THEN 0 WHEN b.z IS NOT NULL THEN 1 END AS source FROM {PTS} p LEFT JOIN {_corners(PTS, P.RASTER_SQL, 'id', ['z'], tolerance=0.5)} a USING (id)
 LEFT JOIN {_corners(PTS, f'(SELECT domain, "row", col, coalesce(z, "row" * 1.0) AS z FROM {P.RASTER_SQL})', 'id', ['z'], tolerance=0.5)} b USING (id)""", "z", "source")
def first_with_value(spark, sf):
    r = P.raster(spark, sf)
    return model.first_with_value(_points(spark, sf), [r, r.withColumn("z", F.coalesce("z", F.col("row") * F.lit(1.0)))], "id").select("id", "z", "source")


FIELD = f'(SELECT "row", col, abs(z) / 10 AS model_speed, CAST(("row" * 13 + col * 7) % 360 AS DOUBLE) AS model_from FROM {P.RASTER_SQL})'
STATIONS = f"(SELECT id, lat, lon, CASE WHEN id % 9 = 0 THEN NULL ELSE abs(elevation - 1500) / 100 END AS speed, CAST(id * 29 % 360 AS DOUBLE) AS from_deg, CASE WHEN id % 4 <> 0 THEN CAST(id * 97 % 5000 AS DOUBLE) - 1000 END AS gap_s FROM {P.PLACES_SQL})"


def _stations(spark, sf):
    i = F.col("id")
    return P.places(spark, sf).select("id", "lat", "lon", F.when(i % 9 != 0, F.abs(F.col("elevation") - 1500) / 100).alias("speed"), (i * 29 % 360).cast("double").alias("from_deg"), F.when(i % 4 != 0, (i * 97 % 5000).cast("double") - 1000).alias("gap_s"))


AGAINST = f"""(SELECT s.*, reason, CASE WHEN reason IS NULL AND speed > 0 THEN model_speed / speed END AS ratio, CASE WHEN reason IS NULL THEN fmod(fmod(model_from - from_deg, 360) + 540, 360) - 180 END AS direction_delta FROM (SELECT s.*, model_speed, model_from,
  CASE WHEN speed IS NULL THEN 'nothing-reported' WHEN NOT (lat BETWEEN 40.5 - ({ROWS} - 1) * 0.05 AND 40.5 AND lon BETWEEN -108 AND -108 + 63 * 0.05) THEN 'outside-the-box' WHEN model_speed IS NULL THEN 'nothing-solved-there' WHEN abs(gap_s) > 3600 THEN 'hours-apart' END AS reason
  FROM {STATIONS} s LEFT JOIN {FIELD} f ON f."row" = ceil((40.5 - lat) / 0.05 - 0.5) AND f.col = ceil((lon + 108) / 0.05 - 0.5)) s)"""


def _against(spark, sf):
    f = P.raster(spark, sf).select("row", "col", (F.abs("z") / 10).alias("model_speed"), ((F.col("row") * 13 + F.col("col") * 7) % 360).cast("double").alias("model_from"))
    return model.against_field(_stations(spark, sf), f, 40.5, -108.0, 0.05, shape(spark, sf))


@query(f"SELECT id, reason, ratio, direction_delta FROM {AGAINST}", "ratio direction_delta", places=4)
def station_against_field(spark, sf):
    return _against(spark, sf).select("id", "reason", "ratio", "direction_delta")


@query(f"SELECT id % 4 AS grp, count(ratio) AS compared, median(ratio) AS median_ratio FROM {AGAINST} GROUP BY id % 4", "median_ratio", places=4)
def median_ratio(spark, sf):
    return reports.median_ratio(_against(spark, sf).withColumn("grp", F.col("id") % 4), ["grp"])


@query(f"""SELECT domain, "row", col, degrees(atan(sqrt(pow((ne + 2 * e + se - nw - 2 * w - sw) / (8 * 0.01 * greatest({G.METRES_PER_DEGREE} * cos(radians(40 - "row" * 0.01)), 1)), 2) + pow((nw + 2 * n + ne - sw - 2 * s - se) / (8 * 0.01 * {G.METRES_PER_DEGREE}), 2)))) AS slope_deg FROM
 (SELECT t.*, a.z AS nw, b.z AS n, c.z AS ne, d.z AS w, e.z AS e, f.z AS sw, g.z AS s, h.z AS se FROM {P.RASTER_SQL} t {' '.join(f'LEFT JOIN {P.RASTER_SQL} {k} ON {k}."row" = t."row" + ({i}) AND {k}.col = t.col + ({j})' for k, i, j in (('a', -1, -1), ('b', -1, 0), ('c', -1, 1), ('d', 0, -1), ('e', 0, 1), ('f', 1, -1), ('g', 1, 0), ('h', 1, 1)))}) WHERE z IS NOT NULL""", "slope_deg", "row col")
def geographic_slope(spark, sf):
    st = grid.neighbours(grid.dense(P.raster(spark, sf), P.extent(P.raster(spark, sf))))
    dx, dy = model.row_spacing("row", 40.0, 0.01)
    return grid.slope_aspect(st, dx, dy).where("z is not null").select("domain", "row", "col", "slope_deg")


ENDS = "(SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([0, 0, -60, 60, -60 / sqrt(2), 60 / sqrt(2), 60 / sqrt(2), -60 / sqrt(2)]) / 30.0 AS ox, unnest([-60, 60, 0, 0, -60 / sqrt(2), 60 / sqrt(2), -60 / sqrt(2), 60 / sqrt(2)]) / 30.0 AS oy)"
ROSE = f"(SELECT \"row\" * 64 + col AS cell, (\"row\" * 64 + col) * 8 + k AS id, 'd' AS domain, \"row\" + oy AS y, col + ox AS x FROM {P.RASTER_SQL}, {ENDS} WHERE z IS NOT NULL)"


@query(f"""SELECT domain, "row", col, (4 * z - s / 2) / 120 / 4 AS curvature FROM {P.RASTER_SQL} LEFT JOIN (SELECT cell, CASE WHEN count(v.z) = 8 THEN sum(v.z) END AS s FROM {ROSE} p LEFT JOIN {_corners(ROSE, P.RASTER_SQL, 'id', ['z'], tolerance=0.0)} v USING (id) GROUP BY cell) ON cell = "row" * 64 + col""", "curvature", "row col", places=5)
def scale_curvature(spark, sf):
    cells = P.raster(spark, sf)
    return model.scale_curvature(cells, P.extent(cells), 120.0, P.CELL, P.CELL).select("domain", "row", "col", "curvature")


@query(f'SELECT domain, "row", col, z FROM {P.RASTER_SQL} WHERE z IS NOT NULL ORDER BY pow("row" - ({ROWS} - 1) / 2.0, 2) + pow(col - 31.5, 2), "row", col LIMIT 1', "z", "row col")
def centre_cell(spark, sf):
    cells = P.raster(spark, sf)
    return reports.centre_cell(cells, P.extent(cells))


@query(f"SELECT domain, avg(z - 20) AS mean_m, min(z - 20) AS min_m, max(z - 20) AS max_m, max(z) - min(z) AS spread_m FROM {P.RASTER_SQL} GROUP BY domain", "mean_m min_m max_m spread_m")
def terrain_offset(spark, sf):
    cells = P.raster(spark, sf)
    return reports.terrain_offset(cells, P.extent(cells).select("domain", F.lit(20.0).alias("model_z")))


@query(f"SELECT nation, min(elevation) AS lowest, max(elevation) AS highest, max(abs(elevation - 1500) / 100) AS peak_speed FROM {P.PLACES_SQL} GROUP BY nation", "lowest highest peak_speed", "nation")
def field_range(spark, sf):
    return reports.field_range(P.places(spark, sf).withColumn("speed", F.abs(F.col("elevation") - 1500) / 100), ["nation"], "elevation", "speed")


@query(f"SELECT nation, count(*) FILTER (WHERE abs(elevation - (1500 + (id % 13) * 40)) <= 50) AS n, count(*) FILTER (WHERE abs(elevation - (1500 + (id % 13) * 40)) > 50) AS suspects FROM {P.PLACES_SQL} GROUP BY nation", "", "nation")
def class_counts(spark, sf):
    return reports.class_counts(P.places(spark, sf), "nation", G.elevation_check("elevation", 1500 + (F.col("id") % 13) * 40).isNotNull())


@query(f"SELECT coalesce(CAST(h AS VARCHAR), 'unpublished') AS height, count(e) AS n, avg(e) AS bias, sqrt(avg(e * e)) AS rmse FROM (SELECT CASE WHEN line < 5 THEN line END AS h, mod_speed - obs_speed AS e FROM {P.PAIRS_SQL}) GROUP BY 1", "bias rmse")
def score_by_sensor_height(spark, sf):
    p = P.pairs(spark, sf).withColumn("sensor", F.when(F.col("line") < 5, F.col("line")))
    return reports.by_sensor_height(p, "sensor", F.col("mod_speed") - F.col("obs_speed"))


@query(f"SELECT line, count(d) AS samples, sqrt(avg(d * d)) AS model_rms, sqrt(4.0 + avg(d * d)) AS noise_rmse FROM (SELECT line, mod_speed - obs_speed AS d FROM {P.PAIRS_SQL}) GROUP BY line", "model_rms noise_rmse", "line")
def gradient_as_noise(spark, sf):
    return reports.gradient_as_noise(P.pairs(spark, sf).withColumn("difference", F.col("mod_speed") - F.col("obs_speed")), ["line"], 2.0)


@query("SELECT o_custkey, count(*) AS entries, max(o_orderkey) AS age_s, bool_or(o_totalprice > 200000) AS stale, arg_max(o_orderstatus, o_orderkey) AS error FROM orders GROUP BY o_custkey")
def retained_summary(spark, sf):
    e = P.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("age_s"), (F.col("o_totalprice") > 200000).alias("stale"), F.col("o_orderstatus").alias("error"))
    return reports.retained_summary(e, ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) = 1", "l_quantity", "l_linenumber")
def latest_wins(spark, sf):
    return reports.latest_wins(P.table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_quantity"])


@query(f"SELECT id, CASE WHEN ok THEN lat + d ELSE lat END AS lat, CASE WHEN ok THEN 'refined' ELSE 'catalogue' END AS position_source, CASE WHEN NOT ok AND has THEN d END AS disagreement FROM (SELECT *, id % 4 <> 0 AS has, (id % 5) * 0.004 AS d, id % 4 <> 0 AND (id % 5) * 0.004 <= 0.011 AS ok FROM {P.PLACES_SQL})", "lat disagreement")
def refined_positions(spark, sf):
    p = P.places(spark, sf)
    d = (F.col("id") % 5) * F.lit(0.004)
    r = p.where("id % 4 <> 0").select("id", (F.col("lat") + d).alias("r_lat"), F.col("lon").alias("r_lon"), F.lit(None).cast("double").alias("r_elevation"))
    return reports.refined_positions(p, r, "id").select("id", "lat", "position_source", "disagreement")


@query('SELECT domain, avg(CASE WHEN z IS NULL THEN 1.0 ELSE 0.0 END) AS void_share, row_number() OVER (ORDER BY avg(CASE WHEN z IS NULL THEN 1.0 ELSE 0.0 END), domain) AS place FROM (SELECT \'d\' || ("row" % 5) AS domain, z FROM ' + P.RASTER_SQL + ") GROUP BY domain", "void_share")
def least_void_first(spark, sf):
    return reports.least_void_first(P.raster(spark, sf).withColumn("domain", F.concat(F.lit("d"), F.col("row") % 5)))


FRACTIONS = T.layer_fractions(4, 1.5)


@query(f"SELECT id, k AS layer, elevation * [{', '.join(repr(sum(FRACTIONS[:k])) for k in range(5))}][k + 1] AS interface FROM {P.PLACES_SQL}, (SELECT unnest(range(0, 5)) AS k)", "interface")
def interface_heights(spark, sf):
    return reports.interface_heights(P.places(spark, sf), FRACTIONS, "elevation").select("id", "layer", "interface")


@query(f"SELECT p_partkey, CASE p_size % 9 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(T.ROUGHNESS.values()))} ELSE p_size / 10.0 END::DOUBLE AS z0, CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE 1.0 END::DOUBLE AS ratio FROM part", "z0 ratio")
def roughness_and_stability(spark, sf):
    s = F.col("p_size")
    spec = F.when(s % 9 < 8, F.get(F.array(*map(F.lit, T.ROUGHNESS)), (s % 9).cast("int"))).otherwise((s / 10).cast("string"))
    return P.table(spark, sf, "part").select("p_partkey", T.roughness_length(spec).alias("z0"), T.stability_ratio(F.when(s % 2 == 0, "stable")).alias("ratio"))


@query("SELECT p_partkey, CASE WHEN floor(30.0 / p_size * 1.01) >= 2 THEN floor(30.0 / p_size * 1.01) ELSE 1 END::BIGINT AS factor, greatest(p_size * 10 / 2.0, 300) + 10 AS padding, CASE WHEN p_size % 3 = 0 THEN 'no-resolution' WHEN CASE WHEN floor(30.0 / p_size * 1.01) >= 2 THEN floor(30.0 / p_size * 1.01) ELSE 1 END <> 2 THEN 'other-coarsening' WHEN p_partkey % 2 = 0 THEN 'other-box' END AS stale FROM part", "padding")
def stored_grid_rules(spark, sf):
    s = F.col("p_size").cast("double")
    read = F.when(F.col("p_size") % 3 != 0, s)
    return P.table(spark, sf, "part").select("p_partkey", T.coarsen_factor(F.lit(30.0), s).cast("bigint").alias("factor"), T.padding(s * 10, 300.0, 10.0).alias("padding"), T.stale_grid_reason(F.lit(30.0), read, F.lit(2), (1 - F.col("p_partkey") % 2) * F.lit(0.01)).alias("stale"))


@query(f"SELECT id, CASE WHEN elevation / 50 >= 39 THEN '#d7191c' WHEN elevation / 50 >= 32 THEN '#e76818' WHEN elevation / 50 >= 25 THEN '#f29e2e' WHEN elevation / 50 >= 19 THEN '#f9d057' WHEN elevation / 50 >= 13 THEN '#90eb9d' WHEN elevation / 50 >= 8 THEN '#00ccbc' WHEN elevation / 50 >= 4 THEN '#00a6ca' ELSE '#2c7bb6' END AS speed_colour, greatest(2, floor(100 * 0.5 * {G.METRES_PER_DEGREE} / (0.7 * greatest({G.METRES_PER_DEGREE} * cos(radians(lat + 0.25)), 1)) + 0.5)) AS rows_needed FROM {P.PLACES_SQL}", "", "rows_needed")
def map_rules(spark, sf):
    p = P.places(spark, sf)
    return p.select("id", T.colour(F.col("elevation") / 50, T.SPEED_STOPS).alias("speed_colour"), T.rows_for_columns(F.col("lat"), F.col("lat") + 0.5, F.col("lon"), F.col("lon") + 0.7, 100).cast("bigint").alias("rows_needed"))


@query(f"SELECT id, lat BETWEEN 21.1 AND 52.6 AND lon BETWEEN -134.1 AND -60.9 AS inside, lon > lon + elevation - 1500 AS crosses, contains(lower('st-' || id), '1') AS found, nation % 3 = 0 AS in_states FROM {P.PLACES_SQL}")
def station_filters(spark, sf):
    p = P.places(spark, sf).withColumns({"name": F.concat(F.lit("ST-"), "id"), "state": F.get(F.array(F.lit("co"), F.lit(" Ut "), F.lit("NM")), (F.col("nation") % 3).cast("int"))})
    return p.select("id", T.in_conus("lat", "lon").alias("inside"), T.crosses_antimeridian("lon", F.col("lon") + F.col("elevation") - 1500).alias("crosses"), T.station_search("1", ["name"]).alias("found"), T.in_states("state", "CO, ut").alias("in_states"))


@query("SELECT count(*) FILTER (WHERE extract('minute' FROM ts) >= 57 OR extract('minute' FROM ts) <= 3) AS on_hour, count(*) FILTER (WHERE ts BETWEEN date_trunc('day', ts) + INTERVAL 6 HOURS - INTERVAL 600 SECONDS AND date_trunc('day', ts) + INTERVAL 12 HOURS + INTERVAL 600 SECONDS) AS in_window FROM events")
def time_filters(spark, sf):
    day = F.date_trunc("day", "ts")
    e = P.table(spark, sf, "events")
    return e.agg(F.count_if(T.near_the_hour("ts")).alias("on_hour"), F.count_if(T.within_window("ts", day + F.expr("interval 6 hours"), day + F.expr("interval 12 hours"), 600.0)).alias("in_window"))
