"""Registered queries on the raster seen in degrees, whose columns lie closer on its northern rows; each with its SQL."""

from __future__ import annotations

from ..functions import geo as G
from ..operators import grid, kernels, model
from . import proxies as P
from .catalogue import OK9, STENCIL, query, stencil
from .comparisons import _corners

PLACE = G.Degrees(60.0, 0.0001)
DY = PLACE.down
DX = f"({PLACE.step} * greatest({G.METRES_PER_DEGREE} * cos(radians({PLACE.first_lat} - \"row\" * {PLACE.step})), 1))"
D, E, FF = f"(((e + w) / 2 - z) / ({DX} * {DX}))", f"(((n + s) / 2 - z) / ({DY} * {DY}))", f"((-nw + ne + sw - se) / (4 * {DX} * {DY}))"
GG, HH = f"((e - w) / (2 * {DX}))", f"((n - s) / (2 * {DY}))"
Q = f"({GG} * {GG} + {HH} * {HH})"


@query(f"""SELECT domain, "row", col, CASE WHEN {OK9} THEN -2 * ({D} + {E}) END AS total_curv, CASE WHEN {OK9} AND {Q} > 0 THEN -2 * ({D} * {GG} * {GG} + {E} * {HH} * {HH} + {FF} * {GG} * {HH}) / {Q} END AS profile_curv FROM ({STENCIL})""", "total_curv profile_curv", "row col")
def geographic_curvature(spark, sf):
    return grid.curvature(stencil(spark, sf), PLACE.along("row"), PLACE.down).select("domain", "row", "col", "total_curv", "profile_curv")


RADIUS = 70.0
REACH = int(RADIUS // DY)
HALF = lambda d: f"floor(sqrt({RADIUS * RADIUS} - pow({d} * {DY}, 2)) / dx)"


@query(f"""WITH r AS MATERIALIZED (SELECT *, {DX} AS dx FROM {P.RASTER_SQL}), o AS (SELECT unnest(range({-REACH}, {REACH + 1})) AS d),
 m AS (SELECT r."row", r.col, sum(b.z) AS s, count(b.z) AS n FROM r CROSS JOIN o JOIN {P.RASTER_SQL} b ON b."row" = r."row" + d AND b.col BETWEEN r.col - {HALF('d')} AND r.col + {HALF('d')} GROUP BY r."row", r.col),
 z AS (SELECT "row", any_value({HALF('0')}) AS reach, sum(2 * {HALF('d')} + 1) AS size FROM (SELECT DISTINCT "row", dx FROM r) CROSS JOIN o GROUP BY "row")
 SELECT r.domain, r."row", r.col, CASE WHEN r."row" >= {REACH} AND r."row" < (SELECT count(*) FROM embeddings) - {REACH} AND r.col >= reach AND r.col < {P.WIDTH} - reach AND n >= 0.9 * size THEN s / n END AS disc_mean FROM r LEFT JOIN m USING ("row", col) JOIN z USING ("row")""", "disc_mean", "row col")
def geographic_disc_mean(spark, sf):
    return kernels.disc_mean_tiled(P.raster(spark, sf), RADIUS, PLACE, PLACE.down, tile=64)


LENGTH = 60.0
SIDE, DIAGONAL = LENGTH / 2, LENGTH / 2 / 2**0.5
ENDS = f"(SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([0, 0, {-SIDE}, {SIDE}, {-DIAGONAL}, {DIAGONAL}, {DIAGONAL}, {-DIAGONAL}]) AS ox, unnest([{-SIDE}, {SIDE}, 0, 0, {-DIAGONAL}, {DIAGONAL}, {-DIAGONAL}, {DIAGONAL}]) AS oy)"
ROSE = f"(SELECT \"row\" * 64 + col AS cell, (\"row\" * 64 + col) * 8 + k AS id, 'd' AS domain, \"row\" + oy / {DY} AS y, col + ox / {DX} AS x FROM {P.RASTER_SQL}, {ENDS} WHERE z IS NOT NULL)"


@query(f"""SELECT domain, "row", col, (4 * z - s / 2) / {LENGTH} / 4 AS curvature FROM {P.RASTER_SQL} LEFT JOIN (SELECT cell, CASE WHEN count(v.z) = 8 THEN sum(v.z) END AS s FROM {ROSE} p LEFT JOIN {_corners(ROSE, P.RASTER_SQL, 'id', ['z'], tolerance=0.0)} v USING (id) GROUP BY cell) ON cell = "row" * 64 + col""", "curvature", "row col", places=5)
def geographic_scale_curvature(spark, sf):
    cells = P.raster(spark, sf)
    return model.scale_curvature(cells, P.extent(cells), LENGTH, PLACE.along("row"), PLACE.down).select("domain", "row", "col", "curvature")
