"""Registered query: weights of the raster's anomaly against its wide, smoothed means; with its SQL."""

from __future__ import annotations

from ..operators import anomalies, grid
from . import proxies as P
from .catalogue import GX, GY, OK9, STENCIL, query
from .comparisons import ROSE, _corners
from .fields import COARSE, COARSE_COLS, COARSE_ROWS, COARSE_SQL, ON_COARSE, coarse, coarse_place, place, rows_of

#: Side of a wide cell, radius of the disc and length of the curvature, all in metres.
SIDE, RADIUS, LENGTH = COARSE * P.CELL, 480.0, 120.0
DISC = grid.disc(RADIUS, SIDE, SIDE)
REACH = max(r for r, _ in DISC)
SMOOTH = f"""SELECT a."row", a.col, CASE WHEN a."row" >= {REACH} AND a."row" < {COARSE_ROWS} - {REACH} AND a.col >= {REACH} AND a.col < {COARSE_COLS - REACH} AND count(b.z) >= {0.9 * len(DISC)} THEN sum(b.z) / count(b.z) END AS z
 FROM c a JOIN c b ON pow((b."row" - a."row") * {SIDE}, 2) + pow((b.col - a.col) * {SIDE}, 2) <= {RADIUS * RADIUS} GROUP BY a."row", a.col"""
ENDS = ROSE.replace(P.RASTER_SQL, "d")
CURVES = f"SELECT cell, CASE WHEN count(v.z) = 8 THEN sum(v.z) END AS s FROM {ENDS} p LEFT JOIN {_corners(ENDS, 'd', 'id', ['z'], tolerance=0.0)} v USING (id) GROUP BY cell"


@query(f"""WITH c AS MATERIALIZED {COARSE_SQL}, g AS MATERIALIZED ({SMOOTH}), b AS {_corners(ON_COARSE, "g", "id", ["z"], COARSE_ROWS, str(COARSE_COLS), 0.5)},
 d AS MATERIALIZED (SELECT a.domain, a."row", a.col, a.z - b.z AS z FROM {P.RASTER_SQL} a LEFT JOIN b ON b.id = a."row" * 64 + a.col),
 s AS (SELECT domain, "row", col, z, CASE WHEN {OK9} THEN atan(sqrt({GX} * {GX} + {GY} * {GY})) END AS slope FROM ({STENCIL.replace(P.RASTER_SQL, 'd')})), k AS ({CURVES}),
 j AS (SELECT s.*, (4 * z - k.s / 2) / {LENGTH} / 4 AS curve FROM s LEFT JOIN k ON k.cell = "row" * 64 + col)
 SELECT "row", col, z AS anomaly, slope / (2 * max(abs(slope)) OVER ()) AS w_slope, curve / (2 * max(abs(curve)) OVER ()) AS w_curv FROM j""", "anomaly w_slope w_curv", "row col", places=3)
def anomaly_weights(spark, sf):
    rows = rows_of(spark, sf)
    left = anomalies.residual(P.raster(spark, sf), place(rows), coarse(spark, sf), coarse_place(rows), RADIUS, SIDE, SIDE, tile=64)
    return anomalies.weights(left, P.CELL, P.CELL, LENGTH).select("row", "col", "anomaly", "w_slope", "w_curv")
