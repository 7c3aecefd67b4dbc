"""Registered queries that read derived fields of the raster at points; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shelters
from . import proxies as P
from .catalogue import GX, GY, OK9, STENCIL, points, query, stencil
from .comparisons import _corners

#: Parts as points (see catalogue.points), with a wind's bearing between -180 and 540.
POINTS = "(SELECT p_partkey AS id, fmod(p_partkey * 0.37::DOUBLE, 499) - 0.25 AS y, fmod(p_partkey * 0.71::DOUBLE, 63) - 0.25 AS x, CAST(p_partkey * 53 % 720 - 180 AS DOUBLE) AS from_deg FROM part)"


def asked(spark, sf):
    size = P.extent(P.raster(spark, sf)).select("height", "width")
    return points(spark, sf).withColumn("from_deg", (F.col("id") * 53 % 720 - 180).cast("double")).crossJoin(F.broadcast(size))


SLOPES = f'(SELECT "row", col, CASE WHEN {OK9} THEN {GX} END AS dzdx, CASE WHEN {OK9} THEN {GY} END AS dzdy FROM ({STENCIL}))'


@query(f"""SELECT p.id, CASE WHEN dzdx <> 0 OR dzdy <> 0 THEN fmod(degrees(atan2(-dzdx, -dzdy)) + 360, 360) END AS aspect_deg FROM {POINTS} p LEFT JOIN {_corners(POINTS, SLOPES, "id", ["dzdx", "dzdy"], tolerance=0.5)} USING (id)""", "aspect_deg", places=4)
def aspect_at(spark, sf):
    return shelters.aspect_at(asked(spark, sf), shelters.gradients(stencil(spark, sf), P.CELL, P.CELL)).select("id", "aspect_deg")


#: Sectors of uneven widths, in which cells see a tenth of their height and three degrees for each sector; some see nothing.
CENTRES = [10.0, 55.0, 90.0, 180.0, 200.0, 315.0]
SECTORS = f'(SELECT "row", col, CAST(s AS VARCHAR) AS domain, z / 10 + 3 * s AS sx FROM {P.RASTER_SQL}, (SELECT unnest(range(0, {len(CENTRES)})) AS s) WHERE ("row" + col + s) % 41 <> 0)'
LIST = f"{CENTRES}"
LOWER = f"(SELECT *, coalesce(nullif(len(list_filter({LIST}, lambda c: c <= a)), 0), {len(CENTRES)}) AS lo FROM (SELECT *, fmod(fmod(from_deg, 360) + 360, 360) AS a FROM {POINTS}))"
BETWEEN = f"(SELECT *, lo % {len(CENTRES)} + 1 AS hi, fmod(a - {LIST}[lo] + 360, 360) / fmod({LIST}[lo % {len(CENTRES)} + 1] - {LIST}[lo] + 360, 360) AS t FROM {LOWER})"
BOTH = f"(SELECT id, y, x, which, CAST(CASE WHEN which = 0 THEN lo ELSE hi END - 1 AS VARCHAR) AS domain FROM {BETWEEN}, (SELECT unnest([0, 1]) AS which))"


@query(f"""WITH r AS (SELECT id, sum(sx) FILTER (WHERE which = 0) AS sx_lo, sum(sx) FILTER (WHERE which = 1) AS sx_hi FROM {_corners(BOTH, SECTORS, "id, which", ["sx"], tolerance=0.5, level="sector")} GROUP BY id)
 SELECT b.id, sx_lo * (1 - t) + sx_hi * t AS shelter_deg FROM {BETWEEN} b LEFT JOIN r USING (id)""", "shelter_deg", places=4)
def shelter_at(spark, sf):
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CENTRES)]))
    c = F.col
    sx = P.raster(spark, sf).withColumn("s", at).where((c("row") + c("col") + c("s.i")) % 41 != 0).select("domain", "row", "col", c("s.c").alias("sector_deg"), (c("z") / 10 + 3 * c("s.i")).alias("sx_deg"))
    return shelters.shelter_at(asked(spark, sf), sx, CENTRES).select("id", "shelter_deg")
