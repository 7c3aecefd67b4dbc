"""Anomaly weights: ground that the wide raster knows weighs nothing, a hill on it does; a domain without wide ground is named."""

import pytest
from pyspark.sql import functions as F

from gustfield.functions import geo as G
from gustfield.operators import anomalies
from gustfield.operators.resample import Grid

UTM = G.Utm(13)
FINE, WIDE = Grid(UTM, 24, 24, 500000.0, 4430000.0, 10.0, -10.0), Grid(UTM, 16, 16, 499760.0, 4430240.0, 40.0, -40.0)


def raster(spark, place, height):
    cells = spark.range(place.width * place.height).select(F.lit("d").alias("domain"), F.floor(F.col("id") / place.width).cast("int").alias("row"), (F.col("id") % place.width).cast("int").alias("col"))
    x, y = F.lit(place.origin_x) + (F.col("col") + 0.5) * place.step_x, F.lit(place.origin_y) + (F.col("row") + 0.5) * place.step_y
    return cells.withColumn("z", height(x - 500120.0, y - 4429880.0).cast("double"))


def test_a_plane_has_no_anomaly_and_a_hill_has_one(spark):
    plane = lambda x, y: 1000 + x * 0.1 + y * 0.05
    hill = lambda x, y: plane(x, y) + 30 * F.exp(-(x * x + y * y) / 800)
    wide = raster(spark, WIDE, plane)
    flat = anomalies.residual(raster(spark, FINE, plane), FINE, wide, WIDE, 120.0, 40.0, 40.0, tile=8)
    assert flat.agg(F.max(F.abs("anomaly"))).first()[0] < 1e-6
    got = anomalies.residual(raster(spark, FINE, hill), FINE, wide, WIDE, 120.0, 40.0, 40.0, tile=8)
    assert tuple(anomalies.covered(got).first()) == ("d", 1.0, None)
    w = {(r.row, r.col): r for r in anomalies.weights(got, 10.0, 10.0, 40.0).collect()}
    assert len(w) == 24 * 24 and w[11, 11].anomaly == pytest.approx(30 * 2.718281828 ** (-50 / 800), abs=1e-3)
    best = max((r for r in w.values() if r.w_curv is not None), key=lambda r: r.w_curv)
    assert best.w_curv == pytest.approx(0.5) and best.row in (11, 12) and best.col in (11, 12)
    assert max(r.w_slope for r in w.values() if r.w_slope is not None) == pytest.approx(0.5)
    assert w[0, 0].w_slope is None and w[0, 0].anomaly is not None


def test_without_wide_ground_there_is_no_answer(spark):
    wide = raster(spark, WIDE, lambda x, y: F.lit(None))
    got = anomalies.residual(raster(spark, FINE, lambda x, y: x), FINE, wide, WIDE, 120.0, 40.0, 40.0, tile=8)
    assert tuple(anomalies.covered(got).first()) == ("d", 0.0, "anomaly-void")
