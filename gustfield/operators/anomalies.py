"""Weights of the ground that a coarse model doesn't know: fine terrain less the wide, smoothed terrain under it, and what slopes and curves there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid, kernels, model, resample, wind


def residual(cells: DataFrame, place: resample.Grid, wide: DataFrame, wide_place: resample.Grid, radius: float, dx: float, dy: float, tile: int = 256) -> DataFrame:
    """``cells`` (domain, row, col, z) with ``anomaly``: z less the mean of a disc of ``radius`` on the wide raster (of ``dx`` x ``dy`` metres), read at the cell's centre.

    Void where either is: the wide raster must reach a radius beyond the fine one, or its edge has no anomaly.
    """
    smooth = kernels.disc_mean_tiled(wide, radius, dx, dy, tile=tile)
    got = resample.anomaly(cells.withColumnRenamed("domain", "_of"), place, smooth, wide_place, against="disc_mean")  # a grid's cells are one domain there
    return got.withColumnRenamed("_of", "domain")


def covered(anomalies: DataFrame) -> DataFrame:
    """Per domain the share of cells with an anomaly and the code ``anomaly-void`` where there is none: such a domain isn't flat, it has no answer."""
    share = anomalies.groupBy("domain").agg((F.count("anomaly") / F.count("*")).alias("defined_fraction"))
    return share.withColumn("code", F.when(F.col("defined_fraction") == 0, "anomaly-void"))


def weights(anomalies: DataFrame, dx: float, dy: float, length: float, scales: dict[str, float] | None = None) -> DataFrame:
    """domain, row, col, anomaly, slope_deg, aspect_deg, total_curv (of the scale ``length``), w_slope, w_curv of the anomaly instead of the ground; see wind.weights."""
    slopes = grid.slope_aspect(grid.neighbours(anomalies.select("domain", "row", "col", "anomaly"), "anomaly"), dx, dy, "anomaly")
    extent = anomalies.groupBy("domain").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    curves = model.scale_curvature(anomalies.select("domain", "row", "col", "anomaly"), extent, length, dx, dy, "anomaly").select("domain", "row", "col", F.col("curvature").alias("total_curv"))
    both = slopes.select("domain", "row", "col", "anomaly", "slope_deg", "aspect_deg").join(curves, ["domain", "row", "col"])
    return wind.weights(both, scales)
