"""Reports over pairs and rasters: terrain position at points, errors by displacement, arms compared without one station, strides, retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import signed_gap
from ..functions.sizes import small


def position_index(points: DataFrame, cells: DataFrame, key: str, radius: float, dx: float, dy: float, coverage: float = 0.9) -> DataFrame:
    """Height of a point over the mean of the disc around it: ``position``, ``samples``, ``share``.

    ``points`` has (domain, y, x, z, height, width), y and x fractional. Null unless the disc's box lies in the grid and ``coverage`` of
    its cells are there. Each point meets the cells of its disc by an equi-join on (domain, row, col).
    """
    c = F.col
    ry, rx = radius / dy, radius / dx
    fits = (F.floor(c("y") - ry) >= 0) & (F.ceil(c("y") + ry) <= c("height") - 1) & (F.floor(c("x") - rx) >= 0) & (F.ceil(c("x") + rx) <= c("width") - 1)
    span = lambda r: F.array(*map(F.lit, range(-math.ceil(r) - 1, math.ceil(r) + 2)))
    disc = points.where(fits).select(key, "domain", "y", "x", F.explode(span(ry)).alias("_r")).select("*", F.explode(span(rx)).alias("_c"))
    disc = disc.select(key, "domain", "y", "x", (F.floor("y") + c("_r")).cast("int").alias("row"), (F.floor("x") + c("_c")).cast("int").alias("col"))
    disc = disc.where(F.pow((c("row") - c("y")) * dy, F.lit(2)) + F.pow((c("col") - c("x")) * dx, F.lit(2)) <= radius**2)
    got = disc.join(cells.select("domain", "row", "col", c("z").alias("_z")), ["domain", "row", "col"], "left").groupBy(key).agg(F.count("*").alias("_n"), F.count("_z").alias("samples"), F.avg("_z").alias("_mean"))
    j = points.join(got, key, "left").withColumn("share", c("samples") / c("_n"))
    return j.withColumn("position", F.when(c("share") >= coverage, c("z") - c("_mean"))).drop("_n", "_mean")


def by_displacement(pairs: DataFrame, offset: str) -> DataFrame:
    """Errors of model reads by where they were taken: RMSE, least-squares scale, RMSE after it, arithmetic mean of the direction differences."""
    o, m, c = F.col("obs_speed"), F.col("mod_speed"), F.col
    both = o.isNotNull() & m.isNotNull()
    d = F.when((o >= 1) & c("obs_from").isNotNull() & c("mod_from").isNotNull() & both, signed_gap("mod_from", "obs_from"))
    s = pairs.groupBy(offset).agg(F.count_if(both).alias("n"), *[F.sum(F.when(both, e)).alias(k) for k, e in (("oo", o * o), ("mm", m * m), ("om", o * m))], F.avg(d).alias("dir_bias"), F.sqrt(F.avg(d * d)).alias("dir_rmse"))
    k = F.when(c("mm") > 0, c("om") / c("mm"))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) / c("n"))
    return s.select(offset, "n", root(c("mm") - 2 * c("om") + c("oo")).alias("rmse"), k.alias("scale"), root(k * k * c("mm") - 2 * k * c("om") + c("oo")).alias("scaled_rmse"), "dir_bias", "dir_rmse")


def arms(folds: DataFrame, arm: str, group: str, base: str) -> DataFrame:
    """Each arm against ``base``: difference of RMSE over all, its range when one group is left out, and whether the sign holds throughout.

    ``folds`` is what scoring.leave_one_out gives, with a column for the arm.
    """
    b = folds.where(F.col(arm) == base).select(group, F.col("full").alias("_f"), F.col("without").alias("_w"))
    d = folds.where(F.col(arm) != base).join(b, group).select(arm, group, (F.col("full") - F.col("_f")).alias("full"), (F.col("without") - F.col("_w")).alias("left"))
    return d.groupBy(arm).agg(F.first("full").alias("difference"), F.min("left").alias("least"), F.max("left").alias("most"), (F.countDistinct(F.signum("left")) == 1).alias("stable"))


def mean_gain(pairs: DataFrame, group: str, gain: Column) -> DataFrame:
    """Mean over groups of the mean within each: a group counts once, however many rows it has."""
    return pairs.groupBy(group).agg(F.avg(gain).alias("g")).agg(F.avg("g").alias("gain"), F.count("g").alias("groups"))


def strided(cells: DataFrame, extent: DataFrame, target: int) -> DataFrame:
    """Every s-th row and column, s the least with about ``target`` cells left."""
    s = F.greatest(F.ceil(F.sqrt(F.col("height") * F.col("width") / target)), F.lit(1))
    e = extent.select("domain", s.alias("_s"))
    return cells.join(small(e), "domain").where((F.col("row") % F.col("_s") == 0) & (F.col("col") % F.col("_s") == 0)).drop("_s")


def retained(entries: DataFrame, key: str, at: str, now: Column, fresh_days: int = 14, keep_days: int = 180, most: int = 2048) -> DataFrame:
    """Newest entry of each key with ``state``: fresh, stale (to fall back on) or gone (too old, or beyond the ``most`` newest)."""
    newest = entries.groupBy(key).agg(F.max(at).alias(at))
    age = (F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 86_400_000_000
    top = newest.orderBy(F.desc(at), key).limit(most).select(key, F.lit(True).alias("_top"))  # a bounded top-k
    return newest.join(small(top), key, "left").select(key, at, F.when((age > keep_days) | F.col("_top").isNull(), "gone").when(age > fresh_days, "stale").otherwise("fresh").alias("state"))
