"""Aggregates of comparisons, surveys and stored listings, all combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import small

#: Degrees within which a refined position agrees with the catalogue's.
POSITION_AGREEMENT = 0.011


def median_ratio(comparisons: DataFrame, by: list[str], ratio: str = "ratio") -> DataFrame:
    """``compared`` and ``median_ratio`` (of two middle ones the mean) of what can be compared."""
    return comparisons.groupBy(*by).agg(F.count(ratio).alias("compared"), F.median(ratio).alias("median_ratio"))


def centre_cell(cells: DataFrame, extent: DataFrame, value: str = "z") -> DataFrame:
    """The cell with a value nearest to each domain's centre; of equally near ones the first by row, then column."""
    j = cells.where(F.col(value).isNotNull()).join(small(extent), "domain")
    d = F.pow(F.col("row") - (F.col("height") - 1) / 2, 2) + F.pow(F.col("col") - (F.col("width") - 1) / 2, 2)
    return j.groupBy("domain").agg(F.min(F.struct(d.alias("d"), "row", "col", F.col(value).alias(value))).alias("m")).select("domain", "m.row", "m.col", f"m.{value}")


def terrain_offset(cells: DataFrame, model: DataFrame, value: str = "z") -> DataFrame:
    """Mean, least, most and spread of the ground less the model's height (``model``: domain, model_z) of each domain."""
    d = F.col(value) - F.col("model_z")
    return cells.where(F.col(value).isNotNull()).join(small(model), "domain").groupBy("domain").agg(F.avg(d).alias("mean_m"), F.min(d).alias("min_m"), F.max(d).alias("max_m"), (F.max(d) - F.min(d)).alias("spread_m"))


def field_range(cells: DataFrame, by: list[str], elevation: str, speed: str) -> DataFrame:
    """Lowest and highest ground, and the peak speed."""
    return cells.groupBy(*by).agg(F.min(elevation).alias("lowest"), F.max(elevation).alias("highest"), F.max(speed).alias("peak_speed"))


def class_counts(stations: DataFrame, kind: str, suspect: Column) -> DataFrame:
    """Stations of each class without the suspects, and the suspects beside them."""
    s = F.coalesce(suspect, F.lit(False))
    return stations.groupBy(kind).agg(F.count_if(~s).alias("n"), F.count_if(s).alias("suspects"))


def by_sensor_height(pairs: DataFrame, height: str, error: Column) -> DataFrame:
    """Pairs, bias and RMSE by published sensor height; ``unpublished`` where it is missing."""
    return pairs.groupBy(F.coalesce(F.col(height).cast("string"), F.lit("unpublished")).alias("height")).agg(F.count(error).alias("n"), F.avg(error).alias("bias"), F.sqrt(F.avg(error * error)).alias("rmse"))


def gradient_as_noise(displaced: DataFrame, by: list[str], rmse_at_station: float) -> DataFrame:
    """RMS of model against displaced model (``difference``), and the score if that were added error: roots of summed squares."""
    q = F.avg(F.col("difference") * F.col("difference"))
    return displaced.groupBy(*by).agg(F.count("difference").alias("samples"), F.sqrt(q).alias("model_rms"), F.sqrt(F.lit(rmse_at_station**2) + q).alias("noise_rmse"))


def retained_summary(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries, the oldest one's age and error, and whether any is stale (entries: age_s, stale, error)."""
    return entries.groupBy(*by).agg(F.count("*").alias("entries"), F.max("age_s").alias("age_s"), F.bool_or("stale").alias("stale"), F.max_by("error", "age_s").alias("error"))


def latest_wins(batches: DataFrame, key: list[str], batch: str, values: list[str]) -> DataFrame:
    """Right-biased union of batches: for each key the row of the last batch."""
    return batches.groupBy(*key).agg(F.max(F.struct(batch, *values)).alias("m")).select(*key, "m.*")


def refined_positions(catalogue: DataFrame, refined: DataFrame, key: str) -> DataFrame:
    """Catalogue with the refined position (key, r_lat, r_lon, r_elevation) where it agrees within POSITION_AGREEMENT, else as it was.

    ``position_source`` tells which; ``disagreement`` is the larger difference in degrees where they don't agree.
    """
    j = catalogue.join(refined, key, "left")
    gap = F.greatest(F.abs(F.col("lat") - F.col("r_lat")), F.abs(F.col("lon") - F.col("r_lon")))
    ok = F.coalesce(gap <= POSITION_AGREEMENT, F.lit(False))
    out = j.withColumns({"_ok": ok, "disagreement": F.when(~ok, gap)})
    return out.withColumns({"lat": F.when(F.col("_ok"), F.col("r_lat")).otherwise(F.col("lat")), "lon": F.when(F.col("_ok"), F.col("r_lon")).otherwise(F.col("lon")), "elevation": F.when(F.col("_ok"), F.coalesce("r_elevation", "elevation")).otherwise(F.col("elevation")), "position_source": F.when(F.col("_ok"), "refined").otherwise("catalogue")}).drop("_ok", "r_lat", "r_lon", "r_elevation")


def least_void_first(cells: DataFrame, value: str = "z") -> DataFrame:
    """Domains with their share of void cells and their place in the order that fills with the fewest voids first (ties by name)."""
    share = cells.groupBy("domain").agg(F.avg(F.col(value).isNull().cast("double")).alias("void_share"))
    from pyspark.sql import Window

    return share.withColumn("place", F.row_number().over(Window.orderBy("void_share", "domain")))  # a row for each product


def interface_heights(ground: DataFrame, fractions: list[float], top: str = "depth") -> DataFrame:
    """Heights of the layer interfaces above each column's ground: running sums of the layers' shares of the depth."""
    upto = [sum(fractions[:k]) for k in range(len(fractions) + 1)]
    return ground.select("*", F.posexplode(F.array(*map(F.lit, upto))).alias("layer", "_share")).withColumn("interface", F.col("_share") * F.col(top)).drop("_share")
