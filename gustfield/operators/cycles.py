"""Model cycles and products: which run is there at an hour, what it covers, which data set is the finest that does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes until a cycle is there; hours of forecast of the long cycles and of the rest.
DELAY_MIN, LONG_H, SHORT_H = 75, 48, 18


def micros_shift(time: Column, minutes: int | Column) -> Column:
    return F.timestamp_micros(F.unix_micros(time.cast("timestamp")) + (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("bigint") * 60_000_000)


def latest_cycle(now: str | Column) -> Column:
    """The newest cycle that is there at ``now``."""
    return F.date_trunc("hour", micros_shift(F.col(now) if isinstance(now, str) else now, -DELAY_MIN))


def longest_lead(cycle: str | Column) -> Column:
    """Hours of forecast of a cycle: more for those at 0, 6, 12 and 18 UTC."""
    return F.when(F.hour(cycle) % 6 == 0, LONG_H).otherwise(SHORT_H)


def series(cycles: DataFrame, cycle: str, hours: int) -> DataFrame:
    """One row for each lead (``lead_h``, ``valid_time``) of each cycle, as far as it goes and ``hours`` allows."""
    leads = F.sequence(F.lit(0), F.least(longest_lead(F.col(cycle)), F.lit(hours)))
    return cycles.withColumn("lead_h", F.explode(leads)).withColumn("valid_time", micros_shift(F.col(cycle), F.col("lead_h") * 60))


def finest_covering(candidates: DataFrame, by: list[str], resolution: str, coverage: str, enough: float = 0.999) -> DataFrame:
    """The finest data set of each box that covers it; null with the list of what was considered otherwise."""
    ok = F.when(F.col(coverage) >= enough, F.struct(resolution, "dataset"))
    return candidates.groupBy(*by).agg(F.min(ok).getField("dataset").alias("dataset"), F.array_sort(F.collect_list(F.struct(resolution, "dataset", coverage))).alias("considered"))


def displaced_reads(stations: DataFrame, metres: list[float], bearings: int = 8) -> DataFrame:
    """Each station moved by every distance in every direction: ``metres``, ``bearing``, ``lat2``, ``lon2``."""
    from ..functions.geo import displaced

    offsets = F.explode(F.array(*[F.struct(F.lit(float(m)).alias("metres"), F.lit(360.0 * k / bearings).alias("bearing")) for m in metres for k in range(bearings if m else 1)]))
    d = stations.withColumn("o", offsets).select(*stations.columns, "o.*")
    lat, lon = displaced("lat", "lon", "bearing", "metres")
    return d.withColumn("lat2", lat).withColumn("lon2", lon)
