"""Rows in order: islands, ranges, newest of each, spreads, latest with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_windows(df: DataFrame, by: list[str], at: str, gap: Column, pad: Column | None = None) -> DataFrame:
    """Instants no more than ``gap`` apart are one window; ``pad`` is added at both ends."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.col(at) > F.lag(at).over(w) + gap, 1).otherwise(0)
    g = df.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min(at), F.max(at)
    return g.groupBy(*by, "_g").agg((first - pad if pad is not None else first).alias("begin"), (last + pad if pad is not None else last).alias("finish"), F.count("*").alias("n")).drop("_g")


def merge_ranges(df: DataFrame, by: list[str], begin: str, end: str, gap: int) -> DataFrame:
    """Ranges whose distance from the furthest end so far is at most ``gap`` become one."""
    w = Window.partitionBy(*by).orderBy(begin, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = df.withColumn("_n", F.when(F.col(begin) - far > gap, 1).otherwise(0)).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*by, "_g").agg(F.min(begin).alias("begin"), F.max(end).alias("finish"), F.count("*").alias("n")).drop("_g")


def open_ends(df: DataFrame, by: list[str], start: str) -> DataFrame:
    """``last``: one before the next start; null for the last one."""
    return df.withColumn("last", F.lead(start).over(Window.partitionBy(*by).orderBy(start)) - 1)


def newest(df: DataFrame, by: list[str], at: str, seq: str) -> DataFrame:
    """The newest row of each key (first in ``seq`` of equals); a missing time is older than any."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(at).desc_nulls_last(), seq))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def latest_or_reason(keys: DataFrame, kept: DataFrame, rejected: DataFrame, key: str, at: str, seq: str, values: list[str]) -> DataFrame:
    """Every key with its newest kept row, or nulls and the code of its last reject (``no-report`` without any)."""
    last = kept.groupBy(key).agg(F.max_by(F.struct(at, *values), F.struct(at, -F.col(seq))).alias("r"))
    why = rejected.groupBy(key).agg(F.max_by("code", seq).alias("_code"))
    return keys.join(last, key, "left").join(why, key, "left").select(*keys.columns, "r.*", F.when(F.col("r").isNull(), F.coalesce("_code", F.lit("no-report"))).alias("reason"))


def spread(df: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """``count`` rows of each key at even ranks round(i (n - 1) / (count - 1)), once each; one: the lower middle."""
    r = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    if count == 1:
        return r.where(F.col("_i") == F.floor((F.col("_n") - 1) / 2)).drop("_i", "_n")
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (count - 1) + 0.5))
    return r.where(F.array_contains(picks, F.col("_i").cast("bigint"))).drop("_i", "_n")


def steps(df: DataFrame, by: list[str], at: str, value: str, gap_s: int) -> DataFrame:
    """Change of ``value`` between rows exactly ``gap_s`` seconds apart."""
    w = Window.partitionBy(*by).orderBy(at)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    return df.withColumn("_d", us - F.lag(us).over(w)).withColumn("step", F.col(value) - F.lag(value).over(w)).where(F.col("_d") == gap_s * 1_000_000).drop("_d")
