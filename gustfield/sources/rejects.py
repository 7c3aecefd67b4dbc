"""Rows that aren't observations keep a code: the first rule that fails names it. Kept rows have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns every reader gives.
OBSERVATION = ["station_id", "time", "speed_mps", "from_deg", "calm", "gust_mps", "code"]


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """Null where no rule fails; rules are (what is wrong, its code) in order."""
    out = F.lit(None).cast("string")
    for wrong, code in reversed(rules):
        out = F.when(wrong, F.lit(code)).otherwise(out)
    return out


def kept(df: DataFrame) -> DataFrame:
    return df.where("code is null")


def rejected(df: DataFrame) -> DataFrame:
    return df.where("code is not null")


def counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """seen, kept, rejected, calm and with_direction (of the kept)."""
    ok = F.col("code").isNull()
    return df.groupBy(*(by or [])).agg(F.count("*").alias("seen"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"), F.count_if(ok & F.col("calm")).alias("calm"), F.count_if(ok & F.col("from_deg").isNotNull()).alias("with_direction"))


def strict(df: DataFrame) -> DataFrame:
    """Fails the query on the first row with a code."""
    return df.withColumn("code", F.when(F.col("code").isNull(), F.col("code")).otherwise(F.raise_error(F.col("code"))))
