"""Joins of model to measurement: nearest in time, within a band, nearest in space.

Times are timestamps. The side called samples carries a sequence column: of samples equally near, the first in it wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(time: str | Column) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp") if isinstance(time, str) else time.cast("timestamp"))


def nearest_in_time(obs: DataFrame, samples: DataFrame, by: list[str], time: str, seq: str, tolerance_s: float = 600.0, values: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Left join: each observation with the sample of least |difference| within the tolerance (inclusive), or nulls.

    Both sides are dealt by (keys, time bucket as wide as the tolerance), an observation to its bucket and the two beside it, so
    work is linear and one busy station spreads over many tasks. ``key`` identifies an observation. Adds ``sample_*`` columns
    and ``offset_us`` (sample less observation).
    """
    width = int(tolerance_s * 1e6)
    values = values or [c for c in samples.columns if c not in (*by, time, seq)]
    s = samples.select(*by, micros(time).alias("_s"), F.struct(F.col(time).alias(f"sample_{time}"), F.col(seq).alias(f"sample_{seq}"), *[F.col(v).alias(f"sample_{v}") for v in values]).alias("_v"), F.col(seq).alias("_q")).withColumn("_b", F.floor(F.col("_s") / width))
    o = obs.select(key, *by, micros(time).alias("_t")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_t") / width) + d for d in (-1, 0, 1)])))
    gap = F.abs(F.col("_s") - F.col("_t"))
    best = o.join(s, [*by, "_b"]).where(gap <= width).groupBy(key).agg(F.min_by(F.struct("_v", (F.col("_s") - F.col("_t")).alias("offset_us")), F.struct(gap, F.col("_q"))).alias("_m"))
    return obs.join(best, key, "left").select(*obs.columns, "_m._v.*", F.col("_m.offset_us").alias("offset_us"))


#: Seconds of a time bucket: what a task sorts is one key's distinct instants in it.
BUCKET_S = 86400.0


def _carried(buckets: DataFrame, instants: DataFrame, by: list[str], back: bool) -> DataFrame:
    """For each (key, bucket) of ``buckets`` the last instant of all buckets before it (``back``) or the first of all after it: (by, _b, _t, _q).

    The window that reaches over buckets has one row for each of them, however many samples a key has.
    """
    ends = instants.groupBy(*by, "_b").agg((F.max if back else F.min)(F.struct("_t", "_q")).alias("_e"))
    none = F.lit(None).cast(ends.schema["_e"].dataType).alias("_e")
    marks = ends.select(*by, "_b", "_e", F.lit(False).alias("_a")).unionByName(buckets.select(*by, "_b", none, F.lit(True).alias("_a"))).groupBy(*by, "_b").agg(F.max("_e").alias("_e"), F.bool_or("_a").alias("_a"))
    over = Window.partitionBy(*by).orderBy(F.asc("_b") if back else F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("_c", F.last("_e", True).over(over)).where("_a and _c is not null").select(*by, "_b", "_c.*")


def _beside(obs: DataFrame, samples: DataFrame, by: list[str], time: str, seq: str, sides: list[str], bucket_s: float) -> DataFrame:
    """``obs`` with ``_o`` (its time in microseconds) and structs (_t, _q) of the last sample at or before it (``back``), the first at or after it (``ahead``), as ``sides`` asks.

    Instants are made distinct first (of samples at one time the first in sequence stands), then dealt by (key, bucket); a bucket begins with what is carried
    into it from the buckets before. Observations join the answers by key and time, so many at one instant are one question. Null keys and times find nothing.
    """
    width = int(bucket_s * 1e6)
    dealt = lambda df: df.where("_t is not null").withColumn("_b", F.floor(F.col("_t") / width))
    asked = dealt(obs.select(*by, micros(time).alias("_t"))).distinct()
    instants = dealt(samples.select(*by, micros(time).alias("_t"), F.col(seq).cast("bigint").alias("_q"))).groupBy(*by, "_b", "_t").agg(F.min("_q").alias("_q"))
    buckets = asked.select(*by, "_b").distinct()
    known = instants.select(*by, "_b", "_t", "_q")
    for side in sides:
        known = known.unionByName(_carried(buckets, instants, by, side == "back"))
    known = known.select(*by, "_b", "_t", F.struct("_t", "_q").alias("_s"))
    both = known.unionByName(asked.select(*by, "_b", "_t", F.lit(None).cast(known.schema["_s"].dataType).alias("_s")))
    # both directions look back over rows that are there already: a frame that ends with the partition would be read again for each row
    order = {"back": F.asc("_t"), "ahead": F.desc("_t")}
    over = {k: Window.partitionBy(*by, "_b").orderBy(order[k], F.isnull("_s")).rowsBetween(Window.unboundedPreceding, 0) for k in sides}
    found = both.withColumns({k: F.last("_s", True).over(over[k]) for k in sides}).where("_s is null").select(*by, F.col("_t").alias("_o"), *sides)
    return obs.withColumn("_o", micros(time)).join(found, [*by, "_o"], "left")


def nearest_either_side(obs: DataFrame, samples: DataFrame, by: list[str], time: str, seq: str, bucket_s: float = BUCKET_S) -> DataFrame:
    """For each observation the nearest sample at any distance: ``nearest_us`` (signed) and ``nearest_seq``; null without samples. Of equally near ones the first in sequence."""
    both = _beside(obs, samples, by, time, seq, ["back", "ahead"], bucket_s)
    gap = lambda k: F.abs(F.col(f"{k}._t") - F.col("_o"))
    nearer = (gap("back") < gap("ahead")) | ((gap("back") == gap("ahead")) & (F.col("back._q") <= F.col("ahead._q")))
    best = F.when(F.col("ahead").isNull() | nearer, F.col("back")).otherwise(F.col("ahead"))
    return both.select(*obs.columns, (best["_t"] - F.col("_o")).alias("nearest_us"), best["_q"].alias("nearest_seq"))


def band(obs: DataFrame, samples: DataFrame, by: list[str], time: str, half_s: float, key: str, aggregates: list[Column], columns: list[str]) -> DataFrame:
    """Left join with all samples within ``half_s`` either side, aggregated; ``columns`` of the samples are at hand for ``aggregates``."""
    width = int(half_s * 1e6)
    s = samples.select(*by, micros(time).alias("_s"), *columns).withColumn("_b", F.floor(F.col("_s") / width))
    o = obs.select(key, *by, micros(time).alias("_t")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_t") / width) + d for d in (-1, 0, 1)])))
    return obs.join(o.join(s, [*by, "_b"]).where(F.abs(F.col("_s") - F.col("_t")) <= width).groupBy(key).agg(*aggregates), key, "left")


def as_of(obs: DataFrame, samples: DataFrame, by: list[str], time: str, seq: str, bucket_s: float = BUCKET_S) -> DataFrame:
    """The last sample at or before each observation: ``asof_us`` (not positive) and ``asof_seq``; of samples at one time the first in sequence."""
    got = _beside(obs, samples, by, time, seq, ["back"], bucket_s)
    return got.select(*obs.columns, (F.col("back._t") - F.col("_o")).alias("asof_us"), F.col("back._q").alias("asof_seq"))


def same_time(a: DataFrame, b: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Full outer join of two networks on equal keys; ``side`` says both, a or b."""
    x = a.select(*by, F.struct(*values).alias("a"))
    y = b.select(*by, F.struct(*values).alias("b"))
    return x.join(y, by, "full_outer").withColumn("side", F.when(F.col("b").isNull(), "a").when(F.col("a").isNull(), "b").otherwise("both"))


def nearest_place(points: DataFrame, places: DataFrame, key: str, distance: Column, order: str, keep: list[str], max_distance: float, cell: float) -> DataFrame:
    """Left join with the nearest place, by a grid: points go to the nine cells around them, places to their own.

    ``places`` has columns named ``p_lat`` and ``p_lon``; ``cell`` in degrees must be at least as wide as ``max_distance`` in either direction.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    nine = F.explode(F.array(*[F.struct((at("lat") + i).alias("y"), (at("lon") + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = places.withColumn("y", at("p_lat")).withColumn("x", at("p_lon"))
    near = points.select(key, "lat", "lon", nine.alias("c")).select(key, "lat", "lon", "c.*").join(p, ["y", "x"]).withColumn("_d", distance).where(F.col("_d") <= max_distance)
    best = near.groupBy(key).agg(F.min_by(F.struct(*keep, F.col("_d").alias("distance")), F.struct("_d", order)).alias("m"))
    return points.join(best, key, "left").select(*points.columns, "m.*")
