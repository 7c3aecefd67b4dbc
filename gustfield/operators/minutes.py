"""One-minute records: how fast a wind forgets itself, block means, regimes. A record has ``station``, ``minute`` (whole), ``speed``, ``from_deg``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import bearing_from, east, half_open_gap, north
from ..functions.sizes import small

#: Speeds above which both directions of a pair count (2 kt), in m/s.
STEADY = 2 * 1852 / 3600


def one_a_minute(records: DataFrame, seq: str) -> DataFrame:
    """Of several records of a minute the last in ``seq``."""
    return records.groupBy("station", "minute").agg(F.max_by(F.struct("speed", "from_deg"), seq).alias("r")).select("station", "minute", "r.*")


def lagged(records: DataFrame, lags: list[int]) -> DataFrame:
    """Each record with the one ``lag`` minutes later, where there is one.

    Both sides are dealt by (station, bucket as wide as the longest lag), the earlier record to its bucket and the next: what is
    shuffled is twice the one side, whatever the number of lags, and a busy station spreads over its buckets. A single lag is an equi-join.
    """
    a = records.select("station", "minute", "speed", "from_deg")
    b = records.select("station", F.col("minute").alias("at"), F.col("speed").alias("speed2"), F.col("from_deg").alias("from2"))
    if len(lags) == 1:
        return a.withColumns({"lag": F.lit(lags[0]), "at": F.col("minute") + lags[0]}).join(b, ["station", "at"])
    low, width = min(lags), max(lags) - min(lags) + 1
    first = F.floor((F.col("minute") + low) / width)
    met = a.withColumn("_b", F.explode(F.array(first, first + 1))).join(b.withColumn("_b", F.floor(F.col("at") / width)), ["station", "_b"])
    lag = F.col("at") - F.col("minute")
    return met.where(lag.between(low, max(lags)) if len(set(lags)) == width else lag.isin(lags)).withColumn("lag", lag).drop("_b")


def decorrelation(records: DataFrame, max_lag: int = 90, by: list[str] | None = None) -> DataFrame:
    """RMS change of speed, vector and direction at each lag from 0 on (``lag``, ``n``, ``speed_rms``, ``vector_rms``, ``dir_n``, ``dir_rms``)."""
    p, c = lagged(records, list(range(max_lag + 1))), F.col
    steady = (c("speed") > STEADY) & (c("speed2") > STEADY)
    d = F.when(steady, half_open_gap("from2", "from_deg"))
    v2 = F.pow(east("speed2", "from2") - east("speed", "from_deg"), 2) + F.pow(north("speed2", "from2") - north("speed", "from_deg"), 2)
    return p.groupBy(*(by or []), "lag").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(c("speed2") - c("speed"), 2))).alias("speed_rms"), F.sqrt(F.avg(v2)).alias("vector_rms"), F.count(d).alias("dir_n"), F.sqrt(F.avg(d * d)).alias("dir_rms"))


def over_window(curve: DataFrame, minutes: int, value: str = "speed_rms") -> DataFrame:
    """Quadratic mean of a curve over lags 1 to ``minutes``, each weighing alike."""
    return curve.where(F.col("lag").between(1, minutes)).agg(F.sqrt(F.avg(F.pow(value, F.lit(2)))).alias("rms"), F.count("*").alias("lags"))


def at_offsets(curve: DataFrame, offsets: DataFrame, value: str = "speed_rms") -> DataFrame:
    """Quadratic mean of a curve over drawn offsets (column ``offset``, minutes), each as often as drawn; mean and largest offset."""
    return offsets.withColumn("lag", F.abs("offset")).join(small(curve), "lag").agg(F.sqrt(F.avg(F.pow(value, F.lit(2)))).alias("rms"), F.avg("lag").alias("mean_offset"), F.max("lag").alias("max_offset"), F.count("*").alias("n"))


def crossing(curve: DataFrame, level: float, value: str = "speed_rms", by: list[str] | None = None) -> DataFrame:
    """The lag, interpolated, where a curve first reaches ``level``; the curve before its first lag counts as 0."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("lag")
    c = curve.where("lag >= 0").withColumn("_b", F.coalesce(F.lag(value).over(w), F.lit(0.0))).where((F.col("lag") >= 1) & (F.col(value) >= level))
    first = c.groupBy(*(by or [])).agg(F.min_by(F.struct("lag", "_b", F.col(value).alias("v")), "lag").alias("x"))
    return first.select(*(by or []), F.when(F.col("x.v") == F.col("x._b"), F.col("x.lag").cast("double")).otherwise(F.col("x.lag") - 1 + (level - F.col("x._b")) / (F.col("x.v") - F.col("x._b"))).alias("crossing"))


def block_mean(records: DataFrame, minutes: int, calm: float = STEADY) -> DataFrame:
    """Vector mean of the ``minutes`` that end at each record, only where all of them are there."""
    w = Window.partitionBy("station").orderBy("minute").rangeBetween(-(minutes - 1), 0)
    m = records.select("station", "minute", F.avg(east("speed", "from_deg")).over(w).alias("e"), F.avg(north("speed", "from_deg")).over(w).alias("n"), F.count("*").over(w).alias("k")).where(F.col("k") == minutes)
    speed = F.hypot("e", "n")
    return m.select("station", "minute", speed.alias("speed"), bearing_from("e", "n").alias("from_deg"), (speed <= calm).alias("calm"))


def by_speed(records: DataFrame, lag: int = 30, edges: tuple = (0.0, 2.0, 4.0, 6.0)) -> DataFrame:
    """RMS change at one lag by the mean of the two speeds, in bins closed below; the last is open above. Empty bins are there with n = 0."""
    spark = records.sparkSession
    p = lagged(records, [lag]).withColumn("mean", (F.col("speed") + F.col("speed2")) / 2)
    bin_of = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        bin_of = F.when(F.col("mean") >= e, i).otherwise(bin_of)
    bins = spark.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    g = p.withColumn("bin", bin_of).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("speed2") - F.col("speed"), 2))).alias("rms"), F.avg("mean").alias("mean_speed"))
    return F.broadcast(bins).join(g, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "rms", "mean_speed", F.when(F.col("mean_speed") > 0, F.col("rms") / F.col("mean_speed")).alias("relative"))


def whole_hour(records: DataFrame) -> DataFrame:
    """Every record against the nearest whole hour's (before half past the one before) and against the two interpolated: n and RMS of both."""
    c = F.col
    marks = records.where("minute % 60 = 0").select("station", c("minute").alias("mark"), c("speed").alias("s"))
    r = records.withColumn("into", F.pmod("minute", F.lit(60))).withColumn("past", c("minute") - F.pmod("minute", F.lit(60)))
    j = r.join(marks.select("station", c("mark").alias("past"), c("s").alias("a")), ["station", "past"], "left").withColumn("coming", c("past") + 60).join(marks.select("station", c("mark").alias("coming"), c("s").alias("b")), ["station", "coming"], "left")
    near = F.when(c("into") < 30, c("a")).otherwise(c("b")) - c("speed")
    line = c("a") + (c("b") - c("a")) * c("into") / 60 - c("speed")
    return j.agg(F.count(near).alias("nearest_n"), F.sqrt(F.avg(near * near)).alias("nearest_rms"), F.count(line).alias("line_n"), F.sqrt(F.avg(line * line)).alias("line_rms"))


def pooled(curves: DataFrame) -> DataFrame:
    """Curves of several stations (lag, n, speed_rms, vector_rms) as one, weighing by n."""
    p = lambda v: F.sqrt(F.sum(F.col("n") * F.col(v) * F.col(v)) / F.sum("n")).alias(v)
    return curves.groupBy("lag").agg(p("speed_rms"), p("vector_rms"), F.sum("n").alias("n"))
