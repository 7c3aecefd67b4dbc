"""The driver's star schema seen as stations, observations, model samples, pairs and rasters; the same views in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATIONS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wind(spark: SparkSession, sf_dir: str, kind: str | None) -> DataFrame:
    """Events of a kind as winds: id, station, time, speed, from_deg, calm."""
    e = table(spark, sf_dir, "events")
    e = e.where(F.col("event_type") == kind) if kind else e
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % STATIONS).alias("station"), F.col("ts").cast("timestamp").alias("time"), (F.col("value") / 10).alias("speed"), ((F.col("event_id") * 37) % 360).cast("double").alias("from_deg"), (F.col("value") / 10 < 0.3).alias("calm"))


WIND_SQL = f"SELECT event_id AS id, user_id % {STATIONS} AS station, ts AS time, value / 10 AS speed, CAST((event_id * 37) % 360 AS DOUBLE) AS from_deg, value / 10 < 0.3 AS calm, event_type FROM events"


def wind_sql(kind: str | None) -> str:
    return f"({WIND_SQL}" + (f" WHERE event_type = '{kind}')" if kind else ")")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a dense minute series of four stations."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 4).alias("station"), F.floor(F.col("event_id") / 4).alias("minute"), (F.col("value") / 40).alias("speed"), ((F.col("event_id") * 7) % 360).cast("double").alias("from_deg"))


MINUTES_SQL = "(SELECT event_id % 4 AS station, event_id // 4 AS minute, value / 40 AS speed, CAST((event_id * 7) % 360 AS DOUBLE) AS from_deg FROM events)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pairs; some modelled directions and speeds are missing."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("station"), c("l_returnflag").alias("class"), c("l_linestatus").alias("run"), c("l_orderkey").alias("ord"), c("l_linenumber").alias("line"),
        (c("l_quantity") / 5).alias("obs_speed"), F.when(c("l_partkey") % 11 == 0, F.lit(None).cast("double")).otherwise(((c("l_partkey") * 13) % 360).cast("double")).alias("obs_from"), (c("l_quantity") / 5 < 0.3).alias("calm"),
        F.when(c("l_orderkey") % 17 == 0, F.lit(None).cast("double")).otherwise(c("l_extendedprice") / 10000).alias("mod_speed"), ((c("l_orderkey") * 7 + c("l_linenumber") * 31) % 360).cast("double").alias("mod_from"),
    )


PAIRS_SQL = """(SELECT l_suppkey AS station, l_returnflag AS class, l_linestatus AS run, l_orderkey AS ord, l_linenumber AS line, l_quantity / 5 AS obs_speed,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST((l_partkey * 13) % 360 AS DOUBLE) END AS obs_from, l_quantity / 5 < 0.3 AS calm,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_extendedprice / 10000 END AS mod_speed, CAST((l_orderkey * 7 + l_linenumber * 31) % 360 AS DOUBLE) AS mod_from FROM lineitem)"""

#: Raster of the embeddings: a row for each vector, a column for each element; heights in metres on cells of 30 m.
WIDTH, CELL = 64, 30.0


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    z = e.select(F.lit("d").alias("domain"), F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return z.select("domain", "row", "col", F.when((F.col("row") * 7 + F.col("col") * 3) % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("v").cast("double") * 100).alias("z"))


RASTER_SQL = """(SELECT 'd' AS domain, CAST(vec_id AS INT) AS "row", CAST(i - 1 AS INT) AS col, CASE WHEN (vec_id * 7 + (i - 1) * 3) % 97 = 0 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) * 100 END AS z
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def extent(cells: DataFrame) -> DataFrame:
    return cells.groupBy("domain").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations with a position."""
    c = F.col
    return table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), (37 + (c("s_suppkey") % 50) * 0.08).alias("lat"), (-109 + (c("s_suppkey") % 70) * 0.1).alias("lon"), (1500 + c("s_acctbal") / 10).alias("elevation"), c("s_nationkey").alias("nation"))


PLACES_SQL = "(SELECT s_suppkey AS id, 37 + (s_suppkey % 50) * 0.08::DOUBLE AS lat, -109 + (s_suppkey % 70) * 0.1::DOUBLE AS lon, 1500 + s_acctbal / 10 AS elevation, s_nationkey AS nation FROM supplier)"


def rounded(df: DataFrame, places: int = 6, skip: tuple = ()) -> DataFrame:
    """Doubles to six places, halves up, and integers as bigint, so that engines agree."""
    p = float(10**places)
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        out.append((F.floor(c * p + 0.5) / p).alias(f.name) if kind in ("double", "float") and f.name not in skip else c.cast("bigint").alias(f.name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(*out)


def rounded_sql(sql: str, doubles: list[str], longs: list[str] = (), places: int = 6) -> str:
    p = f"1e{places}"
    items = [f"floor({d} * {p} + 0.5) / {p} AS {d}" for d in doubles] + [f"CAST({x} AS BIGINT) AS {x}" for x in longs]
    return f"SELECT * REPLACE ({', '.join(items)}) FROM ({sql})"
