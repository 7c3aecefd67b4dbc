"""Registered queries over station networks, boxes at scale, wide discs, metrics left one out of, and cycles; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, kernels, places, scoring
from ..sources import networks
from ..streaming import streams
from . import proxies as P
from .catalogue import query, sql_signed

# ---- networks: events of two kinds as two networks' own documents and lines

SPEEDS = "CASE WHEN event_id % 19 = 0 THEN NULL ELSE round(value / 10, 1) END"


def raw_weather(spark, sf):
    """A document of one feature for each click."""
    e = P.table(spark, sf, "events").where("event_type = 'click'")
    speed = F.when(F.col("event_id") % 19 != 0, F.round(F.col("value") / 10, 1))
    value = lambda x, flag=F.lit("V"): F.struct(F.lit("wmoUnit:km_h-1").alias("unitCode"), x.alias("value"), flag.alias("qualityControl"))
    way = F.struct(F.lit("wmoUnit:degree_(angle)").alias("unitCode"), ((F.col("event_id") * 37) % 361).cast("double").alias("value"), F.lit("V").alias("qualityControl"))
    flag = F.when(F.col("event_id") % 23 == 0, "X").otherwise("V")
    props = F.struct(F.concat(F.lit("https://host/stations/k"), F.col("user_id") % 20).alias("stationId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), value(speed, flag).alias("windSpeed"), value(F.lit(None).cast("double")).alias("windGust"), way.alias("windDirection"))
    return e.select(F.to_json(F.struct(F.array(F.struct(props.alias("properties"))).alias("features"))).alias("value"))


def raw_airport(spark, sf):
    """A fixed-width line for each view, with a local stamp seven hours behind."""
    e = P.table(spark, sf, "events").where("event_type = 'view'")
    local = F.col("ts") - F.expr("interval 7 hours")
    head = F.rpad(F.concat(F.lit("04931KXYZ"), F.lpad((F.col("user_id") % 20).cast("string"), 4, "0"), F.date_format(local, "yyyyMMddHHmm"), F.date_format("ts", "HHmm")), 70, " ")
    speed = F.when(F.col("event_id") % 17 == 0, F.lit("    M")).otherwise(F.lpad(F.floor(F.col("value") / 4).cast("string"), 5, " "))
    return e.select(F.concat(head, F.lpad(((F.col("event_id") * 37) % 361).cast("string"), 4, " "), speed, F.lpad(F.lit(""), 5, " "), F.lpad(F.lit(""), 6, " ")).alias("value"))


WEATHER = f"""SELECT 'weather' AS network, upper('k' || user_id % 20) AS station_id, date_trunc('second', ts) AS t, {SPEEDS} / 3.6 AS speed, (event_id * 37) % 361 AS way,
  CASE WHEN event_id % 23 = 0 THEN 'bad-quality' WHEN {SPEEDS} IS NULL THEN 'no-wind' WHEN {SPEEDS} / 3.6 < 0 OR {SPEEDS} / 3.6 > 60 THEN 'implausible' END AS code FROM events WHERE event_type = 'click'"""
AIRPORT = """SELECT 'airport' AS network, lpad(CAST(user_id % 20 AS VARCHAR), 4, '0') AS station_id, date_trunc('minute', ts) AS t, CASE WHEN event_id % 17 <> 0 THEN floor(value / 4) END * 1852 / 3600 AS speed, (event_id * 37) % 361 AS way,
  CASE WHEN event_id % 17 = 0 THEN 'no-wind' WHEN floor(value / 4) < 0 OR floor(value / 4) > 250 THEN 'implausible' END AS code FROM events WHERE event_type = 'view'"""


@query(f"""SELECT network, station_id, count(*) AS seen, count(*) FILTER (WHERE code IS NULL) AS kept, count(*) FILTER (WHERE code = 'no-wind') AS no_wind, count(*) FILTER (WHERE code = 'bad-quality') AS bad_quality, avg(speed) FILTER (WHERE code IS NULL) AS mean_speed, max(t) FILTER (WHERE code IS NULL) AS newest
 FROM ({WEATHER} UNION ALL {AIRPORT}) GROUP BY network, station_id""", "mean_speed")
def observations_union(spark, sf):
    got = networks.union({"weather": raw_weather(spark, sf), "airport": raw_airport(spark, sf)})
    ok = F.col("code").isNull()
    return got.groupBy("network", "station_id").agg(F.count("*").alias("seen"), F.count_if(ok).alias("kept"), F.count_if(F.col("code") == "no-wind").alias("no_wind"), F.count_if(F.col("code") == "bad-quality").alias("bad_quality"), F.avg(F.when(ok, F.col("speed_mps"))).alias("mean_speed"), F.max(F.when(ok, F.col("time"))).cast("timestamp_ntz").alias("newest"))


# ---- boxes

#: Customers as points, parts as boxes of many sizes.
POINTS = "(SELECT c_custkey AS id, 30 + (c_custkey * 7919 % 10007) * 2e-3 AS lat, -120 + (c_custkey * 104729 % 10009) * 4e-3 AS lon FROM customer)"
BOXES = "(SELECT p_partkey AS box, 30 + (p_partkey * 31 % 997) * 2e-2 AS south, -120 + (p_partkey * 17 % 991) * 4e-2 AS west, 30 + (p_partkey * 31 % 997) * 2e-2 + p_size * p_size * 2e-3 AS north, -120 + (p_partkey * 17 % 991) * 4e-2 + p_size * 3e-2 AS east FROM part)"


def points(spark, sf):
    k = F.col("c_custkey")
    return P.table(spark, sf, "customer").select(k.alias("id"), (F.lit(30) + (k * 7919 % 10007) * 0.002).alias("lat"), (F.lit(-120) + (k * 104729 % 10009) * 0.004).alias("lon"))


def boxes(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    b = P.table(spark, sf, "part").select(k.alias("box"), s, (F.lit(30) + (k * 31 % 997) * 0.02).alias("south"), (F.lit(-120) + (k * 17 % 991) * 0.04).alias("west"))
    return b.select("box", "south", "west", (F.col("south") + s * s * 0.002).alias("north"), (F.col("west") + s * 0.03).alias("east"))


DISTANCE = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(lat - (south + north) / 2) / 2), 2) + cos(radians((south + north) / 2)) * cos(radians(lat)) * pow(sin(radians(lon - (west + east) / 2) / 2), 2), 1)))"
HELD = f"(SELECT box, id, {DISTANCE} AS distance FROM {BOXES} JOIN {POINTS} ON lat BETWEEN south AND north AND lon BETWEEN west AND east)"


@query(f"""SELECT b.box, coalesce(matched, 0) AS matched, CAST(id AS DOUBLE) AS id, CAST(rank AS DOUBLE) AS rank, distance FROM {BOXES} b LEFT JOIN (SELECT box, id, distance, row_number() OVER (PARTITION BY box ORDER BY distance, id) AS rank, count(*) OVER (PARTITION BY box) AS matched FROM {HELD} QUALIFY rank <= 5) USING (box)""", "distance", places=3)
def stations_in_boxes(spark, sf):
    got = places.nearest(points(spark, sf), boxes(spark, sf), "box", "id", 5)
    return got.select("box", "matched", F.col("id").cast("double").alias("id"), F.col("rank").cast("double").alias("rank"), "distance")


#: Tiles of one size that the boxes are held against.
TILES = "(SELECT s_suppkey AS tile, 30 + (s_suppkey * 13 % 101) * 2e-1 AS south, -120 + (s_suppkey * 29 % 103) * 39e-2 AS west, 30 + (s_suppkey * 13 % 101) * 2e-1 + 35e-2 AS north, -120 + (s_suppkey * 29 % 103) * 39e-2 + 35e-2 AS east FROM supplier)"


@query(f"SELECT b.box, count(t.tile) AS tiles, coalesce(sum(t.tile), 0)::BIGINT AS sum_tile FROM {BOXES} b LEFT JOIN {TILES} t ON b.west <= t.east AND t.west <= b.east AND b.south <= t.north AND t.south <= b.north GROUP BY b.box")
def boxes_meeting_tiles(spark, sf):
    k = F.col("s_suppkey")
    t = P.table(spark, sf, "supplier").select(k.alias("tile"), (F.lit(30) + (k * 13 % 101) * 0.2).alias("south"), (F.lit(-120) + (k * 29 % 103) * 0.39).alias("west")).select("*", (F.col("south") + 0.35).alias("north"), (F.col("west") + 0.35).alias("east"))
    return places.counted(boxes(spark, sf), t, "box", "tile").select("box", F.col("matched").alias("tiles"), F.col("total").alias("sum_tile"))


# ---- wide discs

RADIUS = 500.0
WIDE = grid.disc(RADIUS, P.CELL, P.CELL)
REACH = max(r for r, _ in WIDE)


@query(f"""SELECT a.domain, a."row", a.col, CASE WHEN a."row" >= {REACH} AND a."row" < (SELECT count(*) FROM embeddings) - {REACH} AND a.col >= {REACH} AND a.col < {P.WIDTH - REACH} AND count(b.z) >= {0.9 * len(WIDE)} THEN sum(b.z) / count(b.z) END AS disc_mean
 FROM {P.RASTER_SQL} a JOIN {P.RASTER_SQL} b ON b."row" BETWEEN a."row" - {REACH} AND a."row" + {REACH} AND b.col BETWEEN a.col - {REACH} AND a.col + {REACH} AND pow((b."row" - a."row") * {P.CELL}, 2) + pow((b.col - a.col) * {P.CELL}, 2) <= {RADIUS * RADIUS} GROUP BY a.domain, a."row", a.col""", "disc_mean", "row col")
def disc_mean_wide(spark, sf):
    return kernels.disc_mean_tiled(P.raster(spark, sf), RADIUS, P.CELL, P.CELL, tile=64)


# ---- metrics left one out of

ERRORS = f"""(SELECT station, class, CASE WHEN mod_speed IS NOT NULL AND NOT calm AND obs_from IS NOT NULL AND obs_speed >= 1 AND mod_from IS NOT NULL THEN {sql_signed('mod_from', 'obs_from')} END AS de,
  CASE WHEN mod_speed IS NOT NULL AND (calm OR obs_from IS NOT NULL) AND mod_from IS NOT NULL THEN pow(-mod_speed * sin(radians(mod_from)) - CASE WHEN calm THEN 0 ELSE -obs_speed * sin(radians(obs_from)) END, 2) + pow(-mod_speed * cos(radians(mod_from)) - CASE WHEN calm THEN 0 ELSE -obs_speed * cos(radians(obs_from)) END, 2) END AS ve FROM {P.PAIRS_SQL})"""


@query(f"""WITH g AS (SELECT class, station, count(ve) AS n, coalesce(sum(ve), 0) AS e, coalesce(sum(sin(radians(de))), 0) AS s, coalesce(sum(cos(radians(de))), 0) AS c FROM {ERRORS} GROUP BY class, station),
 t AS (SELECT class, sum(n) AS n, sum(e) AS e, sum(s) AS s, sum(c) AS c FROM g GROUP BY class)
 SELECT class, station, sqrt(t.e / t.n) AS vector, sqrt((t.e - g.e) / (t.n - g.n)) AS vector_without, degrees(atan2(t.s, t.c)) AS turn, degrees(atan2(t.s - g.s, t.c - g.c)) AS turn_without FROM g JOIN t USING (class)""", "vector vector_without turn turn_without", places=4)
def jackknife_metrics(spark, sf):
    got = scoring.leave_one_out_of(P.pairs(spark, sf), "station", {"vector": scoring.vector_rmse(), "turn": scoring.circular_bias()}, ["class"])
    return got.select("class", "station", "vector", "vector_without", "turn", "turn_without")


# ---- cycles

#: Purchases as cycles: one an hour at most, issued up to five hours late, some of another hour than their name.
CYCLES = "(SELECT date_trunc('hour', ts) AS cycle, min(date_trunc('hour', ts) + to_minutes(55 + event_id % 5 * 60)) AS issued, min(CASE WHEN event_id % 7 = 0 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END) AS valid_time FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


@query(f"""WITH c AS {CYCLES}, o AS (SELECT event_id AS id, ts AS time FROM events WHERE event_type = 'click'),
 b AS (SELECT id, max(cycle) AS cycle, arg_max(valid_time, cycle) AS valid_time FROM o JOIN c ON cycle <= date_trunc('hour', time) AND cycle > date_trunc('hour', time) - INTERVAL 6 HOURS AND issued <= time GROUP BY id)
 SELECT o.id, b.cycle, CASE WHEN b.cycle IS NULL THEN 'no-cycle' WHEN b.valid_time <> b.cycle THEN 'mismatched-time' END AS code FROM o LEFT JOIN b USING (id)""")
def cycle_walk_back(spark, sf):
    e = P.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hour, k = F.date_trunc("hour", "ts"), F.col("event_id")
    c = e.where("event_type = 'purchase'").groupBy(hour.alias("cycle")).agg(F.min(hour + F.make_dt_interval(mins=(F.lit(55) + k % 5 * 60).cast("int"))).alias("issued"), F.min(F.when(k % 7 == 0, hour + F.expr("interval 1 hour")).otherwise(hour)).alias("valid_time"))
    got = streams.latest_cycle(e.where("event_type = 'click'").select(k.alias("id"), F.col("ts").alias("time")), c)
    return got.select("id", F.col("cycle").cast("timestamp_ntz").alias("cycle"), "code")
