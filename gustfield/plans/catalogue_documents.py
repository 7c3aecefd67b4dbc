"""Registered query over station catalogues: customers written as the documents that five networks publish, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalogues
from . import proxies as P
from .catalogue import query

#: Customers fall to the networks by turns; so many neighbours by key share a document.
NETWORKS = ["weather", "mesonet", "remote", "agricultural", "climate"]
BLOCK = 250
#: Every 13th position lies beyond the pole, every 11th elevation (or height) has a unit that isn't known, every 17th is absent.
LAT = "30 + (c_custkey * 7919 % 10007) * 2e-3 + CASE WHEN c_custkey % 13 = 0 THEN 100 ELSE 0 END"
LON = "-120 + (c_custkey * 104729 % 10009) * 4e-3"


def customers(spark, sf, network: str):
    k = F.col("c_custkey")
    lat = F.lit(30) + (k * 7919 % 10007) * 0.002 + F.when(k % 13 == 0, 100).otherwise(0)
    return P.table(spark, sf, "customer").where(k % len(NETWORKS) == NETWORKS.index(network)).select(k.alias("k"), F.floor(k / BLOCK).alias("block"), F.concat(F.lit("S"), k).alias("id"), F.col("c_name").alias("name"), lat.alias("lat"), (F.lit(-120) + (k * 104729 % 10009) * 0.004).alias("lon"), F.when(k % 17 != 0, F.col("c_acctbal")).alias("high"), (k % 11 == 0).alias("odd"))


def documents(spark, sf) -> dict:
    """The documents of each network; a document holds at most BLOCK / 5 stations."""
    c = F.col
    w = customers(spark, sf, "weather")
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    props = F.struct(c("id").alias("stationIdentifier"), "name", F.struct(F.when(c("odd"), "wmoUnit:ft").otherwise("wmoUnit:m").alias("unitCode"), c("high").alias("value")).alias("elevation"))
    weather = w.select(F.to_json(F.struct(point.alias("geometry"), props.alias("properties"))).alias("value"))

    m = customers(spark, sf, "mesonet")
    sensor = F.struct(F.struct(F.struct((c("k") % 7 + 2).cast("string").alias("position")).alias("wind_speed_1")).alias("wind_speed"))
    row = F.struct(c("id").alias("STID"), c("name").alias("NAME"), c("lat").cast("string").alias("LATITUDE"), c("lon").alias("LONGITUDE"), c("high").cast("string").alias("ELEVATION"), F.struct(F.when(c("odd"), "rod").otherwise("ft").alias("elevation")).alias("UNITS"), sensor.alias("SENSOR_VARIABLES"))
    mesonet = m.groupBy("block").agg(F.collect_list(row).alias("STATION")).select(F.to_json(F.struct(F.struct(F.lit(1).alias("RESPONSE_CODE")).alias("SUMMARY"), F.struct(F.lit("m").alias("position")).alias("UNITS"), "STATION")).alias("value"))

    r = customers(spark, sf, "remote")
    row = F.struct(c("id").alias("station_id"), c("name").alias("station_name"), c("lat").alias("latitude"), c("lon").cast("string").alias("longitude"), F.when(c("odd"), "tall").otherwise(c("high").cast("string")).alias("elevation"))
    remote = r.groupBy("block").agg(F.collect_list(row).alias("data")).select(F.to_json(F.struct(F.struct(F.struct("data").alias("stationMetaData")).alias("data"))).alias("value"))

    a = customers(spark, sf, "agricultural")
    row = F.struct("name", F.when(c("odd"), "us").otherwise("m").alias("units"), "lat", "lon", c("high").alias("elevation"), (c("k") % 3).alias("anemometerHeight"))
    agricultural = a.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("id", row))).alias("m")).select(F.to_json("m").alias("value"))

    t = customers(spark, sf, "climate")
    named = {"WBAN": c("id"), "LOCATION": F.lit("Town"), "VECTOR": F.concat((c("k") % 9).cast("string"), F.lit(" W")), "NAME": F.when(c("odd"), "").otherwise(c("name")), "LATITUDE": c("lat").cast("string"), "LONGITUDE": c("lon").cast("string"), "ELEVATION": F.coalesce(c("high").cast("string"), F.lit(""))}
    line = F.concat_ws("\t", *[named.get(n, F.lit("")) for n in catalogues.CLIMATE_COLUMNS])
    climate = t.groupBy("block").agg(F.collect_list(line).alias("lines")).select(F.concat_ws("\n", F.lit("\t".join(catalogues.CLIMATE_COLUMNS)), F.array_join("lines", "\n")).alias("value"))
    return {"weather": weather, "mesonet": mesonet, "remote": remote, "agricultural": agricultural, "climate": climate}


@query(f"""WITH c AS (SELECT c_custkey % 5 AS n, c_custkey AS k, c_custkey % 11 = 0 AS odd, 'S' || c_custkey AS station_id, c_name, {LAT} AS lat, {LON} AS lon, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS high FROM customer)
 SELECT ['weather', 'mesonet', 'remote', 'agricultural', 'climate'][n + 1] AS source, station_id, CASE WHEN n = 4 AND odd THEN 'Town ' || k % 9 || ' W' ELSE c_name END AS name, lat, lon,
  CASE WHEN n IN (0, 3) THEN high WHEN n = 4 OR NOT odd THEN high * 0.3048 END AS elevation_m, CASE n WHEN 1 THEN k % 7 + 2 WHEN 3 THEN nullif(k % 3, 0) WHEN 4 THEN 1.5 END AS sensor_height_m, CASE WHEN n = 3 AND lat BETWEEN 36.5 AND 41.5 AND lon BETWEEN -109.6 AND -101.5 THEN 'CO' END AS state,
  CASE WHEN n = 3 AND odd THEN 'bad-unit' WHEN lat > 90 THEN 'bad-station' WHEN odd AND n = 2 THEN 'bad-station' WHEN odd AND n IN (0, 1) AND high IS NOT NULL THEN 'bad-unit' END AS code FROM c""", "lat lon elevation_m sensor_height_m", places=4)
def station_catalogues(spark, sf):
    return catalogues.union(documents(spark, sf)).select("source", "station_id", "name", "lat", "lon", "elevation_m", "sensor_height_m", "state", "code")
