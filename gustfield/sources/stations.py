"""Readers of station networks: text, CSV and JSON tables into observations with reject codes (see rejects).

Each takes a DataFrame of raw text (one row a line, or a document in the column ``value``), so that any of Spark's readers may
have brought it. Speeds become m/s, directions degrees from north, times UTC.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import UNITS, to_metres_a_second
from ..functions.sizes import small
from .rejects import first_failure

#: Largest plausible speeds (m/s; the one-minute record in knots), speed below which air counts as calm (m/s).
CEILING, AGRICULTURAL_CEILING, MINUTE_CEILING_KT, CALM = 60.0, 120.0, 250, 0.3

#: Quality flags with which a value stands.
GOOD_FLAGS = ["V", "S", "G", "C"]


def number(x: Column) -> Column:
    return x.try_cast("double")


def cut(line: str, first: int, last: int) -> Column:
    """Trimmed characters first..last (counted from 1) of a fixed-width line."""
    return F.trim(F.substring(F.col(line), first, last - first + 1))


def compass(d: Column, speed: Column, calm: Column) -> Column:
    """360 is 0; a calm has no direction."""
    return F.when(calm | speed.isNull(), F.lit(None).cast("double")).otherwise(F.pmod(d, F.lit(360.0)))


def climate_reference(lines: DataFrame, keep_flagged: bool = False) -> DataFrame:
    """Fixed-width five-minute records (134 characters, 23 fields). Columns must agree with the fields between white space. The time is the middle of the interval."""
    c = F.col
    fields = F.split(F.trim("value"), r"\s+")
    t = lines.withColumn("_f", fields).withColumn("_wind", cut("value", 127, 132)).withColumn("_flag", cut("value", 134, 134))
    stamp = F.try_to_timestamp(F.concat(cut("value", 7, 14), F.lit(" "), cut("value", 16, 19)), F.lit("yyyyMMdd HHmm"))
    speed = number(c("_wind"))
    code = first_failure([
        (F.length("value") < 134, "bad-observations"), (F.size("_f") != 23, "bad-observations"), (c("_wind") != F.get("_f", F.lit(21)), "bad-observations"),
        (stamp.isNull(), "bad-time"), (speed.isNull() | (speed <= -99), "no-wind"), (F.lit(not keep_flagged) & (c("_flag") != "0"), "flagged"), ((speed < 0) | (speed > AGRICULTURAL_CEILING), "implausible"),
    ])
    none = F.lit(None).cast("double")
    return t.select(cut("value", 1, 5).alias("station_id"), (stamp - F.expr("interval 150 seconds")).alias("time"), speed.alias("speed_mps"), none.alias("from_deg"), (speed < CALM).alias("calm"), none.alias("gust_mps"), code.alias("code"))


def one_minute(lines: DataFrame) -> DataFrame:
    """Fixed-width one-minute airport records. Local stamp and UTC clock make the time: the difference of the two is taken within half a day."""
    local = F.try_to_timestamp(cut("value", 14, 25), F.lit("yyyyMMddHHmm"))
    clock = cut("value", 26, 29)
    minutes = F.substring(clock, 1, 2).try_cast("int") * 60 + F.substring(clock, 3, 2).try_cast("int")
    shift = F.pmod(minutes - (F.hour(local) * 60 + F.minute(local)) + 720, F.lit(1440)) - 720
    direction, speed, gust = (number(cut("value", a, b)) for a, b in ((71, 74), (75, 79), (85, 89)))
    absent = cut("value", 75, 79).isin("", "M") | cut("value", 71, 74).isin("", "M")
    code = first_failure([(F.length("value") < 79, "malformed"), (local.isNull() | minutes.isNull() | (minutes >= 1440), "bad-time"), (absent, "no-wind"), (speed.isNull() | direction.isNull(), "malformed"), ((speed < 0) | (speed > MINUTE_CEILING_KT), "implausible")])
    calm = speed <= 2
    kt = F.lit(UNITS["kt"])
    return lines.select(cut("value", 10, 13).alias("station_id"), F.timestamp_micros(F.unix_micros(local) + shift.cast("bigint") * 60_000_000).alias("time"), (speed * kt).alias("speed_mps"), compass(direction, speed, calm).alias("from_deg"), calm.alias("calm"), (gust * kt).alias("gust_mps"), code.alias("code"))


def header_unit(names: list[str], wanted: str) -> tuple[str, str]:
    """The column called ``wanted`` and the unit in its parentheses."""
    for name in names:
        m = re.fullmatch(rf"{re.escape(wanted)}\s*\(([^)]*)\)", name.strip())
        if m:
            return name, m[1]
    raise ValueError(f"bad-csv: no column {wanted}(unit)")


def remote_stations(table: DataFrame, minutes: DataFrame | None = None, hour_bins: bool = False) -> DataFrame:
    """Bulk CSV of remote stations, read with header and strings. ``minutes`` (station_id, transmit_minute): when in the hour a station sends.

    A stamp names the hour that the record was sent in or just after: minutes from 30 on belong to the hour before it.
    """
    speed_name, unit = header_unit(table.columns, "WindSpeed")
    gust_name, _ = header_unit(table.columns, "GustSpeed")
    azimuth, _ = header_unit(table.columns, "WindAzimuth")
    if unit not in UNITS:
        raise ValueError(f"bad-unit: {unit}")
    c = lambda n: F.col(f"`{n}`")
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    t = table.withColumn("_id", F.trim(c("StationId")))
    t = t.join(small(minutes.select(F.col("station_id").alias("_id"), "transmit_minute")), "_id", "left") if minutes is not None else t.withColumn("transmit_minute", F.lit(None).cast("int"))
    label = F.try_to_timestamp(c("DateTime"))
    m = F.col("transmit_minute")
    sent = F.timestamp_micros(F.unix_micros(label) + (m - F.when(m >= 30, 60).otherwise(0)).cast("bigint") * 60_000_000)
    speed, gust, way = number(c(speed_name)), number(c(gust_name)), number(c(azimuth))
    flagged = ~blank(c("WSflag")) | ~blank(c("WAflag"))
    code = first_failure([
        (blank(c("DateTime")), "no-data"), (label.isNull(), "bad-time"), (blank(c("ObservationType")), "no-data"), (c("ObservationType") != "O", "not-an-observation"),
        (F.lit(not hour_bins) & m.isNull(), "no-transmit-minute"), (blank(c(speed_name)), "no-wind"), (speed.isNull(), "bad-observation"), ((speed * UNITS[unit] < 0) | (speed * UNITS[unit] > CEILING), "implausible"), (flagged, "bad-quality"),
    ])
    calm = speed == 0
    return t.select(F.col("_id").alias("station_id"), F.coalesce(sent, label).alias("time"), (speed * UNITS[unit]).alias("speed_mps"), compass(way, speed, calm).alias("from_deg"), calm.alias("calm"), (gust * UNITS[unit]).alias("gust_mps"), code.alias("code"))


COLUMNAR = "station string, units string, timezone string, tzOffset string, timestep int, time array<string>, windSpeed array<double>, windDir array<double>, gustSpeed array<double>"


def agricultural(docs: DataFrame) -> DataFrame:
    """JSON documents of parallel columns; labels are ends of intervals, so times are half a step earlier. Values of -999 and below are missing."""
    d = docs.select(F.from_json("value", COLUMNAR).alias("d")).select("d.*")
    even = (F.size("time") == F.size("windSpeed")) & (F.size("time") == F.size("windDir"))
    bad = first_failure([(F.col("units") != "m", "bad-unit"), (~F.col("timestep").isin(300, 3600), "bad-timestep"), (~F.col("tzOffset").rlike(r"^[+-]\d\d:\d\d$"), "bad-timezone"), (~even, "bad-observations")])
    rows = d.withColumn("_bad", bad).select("station", "tzOffset", "timestep", "_bad", F.explode_outer(F.arrays_zip("time", "windSpeed", "windDir", "gustSpeed")).alias("r")).select("station", "tzOffset", "timestep", "_bad", "r.*")
    end = F.try_to_timestamp(F.concat("time", F.lit(":00"), "tzOffset"), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    missing = lambda x: F.col(x).isNull() | F.isnan(x) | (F.col(x) <= -999)
    code = F.coalesce("_bad", first_failure([(F.col("time").isNull() | (F.trim("time") == ""), "blank"), (end.isNull(), "bad-time"), (missing("windSpeed"), "no-wind"), ((F.col("windSpeed") < 0) | (F.col("windSpeed") > AGRICULTURAL_CEILING), "implausible")]))
    calm = F.col("windSpeed") < CALM
    way = F.when(missing("windDir"), F.lit(None).cast("double")).otherwise(F.col("windDir"))
    return rows.select(F.lower("station").alias("station_id"), F.timestamp_micros(F.unix_micros(end) - F.col("timestep").cast("bigint") * 500_000).alias("time"), F.col("windSpeed").alias("speed_mps"), compass(way, F.col("windSpeed"), calm).alias("from_deg"), calm.alias("calm"), F.when(~missing("gustSpeed"), F.col("gustSpeed")).alias("gust_mps"), code.alias("code"))


_Q = "struct<unitCode:string,value:double,qualityControl:string>"
GEOJSON = f"features array<struct<properties:struct<stationId:string,timestamp:string,windSpeed:{_Q},windGust:{_Q},windDirection:{_Q}>>>"


def geojson(docs: DataFrame) -> DataFrame:
    """GeoJSON observations. Units are named behind the last colon of unitCode."""
    p = docs.select(F.explode_outer(F.from_json("value", GEOJSON)["features"]).alias("f")).select("f.properties.*")
    names = {"km_h-1": "km/h", "m_s-1": "m/s", "kt": "kt"}
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.regexp_extract("windSpeed.unitCode", r"([^:]*)$", 1))
    speed = to_metres_a_second("windSpeed.value", unit)
    bad = lambda q: F.col(q).isNotNull() & ~F.col(q).isin(*GOOD_FLAGS)
    at = F.try_to_timestamp("timestamp")
    code = first_failure([(F.col("timestamp").isNull() & F.col("windSpeed").isNull(), "bad-feature"), (at.isNull(), "bad-time"), (bad("windSpeed.qualityControl"), "bad-quality"), (F.col("windSpeed.value").isNull(), "no-wind"), (speed.isNull(), "bad-unit"), ((speed < 0) | (speed > CEILING), "implausible")])
    calm = speed < CALM
    way = F.when(bad("windDirection.qualityControl"), F.lit(None).cast("double")).otherwise(F.col("windDirection.value"))
    return p.select(F.upper(F.regexp_extract("stationId", r"([^/]*)$", 1)).alias("station_id"), at.alias("time"), speed.alias("speed_mps"), compass(way, speed, calm).alias("from_deg"), calm.alias("calm"), to_metres_a_second("windGust.value", unit).alias("gust_mps"), code.alias("code"))


_V = "date_time array<string>,wind_speed_set_1 array<double>,wind_direction_set_1 array<double>,wind_gust_set_1 array<double>"
MESONET = f"SUMMARY struct<RESPONSE_CODE:int,RESPONSE_MESSAGE:string>, UNITS map<string,string>, STATION array<struct<STID:string,UNITS:map<string,string>,OBSERVATIONS:struct<{_V.replace(' array', ':array')}>,QC:map<string,array<string>>>>"


def mesonet(docs: DataFrame) -> DataFrame:
    """JSON time series of parallel arrays; a station's units go before the document's; any quality entry rejects the value it stands beside."""
    d = docs.select(F.from_json("value", MESONET).alias("d")).select("d.*")
    s = d.select("SUMMARY", "UNITS", F.explode_outer("STATION").alias("s")).select("SUMMARY", F.coalesce(F.element_at("s.UNITS", F.lit("wind_speed")), F.element_at("UNITS", F.lit("wind_speed"))).alias("unit"), "s.STID", "s.OBSERVATIONS.*", "s.QC")
    flags = F.element_at("QC", F.lit("wind_speed_set_1"))
    r = s.select("SUMMARY", "unit", "STID", F.explode_outer(F.arrays_zip(F.col("date_time").alias("t"), F.col("wind_speed_set_1").alias("v"), F.col("wind_direction_set_1").alias("w"), F.col("wind_gust_set_1").alias("g"), flags.alias("q"))).alias("r")).select("SUMMARY", "unit", "STID", "r.*")
    speed = to_metres_a_second("v", F.col("unit"))
    at = F.try_to_timestamp("t")
    flagged = F.col("q").isNotNull() & ~F.col("q").isin("", "[]", "null")
    code = first_failure([(F.col("SUMMARY.RESPONSE_CODE") != 1, "synoptic-refused"), (F.col("unit").isNull(), "no-units"), (at.isNull(), "bad-time"), (flagged, "bad-quality"), (F.col("v").isNull(), "no-wind"), (speed.isNull(), "bad-unit"), ((speed < 0) | (speed > CEILING), "implausible")])
    calm = speed < CALM
    return r.select(F.upper("STID").alias("station_id"), at.alias("time"), speed.alias("speed_mps"), compass(F.col("w"), speed, calm).alias("from_deg"), calm.alias("calm"), to_metres_a_second("g", F.col("unit")).alias("gust_mps"), code.alias("code"))
