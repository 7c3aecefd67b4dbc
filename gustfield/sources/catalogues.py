"""Station catalogues of the networks, as they publish them, into one table of stations with reject codes (see rejects).

Each reader takes a DataFrame of whole documents in the column ``value`` (a catalogue is small; there may be any number of them) and gives a row for each
station: ``STATION`` and ``more``, what only that network says. A document that is refused is one row with a code and no station. Documents that are null, empty or no
JSON are refused like answers of another shape; an accepted document without stations gives no row, unless its network calls that an error. Stations that come twice stay twice.
JSON of mixed types is read as variants: numbers may be strings, names must be strings. What is absent is null, never zero: a station without
position is refused, not put at latitude 0. Elevations and heights become metres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rejects import first_failure

#: The columns every reader gives, before ``more`` (a map of strings).
STATION = ["station_id", "name", "lat", "lon", "elevation_m", "dem_elevation_m", "sensor_height_m", "network", "status", "state", "code"]

#: Metres a foot, names of the units of a length.
FOOT = 0.3048
LENGTHS = {"m": 1.0, "meters": 1.0, "metres": 1.0, "ft": FOOT, "feet": FOOT}
#: Names of metres in GeoJSON.
METRE_CODES = ["wmoUnit:m", "unit:m"]
#: The box whose stations belong to the agricultural network's own state.
COLORADO = {"south": 36.5, "north": 41.5, "west": -109.6, "east": -101.5}
#: Header of the climate network's table, the height of its anemometers (m), the step of its positions (degrees), metres a degree.
CLIMATE_COLUMNS = ["WBAN", "COUNTRY", "STATE", "LOCATION", "VECTOR", "NAME", "LATITUDE", "LONGITUDE", "ELEVATION", "STATUS", "COMMISSIONING", "CLOSING", "OPERATION", "PAIRING", "NETWORK", "STATION_ID"]
CLIMATE_HEIGHT, POSITION_STEP, DEGREE = 1.5, 0.01, 111320


def part(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def string(v: Column) -> Column:
    """A variant's text, null if it holds anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", part(v, "$"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(v: Column) -> Column:
    """A variant's number, also one written as a string; null if it is none."""
    return finite(part(v, "$", "double"))


def absent(v: Column) -> Column:
    return v.isNull() | (F.schema_of_variant(v) == "VOID") | F.coalesce(part(v, "$") == "", F.lit(False))


def off_earth(lat: Column, lon: Column) -> Column:
    return ~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def length(v: Column, unit: Column) -> tuple[Column, list]:
    """Metres of a variant in a unit, and the rules that it may fail."""
    scale = F.try_element_at(F.create_map(*[F.lit(x) for kv in LENGTHS.items() for x in kv]), unit)
    there = ~absent(v)
    return F.when(there, number(v) * scale), [(there & number(v).isNull(), "bad-station"), (there & scale.isNull(), "bad-unit")]


def stations(rows: DataFrame, code: Column, more: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """The common columns; those not named are null."""
    kinds = dict.fromkeys(["lat", "lon", "elevation_m", "dem_elevation_m", "sensor_height_m"], "double")
    out = [columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in STATION if c != "code"]
    pairs = F.map_filter(F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull()) if more else F.create_map().cast("map<string,string>")
    return rows.select(*out, code.alias("code"), pairs.alias("more"))


def items(docs: DataFrame, array: str, *others: str) -> DataFrame:
    """``others`` and, for each element of ``array``, ``pos`` and ``s``; where there is no array one row without."""
    return docs.select(*others, F.posexplode_outer(array).alias("pos", "s"))


FEATURE = "geometry struct<type:string,coordinates:array<variant>>, properties struct<stationIdentifier:variant,name:variant,elevation:struct<unitCode:string,value:variant>>"


def geojson(docs: DataFrame) -> DataFrame:
    """Each document is a Point feature; coordinates must be numbers, the elevation in metres. Anemometer heights aren't published."""
    d = docs.select(F.from_json("value", FEATURE).alias("f")).select("f.*")
    lon, lat = (F.get("geometry.coordinates", F.lit(i)) for i in (0, 1))
    typed = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    name, high, unit = string(F.col("properties.stationIdentifier")), F.col("properties.elevation.value"), F.col("properties.elevation.unitCode")
    shape = F.col("properties").isNull() | ~F.coalesce(F.col("geometry.type") == "Point", F.lit(False)) | F.col("geometry.coordinates").isNull()
    code = first_failure([(shape, "bad-station"), (~typed(lat) | ~typed(lon), "bad-station"), (off_earth(number(lat), number(lon)), "bad-station"), (F.coalesce(name, F.lit("")) == "", "bad-station"), (~absent(high) & ~F.coalesce(unit.isin(METRE_CODES), F.lit(False)), "bad-unit")])
    return stations(d, code, station_id=name, name=string(F.col("properties.name")), lat=number(lat), lon=number(lon), elevation_m=number(high))


MESONET = """SUMMARY struct<RESPONSE_CODE:int>, UNITS map<string,string>, STATION array<struct<STID:variant,NAME:variant,STATUS:variant,STATE:variant,MNET_ID:variant,
 LATITUDE:variant,LONGITUDE:variant,ELEVATION:variant,ELEV_DEM:variant,UNITS:map<string,string>,SENSOR_VARIABLES:variant>>"""


def mesonet(docs: DataFrame) -> DataFrame:
    """Lists of stations; a station's units go before the document's. The height is that of the first wind sensor, null if it isn't given."""
    d = docs.select(F.from_json("value", MESONET).alias("d")).select("d.*")
    answered = F.coalesce(F.col("SUMMARY.RESPONSE_CODE") == 1, F.lit(False))
    rows = items(d.withColumn("STATION", F.when(answered, F.col("STATION"))), "STATION", "SUMMARY", "UNITS").where(~answered | F.col("pos").isNotNull())
    s = lambda n: F.col(f"s.{n}")
    unit = lambda k: F.coalesce(F.try_element_at(s("UNITS"), F.lit(k)), F.try_element_at(F.col("UNITS"), F.lit(k)))
    lat, lon = number(s("LATITUDE")), number(s("LONGITUDE"))
    sensor, bad_sensor = length(part(s("SENSOR_VARIABLES"), "$.wind_speed.wind_speed_1.position", "variant"), unit("position"))
    high, bad_high = length(s("ELEVATION"), unit("elevation"))
    dem, bad_dem = length(s("ELEV_DEM"), unit("elevation"))
    code = first_failure([(F.col("SUMMARY").isNull(), "bad-response"), (~answered, "synoptic-refused"), (F.col("s").isNull(), "bad-station"), (s("UNITS").isNull() & F.col("UNITS").isNull(), "no-units"), (F.coalesce(string(s("STID")), F.lit("")) == "", "bad-station"), (off_earth(lat, lon), "bad-station"), *bad_sensor, *bad_high, *bad_dem])
    return stations(rows, code, station_id=string(s("STID")), name=string(s("NAME")), lat=lat, lon=lon, elevation_m=high, dem_elevation_m=dem, sensor_height_m=sensor, network=part(s("MNET_ID"), "$"), status=string(s("STATUS")), state=string(s("STATE")))


REMOTE = """errors array<variant>, data struct<stationMetaData:struct<data:array<struct<station_id:variant,wrcc_id:variant,nesdis_id:variant,station_name:variant,latitude:variant,longitude:variant,
 elevation:variant,state:variant,agency:variant,network_name:variant,time_zone:variant,period_record_start:variant,period_record_stop:variant,has_historic_data:variant>>>>"""


def remote_stations(docs: DataFrame) -> DataFrame:
    """Answers of a directory of remote stations: elevations in feet, no anemometer heights; any error refuses the document."""
    d = docs.select(F.from_json("value", REMOTE).alias("d")).select("d.errors", F.col("d.data.stationMetaData.data").alias("list"))
    refused = F.coalesce(F.size("errors") > 0, F.lit(False))
    rows = items(d.select("errors", F.col("list").isNull().alias("none"), F.when(~refused, F.col("list")).alias("list")), "list", "errors", "none").where(refused | F.col("none") | F.col("pos").isNotNull())
    s = lambda n: F.col(f"s.{n}")
    lat, lon, feet = number(s("latitude")), number(s("longitude")), s("elevation")
    code = first_failure([(refused, "fems-refused"), (F.col("none"), "bad-response"), (absent(s("station_id")), "bad-station"), (off_earth(lat, lon), "bad-station"), (~absent(feet) & number(feet).isNull(), "bad-station")])
    more = {n: string(s(n)) for n in ("wrcc_id", "nesdis_id", "agency", "time_zone", "period_record_start", "period_record_stop")} | {"has_historic_data": F.when(F.col("s").isNotNull(), F.coalesce((F.schema_of_variant(s("has_historic_data")) == "BOOLEAN") & part(s("has_historic_data"), "$", "boolean"), F.lit(False)))}
    return stations(rows, code, more, station_id=part(s("station_id"), "$"), name=string(s("station_name")), lat=lat, lon=lon, elevation_m=number(feet) * FOOT, network=string(s("network_name")), state=string(s("state")))


def agricultural(docs: DataFrame) -> DataFrame:
    """Objects keyed by station; units must be metric. A height of 0 isn't one: it is unrecorded."""
    d = docs.select(F.from_json("value", "map<string,variant>").alias("m"))
    rows = d.select(F.coalesce(F.size("m"), F.lit(0)).alias("n"), F.explode_outer("m").alias("id", "s"))
    field = lambda n: part(F.col("s"), f"$.{n}", "variant")
    lat, lon, height = number(field("lat")), number(field("lon")), number(field("anemometerHeight"))
    code = first_failure([(F.col("n") <= 0, "bad-metadata"), (~F.coalesce(F.schema_of_variant("s").startswith("OBJECT"), F.lit(False)), "bad-station"), (~F.coalesce(string(field("units")) == "m", F.lit(False)), "bad-unit"), (off_earth(lat, lon), "bad-station")])
    inside = lat.between(COLORADO["south"], COLORADO["north"]) & lon.between(COLORADO["west"], COLORADO["east"])
    more = {n: string(field(n)) for n in ("location", "irrigation", "firstObs", "lastObs")} | {"timestep": number(field("timestep")).cast("int"), "height_published": height}
    return stations(rows, code, more, station_id=F.col("id"), name=string(field("name")), lat=lat, lon=lon, elevation_m=number(field("elevation")), sensor_height_m=F.when(height > 0, height), network=string(field("network")), status=string(field("active")), state=F.when(inside, "CO"))


def climate_reference(docs: DataFrame) -> DataFrame:
    """Tables of tab-separated lines under a fixed header; another header refuses the document. Elevations are feet without saying so.

    ``more`` holds the stem of the station's file names and how far (m) the two decimals of the position may be off.
    """
    filled = F.filter(F.split(F.coalesce("value", F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    head = F.array_join(F.transform(F.split(F.coalesce(F.get(filled, F.lit(0)), F.lit("")), "\t"), lambda h: F.trim(h)), ",")
    lines = docs.select((head != ",".join(CLIMATE_COLUMNS)).alias("other"), filled.alias("lines")).withColumn("lines", F.when(~F.col("other"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))))
    rows = lines.select("other", (F.size("lines") == 0).alias("empty"), F.explode_outer("lines").alias("line")).withColumn("f", F.split("line", "\t"))
    c = {n: F.trim(F.get("f", F.lit(i))) for i, n in enumerate(CLIMATE_COLUMNS)}
    said = lambda n: F.when(c[n] != "", c[n])
    lat, lon, feet = (finite(c[n].try_cast("double")) for n in ("LATITUDE", "LONGITUDE", "ELEVATION"))
    code = first_failure([(F.col("other") | F.coalesce(F.col("empty"), F.lit(False)), "bad-metadata"), (F.size("f") != len(CLIMATE_COLUMNS), "bad-station"), (off_earth(lat, lon), "bad-station")])
    half = POSITION_STEP / 2 * DEGREE
    unsure = F.floor(F.hypot(F.lit(half), half * F.cos(F.radians(lat))) + 0.5)
    more = {"file_stem": F.regexp_replace(F.concat_ws("_", c["STATE"], c["LOCATION"], c["VECTOR"]), r"\s+", "_"), "position_uncertainty_m": unsure, "elevation_ft": feet, "station_number": said("STATION_ID"), "commissioning": said("COMMISSIONING"), "closing": said("CLOSING")}
    return stations(rows, code, more, station_id=c["WBAN"], name=F.coalesce(said("NAME"), F.concat_ws(" ", c["LOCATION"], c["VECTOR"])), lat=lat, lon=lon, elevation_m=feet * FOOT, sensor_height_m=F.when(F.col("f").isNotNull(), CLIMATE_HEIGHT), network=said("NETWORK"), status=said("OPERATION"), state=said("STATE"))


HISTORY = """stationCollection struct<stations:array<struct<location:struct<latLonPairs:array<struct<latitude_dec:variant,longitude_dec:variant,precision:string>>,
 elevations:array<struct<elevationType:string,elevationMeters:variant>>>>>>"""


def refinements(docs: DataFrame, key: str) -> DataFrame:
    """Finer positions of climate stations, as ``reports.refined_positions`` joins them: ``key``, r_lat, r_lon, r_elevation, precision, code."""
    d = docs.select(key, F.from_json("value", HISTORY)["stationCollection"]["stations"].alias("all"))
    place = F.get("all", F.lit(0))["location"]
    first = F.get(place["latLonPairs"], F.lit(0))
    lat, lon = number(first["latitude_dec"]), number(first["longitude_dec"])
    ground = F.get(F.filter(place["elevations"], lambda e: e["elevationType"] == "GROUND"), F.lit(0))
    code = first_failure([(F.coalesce(F.size("all"), F.lit(0)) <= 0, "unknown-station"), (lat.isNull() | lon.isNull(), "bad-metadata")])
    return d.select(key, lat.alias("r_lat"), lon.alias("r_lon"), number(ground["elevationMeters"]).alias("r_elevation"), first["precision"].alias("precision"), code.alias("code"))


CATALOGUES = {"weather": geojson, "mesonet": mesonet, "remote": remote_stations, "agricultural": agricultural, "climate": climate_reference}


def union(raw: dict[str, DataFrame]) -> DataFrame:
    """Documents by network as one table of stations, with ``source``, the network's name here. Unknown networks are refused."""
    out = None
    for name, docs in raw.items():
        if name not in CATALOGUES:
            raise ValueError(f"no-such-network: {name}; there are {', '.join(CATALOGUES)}")
        read = CATALOGUES[name](docs).withColumn("source", F.lit(name))
        out = read if out is None else out.unionByName(read)
    if out is None:
        raise ValueError("no-network: nothing to read")
    return out
