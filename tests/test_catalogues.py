"""Station catalogues of each network: what is kept, and the code of each refusal."""

import json

import pytest
from pyspark.sql import functions as F

from gustfield.operators import reports
from gustfield.sources import catalogues as C


def docs(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) or v is None else json.dumps(v),) for v in values], "value string")


def codes(df):
    return [r.code for r in df.collect()]


def test_geojson(spark):
    p = {"geometry": {"type": "Point", "coordinates": [-105.25, 40]}, "properties": {"stationIdentifier": "KXYZ", "name": "Field", "elevation": {"unitCode": "wmoUnit:m", "value": 1600}}}
    place = lambda *c: p | {"geometry": {"type": "Point", "coordinates": list(c)}}
    prop = lambda **k: p | {"properties": p["properties"] | k}
    got = C.geojson(docs(spark, p, place(-105.25, "40"), place(-105.25, 91), place(-105.25), p | {"geometry": {"type": "Polygon", "coordinates": []}}, prop(stationIdentifier=7), prop(stationIdentifier=""), prop(elevation={"unitCode": "wmoUnit:ft", "value": 5}), prop(elevation={"unitCode": "wmoUnit:ft", "value": None}), prop(elevation=None, name=5), "no json", "", None)).collect()
    assert [r.code for r in got] == [None, *["bad-station"] * 6, "bad-unit", None, None, *["bad-station"] * 3]
    assert (got[0].station_id, got[0].name, got[0].lat, got[0].lon, got[0].elevation_m, got[0].sensor_height_m) == ("KXYZ", "Field", 40.0, -105.25, 1600.0, None)
    assert got[8].elevation_m is None and got[9].name is None


def test_mesonet(spark):
    s = {"STID": "ABC", "NAME": "Hill", "STATUS": "ACTIVE", "STATE": "CO", "MNET_ID": "2", "LATITUDE": "40.5", "LONGITUDE": -105, "ELEVATION": "1000", "ELEV_DEM": 990.0, "UNITS": {"elevation": "ft", "position": "m"}, "SENSOR_VARIABLES": {"wind_speed": {"wind_speed_1": {"position": "6.1"}}}}
    bad = [s | {"STID": None}, s | {"LATITUDE": "north"}, s | {"LATITUDE": None}, s | {"LONGITUDE": 181}, s | {"ELEVATION": "high"}, s | {"UNITS": {"elevation": "rod", "position": "m"}}, s | {"UNITS": {"elevation": "ft"}}, s | {"ELEVATION": "", "ELEV_DEM": None, "SENSOR_VARIABLES": {}}, None]
    got = C.mesonet(docs(spark, {"SUMMARY": {"RESPONSE_CODE": 1}, "STATION": [s, *bad]})).collect()
    assert [r.code for r in got] == [None, *["bad-station"] * 5, "bad-unit", "bad-unit", None, "bad-station"]
    assert (got[0].station_id, got[0].lat, got[0].lon, got[0].elevation_m, got[0].sensor_height_m, got[0].network) == ("ABC", 40.5, -105.0, pytest.approx(304.8), 6.1, "2")
    assert got[8].elevation_m is None and got[8].sensor_height_m is None
    # the document's units stand where the station has none; neither is an error
    top = {"SUMMARY": {"RESPONSE_CODE": 1}, "UNITS": {"elevation": "m", "position": "ft"}, "STATION": [s | {"UNITS": {"elevation": "ft"}}]}
    assert C.mesonet(docs(spark, top)).first().sensor_height_m == pytest.approx(6.1 * 0.3048)
    assert codes(C.mesonet(docs(spark, {"SUMMARY": {"RESPONSE_CODE": 1}, "STATION": [{k: v for k, v in s.items() if k != "UNITS"}]}))) == ["no-units"]
    assert codes(C.mesonet(docs(spark, {"SUMMARY": {"RESPONSE_CODE": 2}, "STATION": [s, s]}, {}, "", None))) == ["synoptic-refused", *["bad-response"] * 3]
    assert codes(C.mesonet(docs(spark, {"SUMMARY": {"RESPONSE_CODE": 1}, "STATION": []}))) == []


def test_remote_stations(spark):
    s = {"station_id": 12345, "station_name": "Ridge", "wrcc_id": "CRDG", "latitude": 39.5, "longitude": "-106.5", "elevation": 10000, "state": "CO", "network_name": "RAWS", "has_historic_data": True}
    answer = lambda *x: {"data": {"stationMetaData": {"data": list(x)}}}
    got = C.remote_stations(docs(spark, answer(s, s | {"station_id": None}, s | {"latitude": -91}, s | {"elevation": "tall"}, s | {"elevation": None, "has_historic_data": "true"}))).collect()
    assert [r.code for r in got] == [None, *["bad-station"] * 3, None]
    assert (got[0].station_id, got[0].lon, got[0].elevation_m, got[0].sensor_height_m, got[0].more["wrcc_id"], got[0].more["has_historic_data"]) == ("12345", -106.5, pytest.approx(3048.0), None, "CRDG", "true")
    assert got[4].elevation_m is None and got[4].more["has_historic_data"] == "false"
    assert codes(C.remote_stations(docs(spark, answer(s) | {"errors": [{"message": "no"}]}, {"data": None}, None, answer()))) == ["fems-refused", "bad-response", "bad-response"]


def test_agricultural(spark):
    s = {"name": "Gunnison", "units": "m", "lat": "38.5", "lon": -107.0, "elevation": 2300, "anemometerHeight": "2", "active": "y", "network": "agri", "timestep": 300, "firstObs": "2010-01-01"}
    got = {r.station_id: r for r in C.agricultural(docs(spark, {"a": s, "b": s | {"anemometerHeight": 0}, "c": s | {"units": "us"}, "d": s | {"lat": "x"}, "e": None, "f": s | {"lat": 45, "elevation": "-"}, "g": [1]})).collect()}
    assert {k: r.code for k, r in got.items()} == {"a": None, "b": None, "c": "bad-unit", "d": "bad-station", "e": "bad-station", "f": None, "g": "bad-station"}
    assert (got["a"].sensor_height_m, got["a"].state, got["a"].elevation_m, got["a"].more["timestep"]) == (2.0, "CO", 2300.0, "300")
    assert got["b"].sensor_height_m is None and got["b"].more["height_published"] == "0.0" and got["f"].state is None and got["f"].elevation_m is None
    assert codes(C.agricultural(docs(spark, {}, "[1]", "", None))) == ["bad-metadata"] * 4


def test_climate_reference(spark):
    head = "\t".join(C.CLIMATE_COLUMNS)
    line = lambda **k: "\t".join(({"WBAN": "94075", "STATE": "CO", "LOCATION": "Some Town", "VECTOR": "14 W", "LATITUDE": "40.04", "LONGITUDE": "-105.54", "ELEVATION": "9828", "NETWORK": "USCRN", "OPERATION": "Operational"} | k).get(c, "") for c in C.CLIMATE_COLUMNS)
    got = C.climate_reference(docs(spark, "\r\n".join([head, line(), "", line(LATITUDE="95"), line(ELEVATION="?", NAME="Named"), "short\tline"]))).collect()
    assert [r.code for r in got] == [None, "bad-station", None, "bad-station"]
    assert (got[0].station_id, got[0].name, got[0].elevation_m, got[0].sensor_height_m, got[0].more["file_stem"]) == ("94075", "Some Town 14 W", pytest.approx(9828 * 0.3048), 1.5, "CO_Some_Town_14_W")
    assert got[0].more["position_uncertainty_m"] == "701" and got[2].elevation_m is None and got[2].name == "Named"
    assert codes(C.climate_reference(docs(spark, head.replace("WBAN\tCOUNTRY", "COUNTRY\tWBAN") + "\n" + line(), head, "", None))) == ["bad-metadata"] * 4


def test_refinements_join_the_catalogue(spark):
    at = lambda lat, lon, *e: {"stationCollection": {"stations": [{"location": {"latLonPairs": [{"latitude_dec": lat, "longitude_dec": lon, "precision": "DDMMSS"}], "elevations": list(e)}}]}}
    found = [("a", at("40.0354", "-105.5409", {"elevationType": "BAROMETRIC", "elevationMeters": "1"}, {"elevationType": "GROUND", "elevationMeters": "2995.6"})), ("b", at(41, -105.54)), ("c", at(None, 1)), ("d", {"stationCollection": {"stations": []}}), ("e", {})]
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in found], "station_id string, value string")
    got = {r.station_id: r for r in C.refinements(raw, "station_id").collect()}
    assert {k: r.code for k, r in got.items()} == {"a": None, "b": None, "c": "bad-metadata", "d": "unknown-station", "e": "unknown-station"}
    assert (got["a"].r_lat, got["a"].r_elevation) == (40.0354, 2995.6)
    stations = spark.createDataFrame([(k, 40.04, -105.54, 2990.0) for k in "abc"], "station_id string, lat double, lon double, elevation double")
    refined = {r.station_id: r for r in reports.refined_positions(stations, C.refinements(raw, "station_id").where("code is null").drop("code"), "station_id").collect()}
    assert [refined[k].position_source for k in "abc"] == ["refined", "catalogue", "catalogue"] and refined["a"].elevation == 2995.6


def test_union(spark):
    one = docs(spark, {"a": {"units": "m", "lat": 40, "lon": -105}})
    got = C.union({"agricultural": one, "weather": docs(spark, None)})
    assert sorted((r.source, r.code) for r in got.select("source", F.coalesce("code", F.lit("")).alias("code")).collect()) == [("agricultural", ""), ("weather", "bad-station")]
    with pytest.raises(ValueError, match="no-such-network"):
        C.union({"nobody": one})
