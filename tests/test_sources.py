import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfield.sources import binary, listings, rejects, stations


def docs(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def codes(df):
    return [r.code for r in df.collect()]


def climate_line(wind="  3.50", flag="0", stamp="20240102 0305"):
    fields = ["94075", *stamp.split(), "20240101", "2005", "3", "-105.54", "40.04"] + ["0.0"] * 13
    line = [" "] * 134
    def put(at, text):
        line[at - 1 : at - 1 + len(text)] = text
    put(1, "94075"), put(7, stamp.split()[0]), put(16, stamp.split()[1]), put(21, "20240101"), put(30, "2005"), put(35, "     3"), put(42, "-105.54"), put(50, "  40.04")
    at = 58
    for k in range(13):
        put(at, "  0.0")
        at += 5 if k < 12 else 5
    put(127, wind), put(134, flag)
    del fields
    return "".join(line)


def test_climate_reference(spark):
    got = stations.climate_reference(docs(spark, climate_line(), climate_line("-99.00"), climate_line(flag="3"), climate_line("130.00"), "short", climate_line(stamp="20241402 0305"))).collect()
    assert [r.code for r in got] == [None, "no-wind", "flagged", "implausible", "bad-observations", "bad-time"]
    assert got[0].time == dt.datetime(2024, 1, 2, 3, 2, 30) and got[0].speed_mps == 3.5 and got[0].station_id == "94075"


def minute_line(stamp="202401012358", clock="0658", way="270", speed="10"):
    line = [" "] * 90
    for at, text in ((0, "94075"), (5, "KBDU"), (9, "BDU"), (13, stamp), (25, clock), (70, way.rjust(4)), (74, speed.rjust(5)), (79, "  280"), (84, "   15")):
        line[at : at + len(text)] = text
    return "".join(line)


def test_one_minute_records_are_utc(spark):
    got = stations.one_minute(docs(spark, minute_line(), minute_line(speed="M"), minute_line(speed="1", way="0"), minute_line(clock="9999"), "x", minute_line(speed="300"))).collect()
    assert got[0].time == dt.datetime(2024, 1, 2, 6, 58) and got[0].speed_mps == pytest.approx(10 * 1852 / 3600) and got[0].from_deg == 270
    assert [r.code for r in got] == [None, "no-wind", None, "bad-time", "malformed", "implausible"]
    assert got[2].calm and got[2].from_deg is None


HEAD = ["StationId", "DateTime", "ObservationType", "WindSpeed(mph)", "WindAzimuth(degrees)", "GustSpeed(mph)", "WSflag", "WAflag"]


def test_remote_stations(spark):
    rows = [("7", "2024-01-01T12:00:00Z", "O", "10", "360", "12", "", ""), ("7", "", "O", "1", "1", "1", "", ""), ("7", "nonsense", "O", "1", "1", "1", "", ""), ("7", "2024-01-01T12:00:00Z", "F", "1", "1", "1", "", ""), ("8", "2024-01-01T12:00:00Z", "O", "1", "1", "1", "", ""), ("7", "2024-01-01T12:00:00Z", "O", "", "1", "1", "", ""), ("7", "2024-01-01T12:00:00Z", "O", "x", "1", "1", "", ""), ("7", "2024-01-01T12:00:00Z", "O", "200", "1", "1", "", ""), ("7", "2024-01-01T12:00:00Z", "O", "1", "1", "1", "3", ""), ("7", "2024-01-01T12:00:00Z", "O", "0", "90", "", "", "")]
    table = spark.createDataFrame(rows, HEAD)
    minutes = spark.createDataFrame([("7", 41)], "station_id string, transmit_minute int")
    got = stations.remote_stations(table, minutes).collect()
    assert [r.code for r in got] == [None, "no-data", "bad-time", "not-an-observation", "no-transmit-minute", "no-wind", "bad-observation", "implausible", "bad-quality", None]
    assert got[0].time == dt.datetime(2024, 1, 1, 11, 41) and got[0].from_deg == 0 and got[0].speed_mps == pytest.approx(4.4704)
    assert got[9].calm and got[9].from_deg is None
    with pytest.raises(ValueError, match="bad-unit"):
        stations.remote_stations(table.withColumnRenamed("WindSpeed(mph)", "WindSpeed(furlong)"), minutes)


def test_agricultural(spark):
    d = {"station": "GUN01", "units": "m", "timezone": "MST", "tzOffset": "-07:00", "timestep": 300, "time": ["2024-01-01 00:05", "2024-01-01 00:10", "", "2024-01-01 00:20"], "windSpeed": [2.0, -999.0, 1.0, 500.0], "windDir": [10.0, 20.0, 30.0, 40.0], "gustSpeed": [3.0, None, 1.0, 1.0]}
    got = stations.agricultural(docs(spark, json.dumps(d))).collect()
    assert [r.code for r in got] == [None, "no-wind", "blank", "implausible"]
    assert got[0].time == dt.datetime(2024, 1, 1, 7, 2, 30) and got[0].station_id == "gun01"
    assert codes(stations.agricultural(docs(spark, json.dumps(d | {"units": "us"}))))[0] == "bad-unit"
    assert codes(stations.agricultural(docs(spark, json.dumps(d | {"windDir": [1.0]}))))[0] == "bad-observations"


def test_geojson(spark):
    q = lambda v, u="wmoUnit:km_h-1", c="V": {"unitCode": u, "value": v, "qualityControl": c}
    p = [{"stationId": "https://x/stations/kbdu", "timestamp": "2024-01-01T00:00:00+00:00", "windSpeed": q(36.0), "windGust": q(72.0), "windDirection": q(180, "wmoUnit:degree_(angle)")}]
    p += [p[0] | {"timestamp": "never"}, p[0] | {"windSpeed": q(1.0, c="X")}, p[0] | {"windSpeed": q(None)}, p[0] | {"windSpeed": q(1.0, "wmoUnit:furlong")}, p[0] | {"windSpeed": q(900.0)}]
    got = stations.geojson(docs(spark, json.dumps({"features": [{"properties": x} for x in p]}))).collect()
    assert [r.code for r in got] == [None, "bad-time", "bad-quality", "no-wind", "bad-unit", "implausible"]
    assert (got[0].station_id, got[0].speed_mps, got[0].gust_mps, got[0].from_deg) == ("KBDU", pytest.approx(10.0), pytest.approx(20.0), 180.0)


def test_mesonet(spark):
    o = {"date_time": ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z", "2024-01-01T02:00:00Z"], "wind_speed_set_1": [5.0, 6.0, None], "wind_direction_set_1": [10.0, 20.0, 30.0], "wind_gust_set_1": [None, None, None]}
    d = {"SUMMARY": {"RESPONSE_CODE": 1}, "UNITS": {"wind_speed": "kt"}, "STATION": [{"STID": "abc", "UNITS": {"wind_speed": "m/s"}, "OBSERVATIONS": o, "QC": {"wind_speed_set_1": [None, "[3]", None]}}]}
    got = stations.mesonet(docs(spark, json.dumps(d))).collect()
    assert [r.code for r in got] == [None, "bad-quality", "no-wind"] and got[0].speed_mps == 5.0 and got[0].station_id == "ABC"
    assert set(codes(stations.mesonet(docs(spark, json.dumps(d | {"SUMMARY": {"RESPONSE_CODE": 2}}))))) == {"synoptic-refused"}


def test_counts_and_strict(spark):
    d = spark.createDataFrame([(True, None, None), (False, 3.0, None), (False, None, "no-wind")], "calm boolean, from_deg double, code string")
    assert tuple(rejects.counts(d).first()) == (3, 2, 1, 1, 1)
    with pytest.raises(Exception, match="no-wind"):
        rejects.strict(d).collect()


def test_index(spark):
    lines = spark.createDataFrame([("f", "1:0:d=2024010100:UGRD:10 m above ground:anl:"), ("f", "2:100:d=2024010100:VGRD:10 m above ground:anl:"), ("f", "<html>"), ("f", "")], "file string, value string")
    e = listings.index_entries(lines)
    got = {r.message: (r.start, r.last, r.code) for r in e.collect()}
    assert got["1"] == (0, 99, None) and got["2"] == (100, None, None) and got["<html>"][2] == "bad-index"
    wanted = spark.createDataFrame([("UGRD", "10 m above ground", "anl"), ("TMP", "surface", "anl")], "parameter string, level string, forecast string")
    assert sorted((r.parameter, r.start) for r in listings.select_entries(e, wanted).collect()) == [("TMP", None), ("UGRD", 0)]


def test_products(spark):
    item = {"title": "t", "sourceId": "s", "format": "x", "downloadURL": "http://a/b.TIF", "boundingBox": {"minX": -1.0, "maxX": 1.0, "minY": 2.0, "maxY": 3.0}, "publicationDate": "2020-01-01", "sizeInBytes": 5}
    got = listings.products(docs(spark, json.dumps({"total": 3, "items": [item, item | {"downloadURL": "http://a/b.zip"}, item | {"boundingBox": None}]}))).collect()
    assert [(r.readable, r.west, r.north) for r in got] == [(True, -1.0, 3.0), (False, -1.0, 3.0)]


# ---- messages

def message(values, ni, nj, template=0, bits=12, bitmap=None, raw=None, extra=b"", data=None):
    sec = lambda n, body: struct.pack(">IB", len(body) + 5, n) + body
    one = sec(1, struct.pack(">HHBBBHBBBBBBB", 7, 0, 2, 1, 1, 2024, 1, 2, 3, 0, 0, 0, 1))
    grid = bytearray(81 - 5)
    put = lambda at, size, v: grid.__setitem__(slice(at - 5, at - 5 + size), int(v).to_bytes(size, "big"))
    put(6, 4, ni * nj), put(12, 2, 30), put(30, 4, ni), put(34, 4, nj), put(38, 4, 21138123), put(42, 4, 237280472), put(46, 1, 8), put(47, 4, 38500000), put(51, 4, 262500000), put(55, 4, 3000000), put(59, 4, 3000000), put(64, 1, 64), put(65, 4, 38500000), put(69, 4, 38500000)
    product = bytearray(34 - 5)
    product[9 - 5], product[10 - 5], product[17 - 5], product[22 - 5] = 2, 2, 1, 103
    product[18 - 5 : 22 - 5], product[24 - 5 : 28 - 5] = (3).to_bytes(4, "big"), (10).to_bytes(4, "big")
    n = len(values) if raw is None else raw
    drs = struct.pack(">IHfHHB", n, template, 0.0, 0, 0, bits) + b"\0" + extra
    if data is None:
        b = "".join(f"{int(v):0{bits}b}" for v in values)
        data = int(b.ljust(-(-len(b) // 8) * 8, "0"), 2).to_bytes(-(-len(b) // 8), "big")
    six = b"\xff" if bitmap is None else b"\0" + np.packbits(bitmap).tobytes()
    body = one + sec(3, bytes(grid)) + sec(4, bytes(product)) + sec(5, drs) + sec(6, six) + sec(7, data)
    return b"GRIB\0\0\0\x02" + (16 + len(body) + 4).to_bytes(8, "big") + body + b"7777"


def test_simple_packing_and_bitmap(spark):
    have = np.array([1, 1, 0, 1, 1, 1], bool)
    data = message([1, 2, 4, 5, 6], 3, 2, bitmap=have) + message([7, 8, 9, 10, 11, 12], 3, 2)
    f = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    got = binary.read_messages(f).orderBy("message", "j", "i").collect()
    assert [r.value for r in got[:6]] == [1, 2, None, 4, 5, 6] and [r.value for r in got[6:]] == [7, 8, 9, 10, 11, 12]
    assert (got[0].category, got[0].number, got[0].level, got[0].lead_minutes) == (2, 2, 10.0, 180)


def test_groups_with_second_differences():
    x = np.array([5, 9, 14, 18, 25, 27, 40, 41, 41, 60])
    d2 = np.diff(x, 2)
    low = d2.min()
    rest = np.concatenate([[0, 0], d2 - low])
    lens, widths = [4, 6], []
    groups = np.split(rest, [4])
    refs = [int(g.min()) for g in groups]
    widths = [int((g - r).max()).bit_length() for g, r in zip(groups, refs)]
    bitstr = lambda vs, w: "".join(f"{int(v):0{w}b}" for v in vs) if w else ""
    pad = lambda b: int(b.ljust(-(-len(b) // 8) * 8, "0"), 2).to_bytes(-(-len(b) // 8), "big") if b else b""
    sign = (abs(int(low)) | (0x8000 if low < 0 else 0)).to_bytes(2, "big")
    data = int(x[0]).to_bytes(2, "big") + int(x[1]).to_bytes(2, "big") + sign + pad(bitstr(refs, 8)) + pad(bitstr(widths, 4)) + pad(bitstr([0, 0], 3)) + pad("".join(bitstr(g - r, w) for g, r, w in zip(groups, refs, widths)))
    # after the type of values: splitting, two missing values, groups, widths, lengths, order
    extra = b"\x01\0" + b"\0" * 8 + struct.pack(">IBBIBIB", 2, 0, 4, 4, 1, lens[1], 3) + bytes([2, 2])
    msg = message(x, 5, 2, template=3, bits=8, extra=extra, data=data, raw=10)
    assert binary.messages(msg)[0]["values"].tolist() == x.tolist()


@pytest.mark.parametrize("spoil, code", [(lambda m: b"GRIX" + m[4:], "not-grib"), (lambda m: m[:7] + b"\x01" + m[8:], "unsupported-edition"), (lambda m: m[:-4] + b"7778", "truncated")])
def test_bad_messages(spoil, code):
    with pytest.raises(ValueError, match=code):
        binary.messages(spoil(message([1, 2, 3, 4], 2, 2)))


# ---- rasters

def tiff(z, tile=16, compression=1, predictor=1, nodata=None):
    h, w = z.shape
    blobs = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            t = np.zeros((tile, tile), np.float32)
            part = z[y : y + tile, x : x + tile]
            t[: part.shape[0], : part.shape[1]] = part
            raw = t.astype("<f4").tobytes()
            if predictor == 3:
                b = np.frombuffer(t.astype(">f4").tobytes(), np.uint8).reshape(tile, tile, 4).transpose(0, 2, 1).reshape(tile, -1)
                raw = np.diff(b, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
            if predictor == 2:
                raw = np.diff(t.view("<u4"), axis=1, prepend=np.uint32(0)).astype("<u4").tobytes()
            blobs.append(zlib.compress(raw) if compression == 8 else raw)
    at, offsets, body = 8, [], b""
    for b in blobs:
        offsets.append(at + len(body))
        body += b
    tags, tail = [], b""
    base = 8 + len(body)

    def add(tag, kind, values):
        nonlocal tail
        code = {2: None, 3: "H", 4: "I", 12: "d"}[kind]
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{code}", *values)
        n = len(values)
        if len(raw) <= 4:
            tags.append(struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0"))
        else:
            tags.append(struct.pack("<HHII", tag, kind, n, base + len(tail)))
            tail += raw + b"\0" * (len(raw) % 2)

    add(256, 4, [w]), add(257, 4, [h]), add(258, 3, [32]), add(259, 3, [compression]), add(277, 3, [1]), add(317, 3, [predictor]), add(322, 4, [tile]), add(323, 4, [tile]), add(324, 4, offsets), add(325, 4, [len(b) for b in blobs]), add(339, 3, [3]), add(33550, 12, [10.0, 10.0, 0.0]), add(33922, 12, [0.0, 0, 0, 500000.0, 4400000.0, 0]), add(34735, 3, [1, 1, 0, 1, 3072, 0, 1, 26913])
    if nodata is not None:
        add(42113, 2, str(nodata).encode() + b"\0")
    return b"II*\0" + struct.pack("<I", base + len(tail)) + body + tail + struct.pack("<H", len(tags)) + b"".join(sorted(tags)) + b"\0" * 4


@pytest.mark.parametrize("compression, predictor", [(1, 1), (8, 1), (8, 2), (8, 3)])
def test_raster_round_trip(spark, compression, predictor):
    z = np.random.default_rng(3).normal(1500, 30, (20, 40)).astype(np.float32)
    z[3, 4] = -9999
    r = binary.Raster(tiff(z, compression=compression, predictor=predictor, nodata=-9999))
    assert r.epsg == 26913 and r.transform == (500000.0, 4400000.0, 10.0, -10.0)
    got = r.window(2, 3, 17, 30)
    want = np.where(z == -9999, np.nan, z)[2:19, 3:33]
    assert np.array_equal(got, want, equal_nan=True)
    f = spark.createDataFrame([("a", bytearray(tiff(z, nodata=-9999)))], "path string, content binary")
    assert binary.read_rasters(f).agg(F.count("*"), F.count("z")).first() == (800, 799)


def test_lzw():
    def pack(codes):
        bits = "".join(f"{c:09b}" for c in codes)
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert binary.lzw(pack([256, 65, 66, 258, 260, 257])) == b"ABABABA"
    with pytest.raises(ValueError, match="lzw"):
        binary.lzw(pack([256, 65, 400, 257]))


def test_png_reads_back():
    z = np.random.default_rng(5).integers(0, 255, (9, 7)).astype(np.uint8)
    data = binary.png(z)
    at, parts = 8, {}
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + n
    raw, out = zlib.decompress(parts[b"IDAT"]), np.zeros((10, 8), int)
    for r in range(9):
        f = raw[r * 8]
        for c in range(7):
            a, b, d = out[r + 1, c], out[r, c + 1], out[r, c]
            p = a + b - d
            near = min((abs(p - v), k, v) for k, v in enumerate((a, b, d)))[2]
            out[r + 1, c + 1] = (raw[r * 8 + 1 + c] + (0, a, b, (a + b) // 2, near)[f]) % 256
    assert np.array_equal(out[1:, 1:], z)
