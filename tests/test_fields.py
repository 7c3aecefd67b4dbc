"""Reference systems, rasters over each other, and lines: published values, brute force, refusals."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfield.functions import geo
from gustfield.operators import grid, kernels, resample, transects


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("code", [32613, 26913, 32756, 32601, 4326, 4269])
def test_round_trip(spark, code):
    crs = geo.reference_system(code)
    meridian, sign = getattr(crs, "meridian", 0.0), -1 if code // 100 == 327 else 1
    pts = spark.createDataFrame([(sign * a, (meridian + b + 180) % 360 - 180) for a in (0.0, 1e-7, 17.3, 40.02, 63.9, 83.9) for b in (-2.99, -0.4, 0.0, 2.9)], "lat double, lon double")
    x, y = crs.forward("lat", "lon")
    lat, lon = crs.inverse("x", "y")
    worst = pts.withColumns({"x": x, "y": y}).select(F.max(F.greatest(F.abs(lat - F.col("lat")), F.abs(lon - F.col("lon"))))).first()[0]
    assert worst < 1e-9


def test_published_positions(spark):
    """A zone's origin, and a power series for the meridian's arc (Snyder, 3-21) beside it."""
    x, y = geo.reference_system(32631).forward(F.lit(0.0), F.lit(3.0))
    assert one(spark, x, y) == (500000.0, 0.0)
    a, e2, phi = 6378137.0, 0.0066943799901413165, math.radians(52.5)
    arc = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))
    x, y = geo.reference_system(32633).forward(F.lit(52.5), F.lit(15.0))
    got = one(spark, x, y)
    assert got[0] == pytest.approx(500000, abs=1e-6) and got[1] == pytest.approx(0.9996 * arc, abs=1e-3)
    for code in (3857, 26924, 32661, 32700):
        with pytest.raises(ValueError, match="bad-crs"):
            geo.reference_system(code)


def test_published_geodesic():
    """Flinders Peak to Buninyong, from the manual of the Geocentric Datum of Australia."""
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    at = [np.array([v]) for v in (dms(-37, 57, 3.72030), dms(144, 25, 29.52440), dms(306, 52, 5.37), 54972.271)]
    lat, lon, back = (float(v[0]) for v in kernels.direct(*at))
    assert lat == pytest.approx(dms(-37, 39, 10.15610), abs=2e-8) and lon == pytest.approx(dms(143, 55, 35.38390), abs=2e-8)
    assert (back + 180) % 360 == pytest.approx(dms(127, 10, 25.07), abs=1e-5)


def cells(spark, z, name="z"):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, f"row int, col int, {name} double")


def bilinear(z, y, x, inner=False):
    """As a sampler of one raster would: NaN off it or beside a void."""
    h, w = z.shape
    edge = 0.0 if inner else 0.5
    if not (-edge - 1e-9 <= y <= h - 1 + edge + 1e-9 and -edge - 1e-9 <= x <= w - 1 + edge + 1e-9):
        return np.nan
    y, x = min(max(y, 0), h - 1), min(max(x, 0), w - 1)
    r, c = min(int(y), h - 2 if inner else h - 1), min(int(x), w - 2 if inner else w - 1)
    r2, c2 = min(r + 1, h - 1), min(c + 1, w - 1)
    fy, fx = y - r, x - c
    return (z[r, c] * (1 - fx) + z[r, c2] * fx) * (1 - fy) + (z[r2, c] * (1 - fx) + z[r2, c2] * fx) * fy


def test_sampler_voids(spark):
    z = np.array([[1.0, 2, 3], [4, np.nan, 6], [7, 8, 9]])
    asked = [(y, x) for y in (-0.6, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 2.51) for x in (-0.5, 0.0, 1.0, 1.5, 2.0, 2.4)]
    pts = spark.createDataFrame([(i, y, x, 3, 3, "d") for i, (y, x) in enumerate(asked)], "id int, y double, x double, height int, width int, domain string")
    for inner, tolerance in ((False, 0.5), (True, 1e-6)):
        got = {r.id: r.z for r in grid.sample(pts, cells(spark, z).withColumn("domain", F.lit("d")), ["z"], tolerance, inner).collect()}
        for i, (y, x) in enumerate(asked):
            want = bilinear(z, y, x, inner)
            assert got[i] == (None if np.isnan(want) else pytest.approx(want)), (inner, y, x)
    line = spark.createDataFrame([(0.0, 0.25, 1, 2, "d"), (0.3, 1.0, 1, 2, "d")], "y double, x double, height int, width int, domain string")
    assert [r.z for r in grid.sample(line, cells(spark, np.array([[0.0, 4.0]])).withColumn("domain", F.lit("d")), ["z"]).orderBy("y").collect()] == [1.0, 4.0]


FINE = resample.Grid(geo.Utm(13), 30, 24, 470000.0, 4430000.0, 30.0, -30.0)
OTHER = resample.Grid(geo.Geographic(), 7, 6, -105.351, 40.0195, 0.0015, -0.0012)


def positions(spark, place):
    lat, lon = place.centre("row", "col")
    full = spark.range(place.height * place.width).select(F.floor(F.col("id") / place.width).cast("int").alias("row"), (F.col("id") % place.width).cast("int").alias("col"))
    return {(r.row, r.col): (r.lat, r.lon) for r in full.select("row", "col", lat.alias("lat"), lon.alias("lon")).collect()}


def test_anomaly_over_another_grid(spark):
    rng = np.random.default_rng(2)
    z, base = rng.normal(size=(24, 30)), rng.normal(size=(6, 7))
    z[3, 4] = base[2, 5] = np.nan
    got = {(r.row, r.col): r.anomaly for r in resample.anomaly(cells(spark, z), FINE, cells(spark, base), OTHER).collect()}
    seen = 0
    for at, (lat, lon) in positions(spark, FINE).items():
        want = z[at] - bilinear(base, (lat - OTHER.origin_y) / OTHER.step_y - 0.5, (lon - OTHER.origin_x) / OTHER.step_x - 0.5)
        assert got[at] == (None if np.isnan(want) else pytest.approx(want, abs=1e-9))
        seen += not np.isnan(want)
    assert 200 < seen < 720
    assert resample.anomaly(cells(spark, z), FINE, cells(spark, base).where("false"), OTHER).where("anomaly is not null").count() == 0


def test_lattice_is_close_to_direct_sampling(spark):
    rng = np.random.default_rng(3)
    conic = geo.Conic(40.008, -105.352, 600.0, 600.0, -97.5, 38.5, 38.5)
    volume, u, v = resample.Volume(conic, 3, 4, 600.0), rng.normal(size=(3, 4)), rng.normal(size=(3, 4))
    wind = cells(spark, u, "east").join(cells(spark, v, "north"), ["row", "col"])
    fine, read = resample.reference_grid(spark, FINE, volume, wind)
    assert resample.lattice(FINE, 600.0) == (24, 30) and resample.lattice(FINE, 600.0, 200.0) == (5, 6)
    direct = volume.sample(spark.createDataFrame([(r, c, *ll) for (r, c), ll in positions(spark, FINE).items()], "row int, col int, lat double, lon double"), wind, ["east", "north"])
    want = {(r.row, r.col): r.east for r in direct.collect()}
    got = {(r.row, r.col): r.east for r in fine.collect()}
    assert got == {k: x if x is None else pytest.approx(x, abs=1e-9) for k, x in want.items()} and None in want.values()
    assert read.where("outside").count() == sum(x is None for x in want.values())
    rough = {(r.row, r.col): r.east for r in resample.reference_grid(spark, FINE, volume, wind, 200.0)[0].collect()}
    both = [k for k in rough if rough[k] is not None]
    assert both and max(abs(rough[k] - want[k]) for k in both) < 0.5
    with pytest.raises(ValueError, match="bad-sample"):
        resample.lattice(FINE, 600.0, 0.0)


def test_output_grids(spark):
    z = np.arange(24 * 30, dtype=float).reshape(24, 30)
    box = {"south": 40.013, "north": 40.0185, "west": -105.3505, "east": -105.342}
    got = resample.geographic(spark, cells(spark, z), FINE, box, ["z"], 20)
    height = resample.height_for(box, 20)
    assert got.count() == 20 * height and 0.5 < resample.covered(got, "z").first().covered <= 1
    lat, lon = got.where("row = 0 and col = 0").select("lat", "lon").first()
    assert lat == pytest.approx(box["north"] - (box["north"] - box["south"]) / height / 2) and lon == pytest.approx(box["west"] + (box["east"] - box["west"]) / 40)
    with pytest.raises(ValueError, match="bad-width"):
        resample.geographic(spark, cells(spark, z), FINE, box, ["z"], 1)
    field = cells(spark, z).withColumns({"east": F.lit(3.0), "north": F.when(F.col("col") < 20, -4.0)})
    points = resample.over_box(spark, field, FINE, box, 1, 3).orderBy("row").collect()
    assert [p.lat for p in points] == pytest.approx([40.0185, 40.01575, 40.013]) and points[0].lon == pytest.approx(-105.34625)
    assert points[1].speed == 5.0 and points[1].from_deg == pytest.approx(323.13, abs=0.01)


FIELD_BOX = resample.Grid(geo.Geographic(), 41, 41, -105.0205, 40.0205, 0.001, -0.001)


def uniform(spark, east, north):
    return cells(spark, np.full((41, 41), 100.0)).withColumns({"east": F.lit(float(east)), "north": F.lit(float(north))})


def line(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_id int, lat double, lon double, bearing double, length double, step double")


def test_transect(spark):
    lines = line(spark, (40.0, -105.0, 90.0, 1250.0, 500.0), (40.0, -105.0, 90.0, 9000.0, 500.0), (40.0, -105.0, 90.0, 0.0, 500.0), (40.0, -105.0, None, 1.0, 1.0), (91.0, 0.0, 0.0, 1.0, 1.0), (40.0, -105.0, 0.0, 100.0, 0.0), (40.0, -105.0, 0.0, 1000.0, 250.0))
    got = transects.transect(lines, uniform(spark, 0, 5), FIELD_BOX).orderBy("line_id", "dist").collect()
    first = [r for r in got if r.line_id == 0]
    assert [r.dist for r in first] == [0.0, 500.0, 1000.0, 1250.0] and {r.code for r in first} == {None} and {round(r.z, 9) for r in first} == {100.0}
    # a wind out of the south blows to the left of an eastward line, and the line turns
    assert all(r.cross == pytest.approx(-5, abs=1e-3) and r.from_deg == pytest.approx(180) for r in first)
    assert first[-1].bearing > 90.005 and first[-1].along == pytest.approx(5 * math.cos(math.radians(first[-1].bearing)))
    beyond = [r for r in got if r.line_id == 1]
    assert beyond[0].code is None and beyond[-1].code == "outside-domain" and beyond[-1].speed is None and len(beyond) == 19
    assert [(r.line_id, r.code, r.dist) for r in got if r.line_id in (2, 3, 4, 5)] == [(2, "bad-length", None), (3, "bad-bearing", None), (4, "bad-origin", None), (5, "bad-step", None)]
    assert [r.dist for r in got if r.line_id == 6] == [0.0, 250.0, 500.0, 750.0, 1000.0] and got[-1].along == pytest.approx(5)
    ends = {r.line_id: r for r in transects.convergence(lines, transects.transect(lines, uniform(spark, 0, 5), FIELD_BOX)).collect()}
    assert ends[0].convergence == pytest.approx(first[-1].bearing - 90) and ends[1].code == "outside-domain" and ends[6].code is None


def test_plane_and_profile(spark):
    lines = line(spark, (40.0, -105.0, -270.0, 914.4, 457.2), (40.0, -105.0, 90.0, 9000.0, 500.0))
    walked = transects.transect(lines, uniform(spark, 3, -4), FIELD_BOX)
    rows = transects.plane(walked, [2.0, 10.0, 30.48]).where("line_id = 0").orderBy("height", "dist").collect()
    assert [r.factor for r in rows[3:6]] == pytest.approx([1.0] * 3) and rows[0].factor == pytest.approx(math.log(2 / 0.03) / math.log(10 / 0.03))
    assert all(r.speed == pytest.approx(5 * r.factor) and r.up == 0 for r in rows)
    for heights, reference, roughness, code in (([], 10.0, 0.03, "bad-heights"), ([5.0, 5.0], 10.0, 0.03, "bad-heights"), ([5.0], None, 0.03, "no-height"), ([0.02], 10.0, 0.03, "bad-height"), ([5.0], 10.0, 0.0, "bad-roughness")):
        refused = transects.plane(walked, heights, reference, roughness).where("line_id = 0").collect()
        assert len(refused) > 0 and {r.code for r in refused} == {code} and {r.speed for r in refused} == {None}
    made = transects.profile(lines, transects.plane(walked, [2.0, 10.0, 30.48]), "test", wind_m=3000.0).collect()
    assert [r.line_id for r in made] == [0]  # the other leaves the field
    p = json.loads(made[0].json)
    assert p["schemaVersion"] == 1 and p["frame"] == "shooter" and p["azimuthDeg"] == 90 and p["terrainResolutionM"] is None and p["windSourceResolutionM"] == 3000
    assert p["rangesYards"] == pytest.approx([0, 500, 1000]) and p["heightsAglFt"] == pytest.approx([2 / 0.3048, 10 / 0.3048, 100])
    assert np.array(p["uFps"]).shape == (3, 3) and p["uFps"][1][0] == pytest.approx(3 / 0.3048, abs=1e-3) and p["vFps"][1][0] == pytest.approx(4 / 0.3048, abs=1e-3) and p["wFps"] == [[0, 0, 0]] * 3
    with pytest.raises(ValueError, match="no-source"):
        transects.profile(lines, transects.plane(walked, [2.0]), " ")
