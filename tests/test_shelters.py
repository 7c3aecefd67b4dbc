"""Fields at points: bearings through gradients, shelter between sectors, true north on projected grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfield.functions import geo as G
from gustfield.operators import kernels, shelters
from gustfield.operators.resample import Grid


def at(spark, *rows):
    return spark.createDataFrame([("d", float(y), float(x), b, 3, 3) for y, x, b in rows], "domain string, y double, x double, from_deg double, height int, width int")


def test_brackets(spark):
    one = spark.createDataFrame([(b,) for b in (0.0, 9.0, 10.0, 50.0, 100.0, 355.0, -20.0, 370.0)], "b double")
    got = [tuple(r) for r in one.select(*shelters.bracket(F.col("b"), [10.0, 90.0, 300.0])).collect()]
    want = [(2, 0, 60 / 70), (2, 0, 69 / 70), (0, 1, 0.0), (0, 1, 0.5), (1, 2, 10 / 210), (2, 0, 55 / 70), (2, 0, 40 / 70), (0, 1, 0.0)]
    assert [w[:2] for w in want] == [g[:2] for g in got] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert tuple(one.select(*shelters.bracket(F.col("b"), [90.0])).first()) == (0, 0, 0.75)
    for bad in ([], [20.0, 10.0], [0.0, 360.0]):
        with pytest.raises(ValueError, match="bad-sectors"):
            shelters.bracket(F.col("b"), bad)


def test_shelter_between_sectors(spark):
    sx = spark.createDataFrame([("d", r, c, s, s / 10 + r) for r in range(3) for c in range(3) for s in (0.0, 90.0, 180.0, 270.0) if (r, c, s) != (2, 2, 90.0)], "domain string, row int, col int, sector_deg double, sx_deg double")
    got = shelters.shelter_at(at(spark, (0.5, 0.5, 45.0), (0, 0, 315.0), (1.5, 1.5, 45.0), (1.5, 1.5, 225.0), (9, 0, 45.0), (0, 0, None)), sx, [0.0, 90.0, 180.0, 270.0])
    assert [r.shelter_deg for r in got.collect()] == [pytest.approx(5.0), pytest.approx(13.5), None, pytest.approx(24.0), None, None]


def test_aspect_through_gradients(spark):
    slopes = spark.createDataFrame([("d", r, c, 0.1 if c == 0 else -0.1 if c == 1 else 0.0, -1.0 if c < 2 else 0.0) for r in range(3) for c in range(3)], "domain string, row int, col int, dzdx double, dzdy double")
    got = [r.aspect_deg for r in shelters.aspect_at(at(spark, (1, 0, None), (1, 1, None), (1, 0.5, None), (1, 2, None), (-3, 0, None)), slopes).collect()]
    assert got == [pytest.approx(360 - math.degrees(math.atan(0.1))), pytest.approx(math.degrees(math.atan(0.1))), pytest.approx(0.0, abs=1e-9), None, None]
    with pytest.raises(ValueError, match="circular-field"):
        shelters.field_at(at(spark, (0, 0, None)), slopes.withColumn("aspect_deg", F.lit(1.0)), "aspect_deg")
    with pytest.raises(ValueError, match="no-such-field"):
        shelters.field_at(at(spark, (0, 0, None)), slopes, "height")
    assert shelters.field_at(at(spark, (1, 0.5, None)), slopes, "dzdx").first().dzdx == pytest.approx(0.0)


def test_convergence(spark):
    turn = lambda east, crs=G.Utm(13): spark.range(1).select(shelters.convergence(Grid(crs, 100, 100, east, 4430000.0, 30.0, -30.0))).first()[0]
    # east of the central meridian true north lies west of grid north, by the difference in longitude times the sine of latitude
    lat, lon = spark.range(1).select(*G.Utm(13).inverse(F.lit(701500.0), F.lit(4428500.0))).first()
    assert turn(700000.0) == pytest.approx(-math.degrees(math.atan(math.tan(math.radians(lon + 105)) * math.sin(math.radians(lat)))), abs=1e-3)
    assert turn(498500.0) == pytest.approx(0.0, abs=1e-9) and turn(300000.0) > 1 and turn(0.0, G.Geographic()) == 0


def test_turned_sectors_look_elsewhere(spark):
    z = np.zeros((21, 21))
    z[:, 14:] = 50.0
    rows = spark.createDataFrame([("d", r, c, float(z[r, c])) for r in range(21) for c in range(21)], "domain string, row int, col int, z double")
    turns = spark.createDataFrame([("d", 90.0), ("other", 5.0)], "domain string, turn_deg double")
    plain = {(r.row, r.col, r.sector_deg): r.sx_deg for r in kernels.shelter_tiled(rows, 10.0, 10.0, 4, 50.0, tile=8).collect()}
    turned = {(r.row, r.col, r.sector_deg): r.sx_deg for r in kernels.shelter_tiled(rows, 10.0, 10.0, 4, 50.0, tile=8, turns=turns).collect()}
    assert plain[10, 11, 90.0] > 50 and plain[10, 11, 180.0] == pytest.approx(0.0)
    assert all(turned[r, c, (s + 90) % 360] == pytest.approx(v) for (r, c, s), v in plain.items())
