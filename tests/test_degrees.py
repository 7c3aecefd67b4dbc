"""Discs on rasters in degrees against a plain search, and what is broadcast."""

import math

import numpy as np
import pytest

from gustfield.functions import geo as G
from gustfield.functions.sizes import small
from gustfield.operators import kernels


def plain(z, radius, place, coverage=0.9):
    h, w = z.shape
    out = np.full(z.shape, np.nan)
    for r in range(h):
        dx = float(place.along_rows(np.array([r]))[0])
        for c in range(w):
            cells = [(r + i, c + j) for i in range(-h, h + 1) for j in range(-w, w + 1) if abs(i) * place.down <= radius and abs(j) <= math.sqrt(max(radius**2 - (i * place.down) ** 2, 0)) // dx]
            if all(0 <= a < h and 0 <= b < w for a, b in cells):
                there = [z[a, b] for a, b in cells if not np.isnan(z[a, b])]
                if len(there) >= coverage * len(cells):
                    out[r, c] = np.mean(there)
    return out


@pytest.mark.parametrize("first_lat", [84.0, 0.12, -60.0])
def test_discs_widen_towards_the_poles(spark, first_lat):
    place = G.Degrees(first_lat, 0.01)
    z = np.random.default_rng(2).normal(size=(24, 40))
    z[7, 9] = z[3, 3] = np.nan
    rows = [("d", r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(24) for c in range(40)]
    cells = spark.createDataFrame(rows, "domain string, row int, col int, z double")
    want = plain(z, 2600.0, place)
    got = kernels.disc_mean_tiled(cells, 2600.0, place, place.down, tile=8).collect()
    assert len(got) == z.size and not np.isnan(want).all() or abs(first_lat) > 80
    for r in got:
        w = want[r.row, r.col]
        assert (r.disc_mean is None) == bool(np.isnan(w)) and (r.disc_mean is None or r.disc_mean == pytest.approx(w))


def test_spacing_is_alike_in_both_forms(spark):
    place = G.Degrees(89.0, 0.5)
    got = [r.m for r in spark.range(6).select(place.along("id").alias("m")).collect()]
    assert got == pytest.approx(list(place.along_rows(np.arange(6))))


def test_only_small_sides_are_broadcast(spark):
    big, side = spark.range(1000), spark.range(10)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(big.join(small(side), "id"))
    assert "ResolvedHint" not in plan(big.join(small(side, most_rows=9), "id"))
