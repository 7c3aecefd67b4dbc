import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfield.functions import geo as G
from gustfield.operators import grid, kernels, wind


def cells(spark, z):
    rows = [("d", r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "domain string, row int, col int, z double")


def plane(h=7, w=8, a=0.3, b=-0.1):
    y, x = np.mgrid[0:h, 0:w]
    return a * x * 10 - b * y * 10


def test_plane_slopes_alike_everywhere(spark):
    d = grid.slope_aspect(grid.neighbours(cells(spark, plane())), 10.0, 10.0)
    inner = d.where("slope_deg is not null").agg(F.count("*"), F.min("slope_deg"), F.max("slope_deg"), F.min("aspect_deg")).first()
    assert inner[0] == 5 * 6 and inner[1] == pytest.approx(inner[2])
    assert inner[1] == pytest.approx(math.degrees(math.atan(math.hypot(0.3, -0.1))))
    assert inner[3] == pytest.approx(math.degrees(math.atan2(-0.3, 0.1)) % 360)


def test_flat_has_slope_and_no_aspect(spark):
    r = grid.slope_aspect(grid.neighbours(cells(spark, np.zeros((3, 3)))), 1.0, 1.0).where("row = 1 and col = 1").first()
    assert (r.slope_deg, r.aspect_deg) == (0.0, None)


def test_paraboloid_curvature(spark):
    y, x = np.mgrid[0:5, 0:5] - 2.0
    r = grid.curvature(grid.neighbours(cells(spark, -(x**2 + y**2))), 1.0, 1.0).where("row = 2 and col = 2").first()
    assert r.total_curv == pytest.approx(4.0) and r.profile_curv is None


def test_void_spoils_its_neighbours(spark):
    z = plane()
    z[3, 3] = np.nan
    d = grid.roughness(grid.neighbours(cells(spark, z)))
    assert d.where("relief is not null").count() == 5 * 6 - 9


def test_disc_mean_is_the_kernel(spark):
    z = np.random.default_rng(1).normal(size=(20, 24))
    z[5, 5] = np.nan
    c = cells(spark, z)
    got = grid.disc_mean(c, spark.createDataFrame([("d", 20, 24)], "domain string, height int, width int"), 35.0, 10.0, 10.0).collect()
    want = kernels.disc_mean_grid(z, 35.0, 10.0, 10.0)
    for r in got:
        w = want[r.row, r.col]
        assert (r.disc_mean is None) == bool(np.isnan(w)) and (r.disc_mean is None or r.disc_mean == pytest.approx(w))


def test_sampler_edges(spark):
    z = np.array([[0.0, 10.0], [20.0, 30.0]])
    pts = spark.createDataFrame([(1, "d", 0.5, 0.5, 2, 2), (2, "d", -0.5, 0.0, 2, 2), (3, "d", -0.6, 0.0, 2, 2), (4, "d", 1.0, 1.0, 2, 2)], "id int, domain string, y double, x double, height int, width int")
    got = {r.id: r.z for r in grid.sample(pts, cells(spark, z), ["z"]).collect()}
    assert got == {1: 15.0, 2: 0.0, 3: None, 4: 30.0}


def test_downscale_of_flat_ground_changes_nothing(spark):
    d = cells(spark, np.zeros((4, 4))).select("*", F.lit(0.0).alias("slope_deg"), F.lit(None).cast("double").alias("aspect_deg"), F.lit(0.0).alias("total_curv"))
    r = wind.spread(wind.weights(d), F.lit(5.0), F.lit(270.0)).agg(F.min("speed"), F.max("speed"), F.max("turn_deg")).first()
    assert tuple(r) == (5.0, 5.0, 0.0)


def test_slope_that_faces_the_wind_speeds_it_up(spark):
    d = spark.createDataFrame([("d", 0, 0, 10.0, 270.0, 0.0), ("d", 0, 1, 10.0, 90.0, 0.0)], "domain string, row int, col int, slope_deg double, aspect_deg double, total_curv double")
    f = {r.col: r.factor for r in wind.spread(wind.weights(d), F.lit(5.0), F.lit(270.0)).collect()}
    assert f[0] == pytest.approx(1.25) and f[1] == pytest.approx(0.75)


def test_shelter_of_a_wall():
    z = np.zeros((9, 9))
    z[:, 6] = 50.0
    sx = kernels.shelter_grid(z, 10.0, 10.0, 4, 60.0)
    assert sx[1][4, 4] == pytest.approx(math.degrees(math.atan2(50, 20))) and sx[3][4, 4] == pytest.approx(0.0)


def test_shelter_of_tiles_is_that_of_the_whole(spark):
    z = np.random.default_rng(3).normal(size=(21, 26)) * 20
    z[9, 10] = z[0, 7] = z[15, 0] = np.nan
    got = {(r.row, r.col, r.sector_deg): r.sx_deg for r in kernels.shelter_tiled(cells(spark, z), 30.0, 20.0, 16, 125.0, tile=8).collect()}
    want = {(r.row, r.col, r.sector_deg): r.sx_deg for r in kernels.shelter(cells(spark, z), 30.0, 20.0, 16, 125.0).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_shelter_sx_is_that_of_the_whole_raster(spark):
    from gustfield.plans import catalogue
    from gustfield.plans import proxies as P

    sf = "/root/testdata/sf0.001"
    tile = F.concat_ws("-", F.floor(F.col("row") / 32), F.floor(F.col("col") / 32))
    whole = kernels.shelter(P.raster(spark, sf), P.CELL, P.CELL).groupBy(tile.alias("domain"), "sector_deg").agg(F.count("*").alias("cells"), F.avg("sx_deg").alias("mean_sx"))
    got, want = ({(r.domain, r.sector_deg): (r.cells, r.mean_sx) for r in d.collect()} for d in (catalogue.QUERIES["shelter_sx"](spark, sf), whole))
    assert len(got) == 16 * 32 and got.keys() == want.keys()
    for k, (n, mean) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(mean, abs=1e-6)


def test_mass_is_kept_and_solutions_add_up():
    y, x = np.mgrid[0:10, 0:12]
    z = 40 * np.exp(-((x - 6) ** 2 + (y - 5) ** 2) / 6)
    top = z.max() + 200
    dz = top / 6
    solid = ((np.arange(6) + 0.5) * dz)[:, None, None] <= z[None]
    u, v = np.full((6, 10, 13), 5.0), np.full((6, 11, 12), 1.0)
    a = kernels.mass_consistent(u, v, solid, 30.0, 30.0, dz, tol=1e-6)
    gain = (a[0][:, :, 1:] - a[0][:, :, :-1]) / 30 + (a[1][:, 1:] - a[1][:, :-1]) / 30 + (a[2][1:] - a[2][:-1]) / dz
    assert a[3] <= 1e-6 and np.abs(gain[~solid]).max() < 1e-5
    e, n = kernels.mass_consistent(u, v * 0, solid, 30.0, 30.0, dz, tol=1e-8), kernels.mass_consistent(u * 0, v, solid, 30.0, 30.0, dz, tol=1e-8)
    assert np.abs(e[0] + n[0] - a[0]).max() < 1e-3


def test_basis_combine_solves_every_tile(spark):
    from gustfield.plans import catalogue
    from gustfield.plans import proxies as P

    rows = P.table(spark, "/root/testdata/sf0.001", "embeddings").count()
    got = catalogue.QUERIES["basis_combine"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.domain for r in got}) == 2 * math.ceil(rows / 32) and len(got) == 4 * math.ceil(rows / 32)
    assert sum(r.cells for r in got if r.wind_id == 1) == rows * P.WIDTH


def test_unconverged_solves_are_told(spark):
    y, x = np.mgrid[0:10, 0:12]
    c = cells(spark, 60 * np.exp(-((x - 6.0) ** 2 + (y - 5.0) ** 2) / 4))
    winds = spark.createDataFrame([(1, 3.0, 1.0)], "wind_id int, e double, n double")
    for sweeps, want in ((4000, True), (10, False)):
        b = kernels.basis(c, 30.0, 30.0, sweeps=sweeps).cache()
        assert {r.converged for r in b.collect()} == {want} and all((r.residual <= kernels.TOL) == want for r in b.collect())
        f = wind.superpose(b, winds)
        assert {r.converged for r in f.select("converged").collect()} == {want}


def test_geodesic_lengths():
    lat, lon, back = kernels.direct(np.array([0.0, 45.0]), np.array([0.0, 10.0]), np.array([90.0, 0.0]), np.array([111319.49079327358, 100000.0]))
    assert lon[0] == pytest.approx(1.0, abs=1e-9) and lat[0] == pytest.approx(0.0, abs=1e-12)
    assert lat[1] == pytest.approx(45.899763, abs=1e-5) and back[1] == pytest.approx(0.0, abs=1e-9)


def test_conic_round_trip(spark):
    c = G.Conic(21.138, -122.72, 3000.0, 3000.0, -97.5, 38.5, 38.5)
    i, j = c.index(F.lit(40.0), F.lit(-105.25))
    la, lo = c.degrees(i, j)
    r = spark.range(1).select(i.alias("i"), la.alias("a"), lo.alias("o")).first()
    assert r.a == pytest.approx(40.0, abs=1e-9) and r.o == pytest.approx(-105.25, abs=1e-9) and 679 < r.i < 680


def test_utm(spark):
    e, n = G.utm_forward(F.lit(40.0), F.lit(-105.0), 13)
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert r.e == pytest.approx(500000.0, abs=1e-6) and r.n == pytest.approx(4427757.2188, abs=1e-2)


def test_level_near_the_ground():
    """A first centre just above the ground doesn't blow the wind up; higher ones are brought down by the logarithmic profile."""
    agl = np.array([[[0.001, 5.0, 30.0, -10.0]], [[50.001, 55.0, 80.0, 40.0]]])
    x = np.array([[[0.0, 2.0, 3.0, 9.0]], [[4.0, 6.0, 7.0, 8.0]]])
    got = kernels.at_level(x, agl, 10.0)[0]
    log = np.log(10 / 0.03)
    assert got == pytest.approx([4.0 * 9.999 / 50, 2.0 * 0.9 + 6.0 * 0.1, 3.0 * log / np.log(30 / 0.03), 8.0 * log / np.log(40 / 0.03)])
