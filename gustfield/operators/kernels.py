"""What columns can't express: iterative solves and ray marches. One domain, or one line, is one group of a numpy kernel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.sizes import small

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
#: Residual of a solve, relative to the divergence at first, up to which it counts as converged.
TOL = 1e-4


def as_grid(pdf: pd.DataFrame, value: str = "z") -> np.ndarray:
    out = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.nan)
    out[pdf["row"], pdf["col"]] = pdf[value].to_numpy(float)
    return out


def bilinear(z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """NaN beyond the outermost centres and beside voids."""
    h, w = z.shape
    ok = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    r, c = np.clip(np.floor(y).astype(int), 0, max(h - 2, 0)), np.clip(np.floor(x).astype(int), 0, max(w - 2, 0))
    fy, fx = y - r, x - c
    r2, c2 = np.minimum(r + 1, h - 1), np.minimum(c + 1, w - 1)
    out = (z[r, c] * (1 - fx) + z[r, c2] * fx) * (1 - fy) + (z[r2, c] * (1 - fx) + z[r2, c2] * fx) * fy
    return np.where(ok, out, np.nan)


def shelter_grid(z: np.ndarray, dx: float, dy: float, sectors: int = 16, reach: float = 300.0, step: float | None = None, own: tuple[slice, slice] | None = None, turn: float = 0.0) -> np.ndarray:
    """Largest angle (degrees) up to the terrain towards each sector, sector by sector; NaN where nothing is seen. A march ends at the first void.

    With ``own`` only those cells are looked from, and the border ring is left to the caller. ``turn`` is where true north is drawn on the grid (degrees from
    its own north): sectors are true bearings.
    """
    step = step or min(dx, dy)
    rows, cols = (a[own] if own else a for a in np.mgrid[0 : z.shape[0], 0 : z.shape[1]].astype(float))
    here = z[own] if own else z
    out = np.full((sectors, *here.shape), np.nan)
    for k in range(sectors):
        b = 2 * math.pi * k / sectors - math.radians(turn)
        alive = ~np.isnan(here)
        for s in range(1, max(1, int(reach // step)) + 1):
            d = s * step
            # rounded, so that a march along a row stays on it wherever the grid's origin lies
            seen = bilinear(z, rows - round(d * math.cos(b) / dy, 9), cols + round(d * math.sin(b) / dx, 9))
            alive &= ~np.isnan(seen)
            if not alive.any():
                break
            angle = np.degrees(np.arctan2(seen - here, d))
            out[k] = np.where(alive, np.fmax(out[k], angle), out[k])
    if not own:
        out[:, 0, :] = out[:, -1, :] = out[:, :, 0] = out[:, :, -1] = np.nan
    return out


def shelter(cells: DataFrame, dx: float, dy: float, sectors: int = 16, reach: float = 300.0) -> DataFrame:
    """(domain, row, col, sector_deg, sx_deg); interior cells. A domain is a group: its size is the caller's tiling."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sx = shelter_grid(as_grid(pdf), dx, dy, sectors, reach)
        k, r, c = np.nonzero(~np.isnan(sx))
        return pd.DataFrame({"domain": pdf["domain"].iloc[0], "row": r.astype("int32"), "col": c.astype("int32"), "sector_deg": k * 360.0 / sectors, "sx_deg": sx[k, r, c]})

    return cells.select("domain", "row", "col", "z").groupBy("domain").applyInPandas(run, "domain string, row int, col int, sector_deg double, sx_deg double")


def shelter_tiled(cells: DataFrame, dx: float, dy: float, sectors: int = 16, reach: float = 300.0, tile: int = 32, turns: DataFrame | None = None) -> DataFrame:
    """What ``shelter`` gives, with ``tile_row`` and ``tile_col``: a group is a tile of ``tile`` x ``tile`` cells with a halo of the reach.

    The extent of each raster (one row) is broadcast, so that only the raster's own border is left out. ``turns`` (domain, turn_deg; see
    ``shelters.convergence``) turns the sectors of projected rasters to true bearings; domains that it doesn't name aren't turned.
    """
    step = min(dx, dy)
    far = max(step, reach)  # at least one step is marched
    halo_y, halo_x = math.ceil(far / dy) + 1, math.ceil(far / dx) + 1

    def tiles(at: str, last: str, halo: int):
        return F.explode(F.sequence(F.greatest(F.floor((F.col(at) - halo) / tile), F.lit(0)), F.least(F.floor((F.col(at) + halo) / tile), F.floor(F.col(last) / tile))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        tr, tc, h, w = int(first["tile_row"]), int(first["tile_col"]), int(first["last_row"]) + 1, int(first["last_col"]) + 1
        top, left = max(tr * tile - halo_y, 0), max(tc * tile - halo_x, 0)
        z = np.full((min((tr + 1) * tile + halo_y, h) - top, min((tc + 1) * tile + halo_x, w) - left), np.nan)
        z[pdf["row"] - top, pdf["col"] - left] = pdf["z"].to_numpy(float)
        # own cells but for the raster's border
        r0, r1, c0, c1 = max(tr * tile, 1), min((tr + 1) * tile, h - 1), max(tc * tile, 1), min((tc + 1) * tile, w - 1)
        sx = shelter_grid(z, dx, dy, sectors, reach, own=(slice(r0 - top, max(r1, r0) - top), slice(c0 - left, max(c1, c0) - left)), turn=float(first["turn_deg"]))
        k, r, c = np.nonzero(~np.isnan(sx))
        return pd.DataFrame({"domain": first["domain"], "tile_row": np.int32(tr), "tile_col": np.int32(tc), "row": (r + r0).astype("int32"), "col": (c + c0).astype("int32"), "sector_deg": k * 360.0 / sectors, "sx_deg": sx[k, r, c]})

    extent = cells.groupBy("domain").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    if turns is not None:
        extent = extent.join(turns.select("domain", F.col("turn_deg").alias("_turn")), "domain", "left").select("domain", "last_row", "last_col", F.coalesce("_turn", F.lit(0.0)).alias("turn_deg"))
    else:
        extent = extent.withColumn("turn_deg", F.lit(0.0))
    spread = cells.select("domain", "row", "col", "z").join(small(extent), "domain").withColumn("tile_row", tiles("row", "last_row", halo_y)).withColumn("tile_col", tiles("col", "last_col", halo_x))
    return spread.groupBy("domain", "tile_row", "tile_col").applyInPandas(run, "domain string, tile_row int, tile_col int, row int, col int, sector_deg double, sx_deg double")


def mass_consistent(u: np.ndarray, v: np.ndarray, solid: np.ndarray, dx: float, dy: float, dz: float, r: float = 1.0, omega: float = 1.7, tol: float = TOL, sweeps: int = 4000):
    """Adjusts face velocities of a box mesh until no cell gains air.

    Arrays are (layer, row, col); u has one more column, v one more row, w (returned) one more layer. Ground is closed, sides and lid are
    open (potential 0). Red-black over-relaxation of the potential; r weighs vertical against horizontal adjustment.
    Returns u, v, w, residual relative to the divergence at first, sweeps.
    """
    nz, ny, nx = solid.shape
    open_ = ~solid
    u, v, w = u.copy(), v.copy(), np.zeros((nz + 1, ny, nx))
    shut_u, shut_v, shut_w = np.zeros(u.shape, bool), np.zeros(v.shape, bool), np.zeros(w.shape, bool)
    shut_u[:, :, :-1] |= solid
    shut_u[:, :, 1:] |= solid
    shut_v[:, :-1] |= solid
    shut_v[:, 1:] |= solid
    shut_w[:-1] |= solid
    shut_w[1:] |= solid
    shut_w[0] = True
    u[shut_u], v[shut_v] = 0, 0
    gain = lambda: (u[:, :, 1:] - u[:, :, :-1]) / dx + (v[:, 1:] - v[:, :-1]) / dy + (w[1:] - w[:-1]) / dz
    first = gain() * open_
    scale = np.abs(first).max()
    if scale == 0:
        return u, v, w, 0.0, 0
    ax, ay, az = 1 / dx**2, 1 / dy**2, r / dz**2
    p = np.zeros((nz + 2, ny + 2, nx + 2))
    ae, aw = np.where(shut_u[:, :, 1:], 0, ax), np.where(shut_u[:, :, :-1], 0, ax)
    an, as_ = np.where(shut_v[:, 1:], 0, ay), np.where(shut_v[:, :-1], 0, ay)
    at, ab = np.where(shut_w[1:], 0, az), np.where(shut_w[:-1], 0, az)
    total = ae + aw + an + as_ + at + ab
    parity = np.indices(solid.shape).sum(0) % 2
    done = 0
    residual = 1.0
    for done in range(1, sweeps + 1):
        for colour in (0, 1):
            m = open_ & (parity == colour) & (total > 0)
            flow = ae * p[1:-1, 1:-1, 2:] + aw * p[1:-1, 1:-1, :-2] + an * p[1:-1, 2:, 1:-1] + as_ * p[1:-1, :-2, 1:-1] + at * p[2:, 1:-1, 1:-1] + ab * p[:-2, 1:-1, 1:-1]
            new = (flow - first) / np.where(total > 0, total, 1)
            inner = p[1:-1, 1:-1, 1:-1]
            inner[m] += omega * (new - inner)[m]
        if done % 10 == 0:
            flow = ae * p[1:-1, 1:-1, 2:] + aw * p[1:-1, 1:-1, :-2] + an * p[1:-1, 2:, 1:-1] + as_ * p[1:-1, :-2, 1:-1] + at * p[2:, 1:-1, 1:-1] + ab * p[:-2, 1:-1, 1:-1]
            residual = np.abs((flow - total * p[1:-1, 1:-1, 1:-1] - first) * open_).max() / scale
            if residual <= tol:
                break
    u -= np.where(shut_u, 0, (p[1:-1, 1:-1, 1:] - p[1:-1, 1:-1, :-1]) / dx)
    v -= np.where(shut_v, 0, (p[1:-1, 1:, 1:-1] - p[1:-1, :-1, 1:-1]) / dy)
    w -= np.where(shut_w, 0, r * (p[1:, 1:-1, 1:-1] - p[:-1, 1:-1, 1:-1]) / dz)
    return u, v, w, float(residual), done


def log_profile(z: np.ndarray, speed: float, height: float = 10.0, z0: float = 0.03) -> np.ndarray:
    return np.where(z > z0, speed * np.log(np.maximum(z, z0 * 1.0001) / z0) / math.log(height / z0), 0.0)


def at_level(x: np.ndarray, agl: np.ndarray, level: float, z0: float = 0.03) -> np.ndarray:
    """Values of layers (by height of their centres above ground, rising) at ``level`` above ground: below the first open centre by the logarithmic profile,
    above it between the two centres around (or what the one of them that is open has), above the last centre what that has."""
    inside, (rr, cc) = agl > 0, np.mgrid[0 : agl.shape[1], 0 : agl.shape[2]]
    first = inside.argmax(0)
    height = agl[first, rr, cc]
    above = np.clip((agl <= level).sum(0), 1, len(agl) - 1)
    a, b = agl[above - 1, rr, cc], agl[above, rr, cc]
    t = np.clip((level - a) / (b - a), 0, 1)
    low, high = (np.where(inside[k, rr, cc], x[k, rr, cc], np.nan) for k in (above - 1, above))
    between = np.where(np.isnan(low), high, np.where(np.isnan(high), low, low * (1 - t) + high * t))
    down = np.log(level / z0) / np.log(np.maximum(height, level) / z0)
    return np.where(height > level, x[first, rr, cc] * down, between)


def unit_fields(z: np.ndarray, dx: float, dy: float, layers: int = 8, r: float = 1.0, level: float = 10.0, z0: float = 0.03, sweeps: int = 4000) -> dict[str, np.ndarray]:
    """Wind at ``level`` above ground for a unit wind blowing east and one blowing north, over the terrain; any wind is their sum."""
    top = z.max() + max(3 * (z.max() - z.min()), 200.0)
    dz = (top - z.min()) / layers
    mid = z.min() + (np.arange(layers) + 0.5) * dz
    agl = mid[:, None, None] - z[None]
    solid = agl <= 0
    out = {}
    for name, (e, n) in {"east": (1.0, 0.0), "north": (0.0, 1.0)}.items():
        base = log_profile(agl, 1.0, level, z0)
        u = np.zeros((layers, z.shape[0], z.shape[1] + 1))
        v = np.zeros((layers, z.shape[0] + 1, z.shape[1]))
        u[:, :, :-1], u[:, :, -1] = base * e, base[:, :, -1] * e
        v[:, :-1], v[:, -1] = -base * n, -base[:, -1] * n  # rows go south
        u, v, _, residual, _ = mass_consistent(u, v, solid, dx, dy, dz, r, sweeps=sweeps)
        ue, ve = (u[:, :, 1:] + u[:, :, :-1]) / 2, -(v[:, 1:] + v[:, :-1]) / 2
        out[name] = np.stack([at_level(x, agl, level, z0) for x in (ue, ve)])
        out[f"{name}_residual"] = np.array(residual)
    return out


def basis(cells: DataFrame, dx: float, dy: float, layers: int = 8, sweeps: int = 4000) -> DataFrame:
    """(domain, unit, row, col, east, north, residual, converged): the two unit fields of each domain, on a staircase mesh.

    A field that isn't ``converged`` (residual above TOL after ``sweeps``) isn't mass-consistent; callers read it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = as_grid(pdf)
        if np.isnan(z).any():
            raise ValueError("bad-terrain: a solve needs ground everywhere")
        fields = unit_fields(z, dx, dy, layers, sweeps=sweeps)
        r, c = np.mgrid[0 : z.shape[0], 0 : z.shape[1]]
        return pd.concat([pd.DataFrame({"domain": pdf["domain"].iloc[0], "unit": k, "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "east": fields[k][0].ravel(), "north": fields[k][1].ravel(), "residual": float(fields[f"{k}_residual"]), "converged": bool(fields[f"{k}_residual"] <= TOL)}) for k in ("east", "north")])

    return cells.select("domain", "row", "col", "z").groupBy("domain").applyInPandas(run, "domain string, unit string, row int, col int, east double, north double, residual double, converged boolean")


def direct(lat: np.ndarray, lon: np.ndarray, bearing: np.ndarray, metres: np.ndarray):
    """Where a geodesic on WGS84 leads, and its bearing there: Vincenty's direct solution, vectorised."""
    b = WGS84_A * (1 - WGS84_F)
    a1 = np.radians(bearing)
    u1 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat)))
    s1 = np.arctan2(np.tan(u1), np.cos(a1))
    sa = np.cos(u1) * np.sin(a1)
    ca2 = 1 - sa**2
    up = ca2 * (WGS84_A**2 - b**2) / b**2
    k1 = (np.sqrt(1 + up) - 1) / (np.sqrt(1 + up) + 1)
    big, small = (1 + k1**2 / 4) / (1 - k1), k1 * (1 - 3 * k1**2 / 8)
    s = metres / (b * big)
    for _ in range(100):
        c2 = np.cos(2 * s1 + s)
        ds = small * np.sin(s) * (c2 + small / 4 * (np.cos(s) * (2 * c2**2 - 1) - small / 6 * c2 * (4 * np.sin(s) ** 2 - 3) * (4 * c2**2 - 3)))
        new = metres / (b * big) + ds
        if np.all(np.abs(new - s) <= 1e-14):
            s = new
            break
        s = new
    else:
        raise ValueError("no-convergence")
    c2 = np.cos(2 * s1 + s)
    lat2 = np.arctan2(np.sin(u1) * np.cos(s) + np.cos(u1) * np.sin(s) * np.cos(a1), (1 - WGS84_F) * np.hypot(sa, np.sin(u1) * np.sin(s) - np.cos(u1) * np.cos(s) * np.cos(a1)))
    lam = np.arctan2(np.sin(s) * np.sin(a1), np.cos(u1) * np.cos(s) - np.sin(u1) * np.sin(s) * np.cos(a1))
    c = WGS84_F / 16 * ca2 * (4 + WGS84_F * (4 - 3 * ca2))
    dlon = lam - (1 - c) * WGS84_F * sa * (s + c * np.sin(s) * (c2 + c * np.cos(s) * (2 * c2**2 - 1)))
    end = np.arctan2(sa, -np.sin(u1) * np.sin(s) + np.cos(u1) * np.cos(s) * np.cos(a1))
    return np.degrees(lat2), (lon + np.degrees(dlon) + 180) % 360 - 180, np.degrees(end) % 360


def stations_along(lines: DataFrame) -> DataFrame:
    """Points of lines (line_id, lat, lon, bearing, length, step): every step and the end; adds ``dist``, position and local bearing."""

    def run(batches):
        for pdf in batches:
            parts = []
            for r in pdf.itertuples():
                if not (r.step > 0 and r.length > 0):
                    raise ValueError("bad-length: a line has a positive length and step")
                d = np.arange(0, r.length, r.step)
                d = np.append(d, r.length)
                la, lo, br = direct(np.full(len(d), r.lat), np.full(len(d), r.lon), np.full(len(d), r.bearing), d)
                parts.append(pd.DataFrame({"line_id": r.line_id, "dist": d, "lat": la, "lon": lo, "bearing": br}))
            yield pd.concat(parts) if parts else pd.DataFrame({"line_id": [], "dist": [], "lat": [], "lon": [], "bearing": []})

    return lines.mapInPandas(run, "line_id bigint, dist double, lat double, lon double, bearing double")


def disc_mean_tiled(cells: DataFrame, radius: float, dx: float | G.Degrees, dy: float, coverage: float = 0.9, tile: int = 256, value: str = "z") -> DataFrame:
    """domain, row, col, ``disc_mean`` as grid.disc_mean has it, for wide discs: tiles with a halo of the radius, in each of which a disc is a sum over its rows.

    A cell is sent to the tiles whose halo holds it (nine at most while tiles are wider than discs), not to every cell of its disc. The extent of each raster (one row) is joined
    by domain. On a raster in degrees (``dx``) a disc has as many columns as the spacing of its centre's row makes it.
    """
    halo_y = int(radius // dy)
    if isinstance(dx, G.Degrees):
        # of the rows whose discs may reach a cell the columns lie closest on the first or on the last
        halo_x = F.floor(F.lit(radius) / F.least(dx.along(F.col("row") - halo_y), dx.along(F.col("row") + halo_y))) + 1
        spacing = dx.along_rows
    else:
        halo_x = F.lit(int(radius // dx))
        spacing = lambda rows: np.full(len(rows), float(dx))

    def tiles(at: str, last: str, halo):
        return F.explode(F.sequence(F.greatest(F.floor((F.col(at) - halo) / tile), F.lit(0)), F.least(F.floor((F.col(at) + halo) / tile), F.floor(F.col(last) / tile))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        tr, tc, h, w = int(first["tile_row"]), int(first["tile_col"]), int(first["last_row"]) + 1, int(first["last_col"]) + 1
        top, bottom = max(tr * tile - halo_y, 0), min((tr + 1) * tile + halo_y, h)
        wide = int(radius // spacing(np.array([tr * tile - 2 * halo_y, (tr + 1) * tile + 2 * halo_y])).min()) + 1
        left, right = max(tc * tile - wide, 0), min((tc + 1) * tile + wide, w)
        z, there = (np.full((bottom - top, right - left), np.nan) for _ in range(2))
        z[pdf["row"] - top, pdf["col"] - left] = pdf["z"].to_numpy(float)
        there[pdf["row"] - top, pdf["col"] - left] = 1
        own = slice(tr * tile - top, (tr + 1) * tile - top), slice(tc * tile - left, (tc + 1) * tile - left)
        mean, r, c = disc_mean_grid(z, radius, spacing(np.arange(top, bottom)), dy, coverage)[own], *np.nonzero(~np.isnan(there[own]))
        got = mean[r, c]
        return pd.DataFrame({"domain": first["domain"], "row": (r + tr * tile).astype("int32"), "col": (c + tc * tile).astype("int32"), "disc_mean": [None if np.isnan(v) else v for v in got]})

    extent = cells.groupBy("domain").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    spread = cells.select("domain", "row", "col", F.col(value).alias("z")).join(extent, "domain").withColumn("tile_row", tiles("row", "last_row", halo_y)).withColumn("tile_col", tiles("col", "last_col", halo_x))
    return spread.groupBy("domain", "tile_row", "tile_col").applyInPandas(run, "domain string, row int, col int, disc_mean double")


def disc_mean_grid(z: np.ndarray, radius: float, dx: float | np.ndarray, dy: float, coverage: float = 0.9) -> np.ndarray:
    """Mean over the disc around each cell by row sums; NaN where the disc leaves the grid or too little of it is there. ``dx`` may differ by row; the centre's counts."""
    ry = int(radius // dy)
    h, w = z.shape
    out = np.full(z.shape, np.nan)
    if h <= 2 * ry:
        return out
    have, val = (~np.isnan(z)).astype(float), np.nan_to_num(z)
    pad = lambda a: np.concatenate([np.zeros((a.shape[0], 1)), a.cumsum(1)], 1)
    ch, cv = pad(have), pad(val)
    apart = np.broadcast_to(np.asarray(dx, float), (h,))[ry : h - ry, None]
    cols = np.arange(w)
    s, n, size = np.zeros((h - 2 * ry, w)), np.zeros((h - 2 * ry, w)), np.zeros((h - 2 * ry, 1))
    for d in range(-ry, ry + 1):
        half = (math.sqrt(max(radius**2 - (d * dy) ** 2, 0)) // apart).astype(int)
        size += 2 * half + 1
        to, since, rows = np.clip(cols + half + 1, 0, w), np.clip(cols - half, 0, w), slice(ry + d, h - ry + d)
        s += np.take_along_axis(cv[rows], to, 1) - np.take_along_axis(cv[rows], since, 1)
        n += np.take_along_axis(ch[rows], to, 1) - np.take_along_axis(ch[rows], since, 1)
    reach = (radius // apart).astype(int)
    inside = (cols >= reach) & (cols < w - reach)
    out[ry : h - ry] = np.where(inside & (n >= coverage * size), s / np.maximum(n, 1), np.nan)
    return out
