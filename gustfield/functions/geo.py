"""Boxes, distances, projections and height factors as column expressions."""

from __future__ import annotations

import math

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import col

#: Metres in a degree of latitude, mean radius of the earth for station and crosswalk distances, statute mile.
METRES_PER_DEGREE, EARTH_M, EARTH_KM, MILE_M = 111132.92, 6371008.8, 6371.0, 1609.344

#: Speeds in metres a second.
UNITS = {"m/s": 1.0, "km/h": 1 / 3.6, "kt": 1852 / 3600, "mph": 0.44704, "ft/s": 0.3048}


def in_box(lat, lon, box: dict) -> Column:
    """Edges belong to the box."""
    return col(lat).between(box["south"], box["north"]) & col(lon).between(box["west"], box["east"])


def boxes_meet(a: str, b: str) -> Column:
    """Two struct columns (west, south, east, north) share a point."""
    return (F.col(f"{a}.west") <= F.col(f"{b}.east")) & (F.col(f"{b}.west") <= F.col(f"{a}.east")) & (F.col(f"{a}.south") <= F.col(f"{b}.north")) & (F.col(f"{b}.south") <= F.col(f"{a}.north"))


def metres_per_degree_lon(lat) -> Column:
    return F.greatest(F.lit(METRES_PER_DEGREE) * F.cos(F.radians(col(lat))), F.lit(1.0))


@dataclass(frozen=True)
class Degrees:
    """A raster in degrees: rows and columns ``step`` apart, its first row at ``first_lat``, further rows to the south. Columns lie closer the farther from the equator."""

    first_lat: float
    step: float

    @property
    def down(self) -> float:
        """Metres between rows."""
        return self.step * METRES_PER_DEGREE

    def along(self, row) -> Column:
        """Metres between columns on a row."""
        return F.lit(self.step) * metres_per_degree_lon(F.lit(self.first_lat) - col(row) * self.step)

    def along_rows(self, rows: np.ndarray) -> np.ndarray:
        """The same of many rows in numpy."""
        return self.step * np.maximum(METRES_PER_DEGREE * np.cos(np.radians(self.first_lat - rows * self.step)), 1.0)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    p, q = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def displaced(lat, lon, bearing, metres, radius: float = EARTH_M) -> tuple[Column, Column]:
    """Latitude and longitude after going ``metres`` on a sphere."""
    p, b, d = F.radians(col(lat)), F.radians(col(bearing)), col(metres) / radius
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    return F.degrees(q), col(lon) + F.degrees(F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q)))


def box_around(lat: float, lon: float, radius_m: float) -> dict:
    dy, dx = radius_m / METRES_PER_DEGREE, radius_m / max(METRES_PER_DEGREE * math.cos(math.radians(lat)), 1.0)
    return {"west": lon - dx, "south": lat - dy, "east": lon + dx, "north": lat + dy}


def snap_out(box: dict, step: float) -> dict:
    """Grown to multiples of ``step``, so that near requests share a key."""
    down, up = (lambda x: round(math.floor(x / step + 1e-9) * step, 6)), (lambda x: round(math.ceil(x / step - 1e-9) * step, 6))
    return {"west": down(box["west"]), "south": down(box["south"]), "east": up(box["east"]), "north": up(box["north"])}


def to_metres_a_second(value, unit) -> Column:
    """Null where the unit isn't known."""
    return col(value) * F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), col(unit))


def log_factor(z_to, z_from, z0) -> Column:
    """Logarithmic profile between two heights above ground; null unless both exceed the roughness."""
    a, b, r = col(z_to), col(z_from), col(z0)
    return F.when((r > 0) & (a > r) & (b > r), F.log(a / r) / F.log(b / r))


def exposure_factor(z_to, z_from, z0_to, z0_from, blend: float = 60.0) -> Column:
    """Up the one profile to the blending height and down the other; without the second roughness one profile does."""
    up, down = log_factor(F.lit(blend), z_from, z0_from), log_factor(z_to, F.lit(blend), z0_to)
    ok = (F.lit(blend) > col(z_to)) & (F.lit(blend) > col(z_from))
    return F.when(col(z0_from).isNull(), log_factor(z_to, z_from, z0_to)).when(ok, up * down)


def landform(position_m, slope_deg, step: float = 15.0, flat: float = 5.0) -> Column:
    """Ridge and valley by height over the surroundings, the rest by slope."""
    p = col(position_m)
    return F.when(p.isNull() | col(slope_deg).isNull(), "unknown").when(p >= step, "ridge").when(p <= -step, "valley").when(col(slope_deg) <= flat, "flat").otherwise("slope")


def elevation_check(published, terrain, tolerance: float = 50.0) -> Column:
    """Null if the two agree, else the code."""
    return F.when(col(published).isNull() | col(terrain).isNull(), "no-elevation").when(F.abs(col(published) - col(terrain)) > tolerance, "elevation-disagrees")


class Conic:
    """A Lambert conformal grid on a sphere with one or two standard parallels: index space to and from degrees."""

    def __init__(self, lat1: float, lon1: float, dx: float, dy: float, lon0: float, p1: float, p2: float, radius: float = 6371229.0):
        a, b = math.radians(p1), math.radians(p2)
        t = lambda x: math.tan(math.pi / 4 + x / 2)
        self.cone = math.sin(a) if abs(a - b) < 1e-9 else math.log(math.cos(a) / math.cos(b)) / math.log(t(b) / t(a))
        self.f = math.cos(a) * t(a) ** self.cone / self.cone
        self.radius, self.lon0, self.dx, self.dy = radius, lon0, dx, dy
        rho = radius * self.f / t(math.radians(lat1)) ** self.cone
        th = self.cone * math.radians((lon1 - lon0 + 180) % 360 - 180)
        self.x0, self.y0 = rho * math.sin(th), -rho * math.cos(th)

    def index(self, lat, lon) -> tuple[Column, Column]:
        """Fractional column and row."""
        rho = F.lit(self.radius * self.f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2), F.lit(self.cone))
        th = F.radians(F.pmod(col(lon) - self.lon0 + 180, F.lit(360.0)) - 180) * self.cone
        return (rho * F.sin(th) - self.x0) / self.dx, (-rho * F.cos(th) - self.y0) / self.dy

    def degrees(self, i, j) -> tuple[Column, Column]:
        """Latitude and longitude."""
        x, y = col(i) * self.dx + self.x0, -(col(j) * self.dy + self.y0)
        rho = F.hypot(x, y)
        lat = F.degrees(F.lit(2.0) * F.atan(F.pow(F.lit(self.radius * self.f) / rho, F.lit(1 / self.cone)))) - 90
        return lat, F.pmod(F.degrees(F.atan2(x, y)) / self.cone + self.lon0 + 180, F.lit(360.0)) - 180


class Geographic:
    """Degrees as they are: x is the longitude, y the latitude."""

    def forward(self, lat, lon) -> tuple[Column, Column]:
        return col(lon), col(lat)

    def inverse(self, x, y) -> tuple[Column, Column]:
        """Latitude and longitude."""
        return col(y), col(x)

    def metres(self, step_x: float, step_y: float, lat: float) -> tuple[float, float]:
        """Size of a pixel on the ground."""
        return abs(step_x) * max(METRES_PER_DEGREE * math.cos(math.radians(lat)), 1.0), abs(step_y) * METRES_PER_DEGREE


class Utm:
    """A zone of the transverse Mercator grid (on WGS84 unless told otherwise), by the Krueger series to the fourth order: both ways within 1e-10 degrees."""

    SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0

    def __init__(self, zone: int, northern: bool = True, inverse_flattening: float = 298.257223563):
        if not 1 <= zone <= 60:
            raise ValueError(f"bad-crs: no zone {zone}")
        self.meridian, self.false_north = zone * 6.0 - 183, 0.0 if northern else self.SOUTH
        f = 1 / inverse_flattening
        n = f / (2 - f)
        self.k = 2 * math.sqrt(n) / (1 + n)
        self.radius = self.SCALE * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # coefficients of the series: forward, inverse, and from conformal to geodetic latitude
        self.alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        self.beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        self.delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]

    def forward(self, lat, lon) -> tuple[Column, Column]:
        """Easting and northing. Longitudes wrap."""
        s = F.sin(F.radians(col(lat)))
        t = F.sinh(F.atanh(s) - F.atanh(s * self.k) * self.k)
        d = F.radians(F.pmod(col(lon) - self.meridian + 180, F.lit(360.0)) - 180)
        xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
        x, y = eta, xi
        for j, c in enumerate(self.alpha, 1):
            x, y = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * c, y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * c
        return x * self.radius + self.EAST, y * self.radius + self.false_north

    def inverse(self, x, y) -> tuple[Column, Column]:
        """Latitude and longitude."""
        xi, eta = (col(y) - self.false_north) / self.radius, (col(x) - self.EAST) / self.radius
        a, b = xi, eta
        for j, c in enumerate(self.beta, 1):
            a, b = a - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * c, b - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * c
        chi = F.asin(F.sin(a) / F.cosh(b))
        lat = chi
        for j, c in enumerate(self.delta, 1):
            lat = lat + F.sin(chi * (2 * j)) * c
        lon = F.degrees(F.atan2(F.sinh(b), F.cos(a))) + self.meridian
        return F.degrees(lat), F.pmod(lon + 180, F.lit(360.0)) - 180

    def metres(self, step_x: float, step_y: float, lat: float) -> tuple[float, float]:
        return abs(step_x), abs(step_y)


#: Codes of reference systems. Geographic ones on NAD83 and WGS84; bases of zones (north, last zone, inverse flattening) on NAD83, WGS84 north and south.
GEOGRAPHIC_CODES = (4269, 4326)
ZONE_CODES = {26900: (True, 23, 298.257222101), 32600: (True, 60, 298.257223563), 32700: (False, 60, 298.257223563)}


def reference_system(code: int) -> Geographic | Utm:
    """By its code; positions on NAD83 and WGS84 are taken as they are. ``bad-crs`` for others."""
    if code in GEOGRAPHIC_CODES:
        return Geographic()
    base, zone = code // 100 * 100, code % 100
    if base in ZONE_CODES and 1 <= zone <= ZONE_CODES[base][1]:
        return Utm(zone, ZONE_CODES[base][0], ZONE_CODES[base][2])
    raise ValueError(f"bad-crs: {code} is neither geographic nor a zone that is known")


def utm_forward(lat, lon, zone: int, northern: bool = True) -> tuple[Column, Column]:
    """Easting and northing on WGS84."""
    return Utm(zone, northern).forward(lat, lon)
