"""Fixed tables and small rules as column expressions: roughness, stability, domains, colours, filters of stations and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo as G
from .angles import col

#: Roughness lengths in metres by class of the published classification.
ROUGHNESS = {"sea": 0.0002, "smooth": 0.005, "open": 0.03, "roughly-open": 0.10, "rough": 0.25, "very-rough": 0.5, "closed": 1.0, "chaotic": 2.0}

#: Ratio of vertical to horizontal adjustment by stability.
STABILITY = {"stable": 0.1, "neutral": 1.0}

#: Box of the national model's domain.
CONUS = {"west": -134.1, "south": 21.1, "east": -60.9, "north": 52.6}

#: Colours of speeds (from so many miles an hour on) and of ratios of model to measurement.
SPEED_STOPS = [(0, "#2c7bb6"), (4, "#00a6ca"), (8, "#00ccbc"), (13, "#90eb9d"), (19, "#f9d057"), (25, "#f29e2e"), (32, "#e76818"), (39, "#d7191c")]
RATIO_STOPS = [(0, "#00429d"), (0.6, "#4771b2"), (0.8, "#8fa9cd"), (0.9, "#e8e8e8"), (1.1, "#d99caa"), (1.3, "#c26076"), (1.6, "#a52a4c"), (2, "#93003a")]

#: Defaults of a domain in metres.
CURVATURE_M, SHELTER_M, RESOLUTION_M = 500.0, 300.0, 10.0


def _lookup(table: dict, name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name)


def roughness_length(spec) -> Column:
    """Of a class by name or a positive number in metres (as text). Null asks for nothing and gives null; anything else fails the query."""
    name = F.lit(None).cast("string") if spec is None else col(spec)
    number, found = name.try_cast("double"), _lookup(ROUGHNESS, name)
    return F.when(number > 0, number).when(found.isNotNull() | name.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("no-such-roughness: "), name)).cast("double"))


def stability_ratio(name) -> Column:
    """Neutral where nothing is asked for; an unknown name fails the query."""
    n = F.coalesce(col(name), F.lit("neutral"))
    found = _lookup(STABILITY, n)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no-such-stability: "), n)).cast("double"))


def coarsen_factor(wanted, have) -> Column:
    """Cells to average into one, with 1 % of tolerance; 1 unless two or more fit or where a size is missing."""
    f = F.floor(col(wanted) / col(have) * 1.01)
    return F.when((col(wanted) > 0) & (col(have) > 0) & (f >= 2), f).otherwise(1)


def padding(curvature=CURVATURE_M, shelter=0.0, resolution=RESOLUTION_M) -> Column:
    """Metres around a domain that its stencils reach, and a cell."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(curvature) / 2, lit(shelter)) + lit(resolution)


def layer_fractions(layers: int, stretch: float) -> list[float]:
    """Shares of the depth, each ``stretch`` times the one below."""
    if layers < 2 or not stretch > 0:
        raise ValueError("at least two layers and a positive stretch")
    parts = [stretch**k for k in range(layers)]
    return [p / sum(parts) for p in parts]


def colour(value, stops: list[tuple[float, str]]) -> Column:
    """Colour of the last stop that the value reaches, the first below all; null for null."""
    out = F.lit(stops[0][1])
    for at, name in stops[1:]:
        out = F.when(col(value) >= at, name).otherwise(out)
    return F.when(col(value).isNotNull() & ~F.isnan(col(value)), out)


def rows_for_columns(south, north, west, east, columns: int) -> Column:
    """Rows that keep a cell about as tall as it is wide: two at least."""
    tall = (col(north) - col(south)) * G.METRES_PER_DEGREE
    wide = (col(east) - col(west)) * G.metres_per_degree_lon((col(north) + col(south)) / 2)
    return F.when(wide > 0, F.greatest(F.lit(2), F.floor(columns * tall / wide + 0.5))).otherwise(columns)


def crosses_antimeridian(west, east) -> Column:
    return col(west) > col(east)


def in_conus(lat, lon) -> Column:
    return G.in_box(lat, lon, CONUS)


def box_in_conus(west, south, east, north) -> Column:
    return (col(west) >= CONUS["west"]) & (col(east) <= CONUS["east"]) & (col(south) >= CONUS["south"]) & (col(north) <= CONUS["north"])


def in_states(state, wanted: str) -> Column:
    """By a comma list, whatever the case; the station's own state is taken as it stands; a missing state isn't in any; an empty list takes all."""
    names = [w.strip().upper() for w in wanted.split(",") if w.strip()]
    return F.coalesce(F.upper(col(state)).isin(names), F.lit(False)) if names else F.lit(True)


def station_search(query: str | dict | None, texts: list[str], exact: tuple = ()) -> Column:
    """A text query: a substring of any of ``texts``, whatever the case. A query of fields: all of them; ``state`` may be a comma list, ``exact`` fields
    are compared as they stand, others whatever the case. None, an empty text or fields without value ask for nothing."""
    out = F.lit(True)
    if isinstance(query, dict):
        for name, value in query.items():
            if value:
                asked = [w.strip().upper() for w in str(value).split(",")] if name == "state" else [str(value)] if name in exact else [str(value).lower()]
                own = col(name) if name == "state" or name in exact else F.lower(F.coalesce(col(name), F.lit("")))
                out = out & F.coalesce(own.isin(asked), F.lit(False))
    elif query and query.strip():
        out = F.lit(False)
        for t in texts:
            out = out | F.coalesce(F.contains(F.lower(col(t)), F.lit(query.strip().lower())), F.lit(False))
    return out


def near_the_hour(time, minutes: int = 3) -> Column:
    m = F.minute(col(time))
    return (m >= 60 - minutes) | (m <= minutes)


def within_window(time, begin, end, average_s: float) -> Column:
    """Records that an average of ``average_s`` around any time of the window can use."""
    pad = F.make_dt_interval(secs=F.lit(average_s))
    return col(time).between(col(begin) - pad, col(end) + pad)


def quantisation_floor(step: float) -> float:
    """RMS of rounding to ``step`` alone."""
    return step / math.sqrt(12)


def stale_grid_reason(wanted_m, read_m, coarsened, drift_deg) -> Column:
    """Why a stored grid would be made otherwise now: ``no-resolution``, ``other-coarsening``, ``other-box``; null if it would not."""
    return F.when(col(read_m).isNull() | col(coarsened).isNull(), "no-resolution").when(coarsen_factor(wanted_m, read_m) != col(coarsened), "other-coarsening").when(col(drift_deg) > 1e-4, "other-box")
