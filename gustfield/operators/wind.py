"""A coarse wind spread over terrain: weights of slope, curvature and shelter, and the wind they make. Cell tables as in grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import bearing_from, circular_mean, east, north
from ..functions.sizes import small


def weights(cells: DataFrame, scales: dict[str, float] | None = None) -> DataFrame:
    """Adds ``w_slope`` and ``w_curv`` (and ``w_shelter`` with a column ``sx_deg``): values over twice the domain's largest, or over twice a fixed scale.

    The largest values are one row a domain, broadcast to the cells.
    """
    scales = scales or {}
    src = {"w_slope": F.radians("slope_deg"), "w_curv": F.col("total_curv")} | ({"w_shelter": F.col("sx_deg")} if "sx_deg" in cells.columns else {})
    if any(v <= 0 for v in scales.values()):
        raise ValueError("bad-scale: a scale is positive")
    top = cells.groupBy("domain").agg(*[F.max(F.abs(x)).alias(f"_m_{k}") for k, x in src.items()])
    j = cells.join(small(top), "domain")
    for k, x in src.items():
        m = F.lit(float(scales[k])) if k in scales else F.col(f"_m_{k}")
        j = j.withColumn(k, F.when(x.isNull(), F.lit(None).cast("double")).when(m == 0, 0.0).otherwise(x / (2 * m)))
    return j.drop(*[f"_m_{k}" for k in src])


def spread(cells: DataFrame, speed: Column, from_deg: Column, slope_gain: float = 0.5, convex_gain: float = 0.5, concave_gain: float = 0.5, shelter_gain: float = 0.5) -> DataFrame:
    """The wind over each cell: ``factor``, ``speed``, ``turn_deg``, ``from_deg``, ``east``, ``north``; null where a weight is.

    Slopes that face the wind speed it up and turn it, convex ground speeds it up, sheltered ground slows it down.
    """
    c = F.col
    flat = c("aspect_deg").isNull()
    # the aspect is downhill; wind from that side climbs the slope
    facing = F.when(flat, 0.0).otherwise(c("w_slope") * F.cos(F.radians(from_deg - c("aspect_deg"))))
    turn = F.when(flat, 0.0).otherwise(-0.5 * facing * F.degrees(F.sin(F.radians(2 * (c("aspect_deg") - from_deg)))))
    curv = F.when(c("w_curv") > 0, convex_gain * c("w_curv")).otherwise(concave_gain * c("w_curv"))
    shelter = 1 - shelter_gain * c("w_shelter") if "w_shelter" in cells.columns else F.lit(1.0)
    ok = c("w_slope").isNotNull() & c("w_curv").isNotNull() & speed.isNotNull() & from_deg.isNotNull()
    ok = ok & c("w_shelter").isNotNull() if "w_shelter" in cells.columns else ok
    out = cells.withColumn("factor", F.when(ok, F.greatest((1 + slope_gain * facing + curv) * shelter, F.lit(0.0)))).withColumn("turn_deg", F.when(ok, turn))
    out = out.withColumn("speed", c("factor") * speed).withColumn("from_deg", F.pmod(from_deg + c("turn_deg"), F.lit(360.0)))
    return out.withColumn("east", east("speed", "from_deg")).withColumn("north", north("speed", "from_deg"))


def summary(field: DataFrame) -> DataFrame:
    """Per domain: defined cells, mean, least and largest factor."""
    return field.groupBy("domain").agg(F.count("factor").alias("defined"), F.avg("factor").alias("mean_factor"), F.min("factor").alias("least_factor"), F.max("factor").alias("most_factor"), circular_mean("turn_deg").alias("mean_turn"))


def superpose(basis: DataFrame, winds: DataFrame) -> DataFrame:
    """The field of any wind from the fields of two unit winds (rows of ``basis`` with unit east or north): e * E + n * N for every row of ``winds`` (wind_id, e, n).

    The basis is read once: both units of a cell meet in one sum. ``winds`` is a request: broadcast, checked to be small by the caller's own bound. A field is
    ``converged`` if both unit fields are; a cell that lacks a unit has no field.
    """
    k = ["domain", "row", "col"]
    of = lambda unit, c: F.max(F.when(F.col("unit") == unit, F.col(c)))
    names = {"ee": ("east", "east"), "en": ("east", "north"), "ec": ("east", "converged"), "ne": ("north", "east"), "nn": ("north", "north"), "nc": ("north", "converged")}
    both = basis.groupBy(*k).agg(*[of(*v).alias(n) for n, v in names.items()]).where("ee is not null and ne is not null")
    j = both.crossJoin(F.broadcast(winds.select("wind_id", "e", "n")))
    e, n = F.col("e") * F.col("ee") + F.col("n") * F.col("ne"), F.col("e") * F.col("en") + F.col("n") * F.col("nn")
    return j.select("wind_id", *k, e.alias("east"), n.alias("north"), F.hypot(e, n).alias("speed"), bearing_from(e, n, 0.0).alias("from_deg"), (F.col("ec") & F.col("nc")).alias("converged"))


def volume(messages: DataFrame) -> DataFrame:
    """Wind components of a volume: (volume, level, valid_time, i, j, u, v) from messages (volume, param, level, valid_time, i, j, value, seq).

    Of equal messages the last in ``seq`` holds; a cell that lacks a component has none. ``code`` tells what is wrong with a
    volume: mixed-time (several instants), half-a-wind (a level with one component only).
    """
    c = F.col
    last = messages.groupBy("volume", "level", "valid_time", "i", "j", "param").agg(F.max_by("value", "seq").alias("value"))
    wide = last.groupBy("volume", "level", "valid_time", "i", "j").agg(*[F.max(F.when(c("param") == p, c("value"))).alias(a) for p, a in (("UGRD", "u"), ("VGRD", "v"))])
    both = c("u").isNotNull() & c("v").isNotNull()
    wide = wide.withColumn("_b", both).select("volume", "level", "valid_time", "i", "j", F.when(both, c("u")).alias("u"), F.when(both, c("v")).alias("v"))
    has = messages.groupBy("volume", "level").agg(F.bool_or(c("param") == "UGRD").alias("hu"), F.bool_or(c("param") == "VGRD").alias("hv"))
    half = has.groupBy("volume").agg(F.bool_or(c("hu") != c("hv")).alias("half"))
    times = messages.groupBy("volume").agg((F.min("valid_time") != F.max("valid_time")).alias("mixed"))
    code = half.join(times, "volume").select("volume", F.when(c("mixed"), "mixed-time").when(c("half"), "half-a-wind").alias("code"))
    return wide.join(small(code), "volume")


def transect_components(df: DataFrame, e: str, n: str, bearing: str) -> DataFrame:
    """Along and across a line: ``along`` with it, ``cross`` to its right."""
    b = F.radians(bearing)
    return df.withColumn("along", F.col(e) * F.sin(b) + F.col(n) * F.cos(b)).withColumn("cross", F.col(e) * F.cos(b) - F.col(n) * F.sin(b))
