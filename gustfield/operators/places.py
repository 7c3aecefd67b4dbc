"""Points and boxes at scale: which stations lie in which boxes, which boxes meet, how many, nearest first; never by comparing all with all.

The globe is cut into square cells at LEVELS sizes, each twice the one before. A box is covered by the cells of the level whose size is its
longer side or more, so four at most (smaller ones where points are met); a point has one cell in every level that some box may have. Cells are join keys, an exact test
follows. Longitudes don't wrap: a box over the antimeridian comes as two.

Pairs grow with the product of both sides, so what only needs their number is counted without them (``counted``), and nearest ones are looked for
around the centre first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G

#: Side of the smallest cell in degrees, and the number of levels: the largest holds any box of the globe.
SMALLEST, LEVELS = 0.01, 17

#: Points are met in cells of a quarter of the box's longer side or more: less of what a cover holds lies outside the box.
FINER = 2

CELL = ["_level", "_i", "_j"]
SIDES = ["west", "south", "east", "north"]

#: Boxes and tiles that a strip should hold, and the most strips either way.
STRIP, MOST_STRIPS = 50_000, 1024


def _cell(v, level) -> Column:
    return F.floor(v / (F.lit(SMALLEST) * F.pow(F.lit(2.0), level))).cast("bigint")


def _level(finer: int = 0) -> Column:
    side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(SMALLEST))
    return F.greatest(F.least(F.ceil(F.log2(side / SMALLEST)).cast("int"), F.lit(LEVELS - 1)) - finer, F.lit(0))


def covered(boxes: DataFrame, finer: int = 0) -> DataFrame:
    """A row for each cell of each box's cover, of cells ``finer`` levels smaller than the box. Boxes need west, south, east, north; empty and null ones have none."""
    c = F.col
    good = boxes.where((c("west") <= c("east")) & (c("south") <= c("north"))).withColumn("_level", _level(finer))
    rows = good.withColumn("_i", F.explode(F.sequence(_cell(c("south"), c("_level")), _cell(c("north"), c("_level")))))
    return rows.withColumn("_j", F.explode(F.sequence(_cell(c("west"), c("_level")), _cell(c("east"), c("_level")))))


def placed(points: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each of a point's cells in the levels that are in use."""
    rows = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    return rows.withColumns({"_i": _cell(F.col("lat"), F.col("_level")), "_j": _cell(F.col("lon"), F.col("_level"))})


def inside(points: DataFrame, boxes: DataFrame, keep: list[str]) -> DataFrame:
    """Points (lat, lon) with the columns ``keep`` of every box that holds them, edges included. One row for each pair: a point is met in one cell of a box."""
    cover = covered(boxes.select(*SIDES, *keep), FINER)
    levels = sorted(r[0] for r in boxes.select(_level(FINER).alias("l")).where("l is not null").distinct().collect())  # LEVELS of them at most
    met = placed(points, levels).join(cover, CELL)
    return met.where(G.in_box("lat", "lon", {k: F.col(k) for k in SIDES})).drop(*CELL, *SIDES)


def _strips(boxes: DataFrame, tiles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes that cut the boxes' and tiles' edges into strips of about as many. Where they lie changes the work, not the result."""
    edges = [df.select(F.col(x).alias("x"), F.col(y).alias("y")) for df in (boxes, tiles) for x, y in (SIDES[:2], SIDES[2:])]
    ranks = [k / MOST_STRIPS for k in range(1, MOST_STRIPS)]
    every = edges[0].union(edges[1]).union(edges[2]).union(edges[3])
    n, *cuts = every.agg(F.count("*"), *(F.percentile_approx(v, ranks, 10_000) for v in "xy")).first()
    step = -(-MOST_STRIPS // max(1, min(MOST_STRIPS, n // (2 * STRIP))))
    return tuple(np.unique(np.array(c or [], dtype=float)[step - 1 :: step]) for c in cuts)


def _strip(cuts: np.ndarray):
    @F.pandas_udf("int")
    def strip(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy(), "right").astype("int32"))

    return strip


def _sums_below(rank: np.ndarray, weights: list[np.ndarray], first: np.ndarray, below: np.ndarray) -> list[np.ndarray]:
    """For each query the weights of those among the ``first`` rows whose rank (a permutation) is under ``below``: a pass for each bit of the ranks, rows dealt by it."""
    low, high, out = np.zeros_like(first), first, [np.zeros(len(first), dtype=np.int64) for _ in weights]
    for bit in reversed(range(len(rank).bit_length())):
        zero, wanted = (rank >> bit) & 1 == 0, (below >> bit) & 1 == 1
        before = np.concatenate([[0], np.cumsum(zero)])
        for k, w in enumerate(weights):
            upto = np.concatenate([[0], np.cumsum(np.where(zero, w, 0))])
            out[k] += np.where(wanted, upto[high] - upto[low], 0)
        low, high = (np.where(wanted, before[-1] + v - before[v], before[v]) for v in (low, high))
        dealt = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        rank, weights = rank[dealt], [w[dealt] for w in weights]
    return out


def counted(boxes: DataFrame, tiles: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """How many tiles share a point with each box (``matched``), and the sum of their whole numbers ``value`` (``total``). Edges belong to both; a point is a tile
    without extent. A row for each key; empty and null boxes and tiles meet nothing.

    No pair becomes a row. A tile meets a box in one direction if it begins at the box's end or before and doesn't end before its begin; the first holds wherever the
    second fails, so tiles that meet are a signed sum over four corners: tiles whose corner lies below the box's one in both directions. Both directions are cut into
    strips. Tiles in the corner's own row of strips are compared by latitude and longitude there; those in rows before it are counted in the corner's own column by
    longitude and row, where all columns before have been summed up by rows.
    """
    c = F.col
    good = (c("west") <= c("east")) & (c("south") <= c("north"))
    b = boxes.where(good).select(key, *SIDES)
    t = tiles.where(good).select(*SIDES, F.lit(1).cast("bigint").alias("n"), (F.coalesce(c(value), F.lit(0)) if value else F.lit(0)).cast("bigint").alias("v"))
    cut_x, cut_y = _strips(b, t)
    strip = {"west": _strip(cut_x), "east": _strip(cut_x), "south": _strip(cut_y), "north": _strip(cut_y)}
    b, t = (df.withColumns({f"_{s}": f(s) for s, f in strip.items()}) for df in (b, t))
    at = lambda axis, high, place: [F.lit(axis).alias("axis"), F.lit(high).alias("high"), place.alias("strip")]
    never = F.lit(float("inf"))

    def sides(axis: int, high: bool):
        """Side of the box, and the tile's that is held against it."""
        return (("north", "south") if high else ("south", "north")) if axis == 0 else (("east", "west") if high else ("west", "east"))

    corners, rows = [], []
    for axis, high in ((0, True), (0, False), (1, True), (1, False)):
        of_box, of_tile = sides(axis, high)
        ends, begins = ("east", "west") if axis == 0 else ("_north", "_south")
        # in strips, those before the box's end: that strip itself is left to the rows
        corners.append(b.select(*at(axis, high, c(f"_{of_box}")), key, c(of_box).alias("p"), (c(ends).cast("double") - axis).alias("q1"), c(begins).cast("double").alias("q2")))
        rows.append(t.select(*at(axis, high, c(f"_{of_tile}")), c(of_tile).alias("p"), c(begins).cast("double").alias("q1"), c(ends).cast("double").alias("q2"), "n", "v"))
        if axis == 1:
            wide, tall = len(cut_x) + 1, len(cut_y) + 1
            for first, row in ((True, "_south"), (False, "_north")):
                sums = t.groupBy(c(f"_{of_tile}").alias("strip"), c(row).alias("row")).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
                grid = t.sparkSession.range(wide * tall).select((c("id") % wide).cast("int").alias("strip"), F.floor(c("id") / wide).cast("int").alias("row"))
                before = Window.partitionBy("row").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
                carried = grid.join(sums, ["strip", "row"], "left").withColumns({x: F.sum(x).over(before) for x in "nv"}).where("n > 0")
                place = c("row").cast("double")
                rows.append(carried.select(*at(axis, high, c("strip")), (-never).alias("p"), (place if first else never).alias("q1"), (never if first else place).alias("q2"), "n", "v"))

    def compare(pts: pa.Table, asked: pa.Table) -> pa.Table:
        """In one strip: rows whose p and q1 lie at the corner or before, less those whose p does and whose q2 lies before."""
        out = [np.zeros(len(asked), dtype=np.int64) for _ in "nv"]
        if len(pts) and len(asked):
            high = asked["high"][0].as_py()
            get = lambda df, x: df[x].to_numpy()
            order = np.argsort(get(pts, "p"), kind="stable")
            first = np.searchsorted(get(pts, "p")[order], get(asked, "p"), "right" if high else "left")
            weights = [get(pts, w)[order] for w in "nv"]
            for q, side, sign in (("q1", "right", 1), ("q2", "left", -1)):
                place = get(pts, q)[order]
                by = np.argsort(place, kind="stable")
                rank = np.empty_like(by)
                rank[by] = np.arange(len(by))
                for o, s in zip(out, _sums_below(rank, weights, first, np.searchsorted(place[by], get(asked, q), side))):
                    o += s * (sign if high else -sign)
        return pa.table({key: asked[key], "matched": out[0], "total": out[1]})

    def together(parts: list[DataFrame]):
        all_of = parts[0]
        for x in parts[1:]:
            all_of = all_of.unionByName(x)
        return all_of.groupBy("axis", "high", "strip")

    kind = boxes.schema[key].dataType.simpleString()
    parts = together(rows).cogroup(together(corners)).applyInArrow(compare, f"`{key}` {kind}, matched bigint, total bigint")
    none = boxes.select(key, F.lit(0).cast("bigint").alias("matched"), F.lit(0).cast("bigint").alias("total"))
    return parts.unionByName(none).groupBy(key).agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"))


def _kept(df: DataFrame) -> DataFrame:
    """Worked out once and kept in the folder that all executors share (spark.checkpoint.dir). Without one, executors keep their own parts, and a later read fails if one of them is lost."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def nearest(stations: DataFrame, requests: DataFrame, key: str, station: str, limit: int) -> DataFrame:
    """The first ``limit`` stations of each request's box by distance from its centre (ties by id), with ``distance``, ``rank`` and ``matched`` (how many the box holds).

    Requests have west, south, east, north. One without stations gives a row without station and matched = 0. Stations are looked for in a part of
    the box around its centre that should hold some ``3 * limit`` of them. While something outside the part may be nearer than the last one found, the part grows to that one's
    distance, or to twice its width if it holds too few, up to the whole box. What is ranked is cut to ``limit`` in each task before it is shuffled.
    """
    c = F.col
    spots = stations.select(station, "lat", "lon")
    held = _kept(counted(requests, spots.select(c("lon").alias("west"), c("lat").alias("south"), c("lon").alias("east"), c("lat").alias("north")), key).select(key, "matched"))
    south, north, west, east = (F.lit(x).cast("double") for x in spots.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first())
    cos = F.greatest(F.cos(F.radians("_lat")), F.lit(1e-6))
    # of the box only what lies in the stations' extent holds any; the centre may be off it
    wide, tall = F.greatest((F.least("east", east) - F.greatest("west", west)) * cos, F.lit(1e-9)), F.greatest(F.least("north", north) - F.greatest("south", south), F.lit(1e-9))
    off = F.greatest(south - c("_lat"), c("_lat") - north, (west - c("_lon")) * cos, (c("_lon") - east) * cos, F.lit(0.0))
    area = wide * tall * (3 * limit) / c("matched")
    half = off + F.greatest(F.sqrt(area), area / F.least(wide, tall)) / 2
    plain = (c("east") - c("west") <= 360) & (c("south") >= -90) & (c("north") <= 90)  # elsewhere distances don't grow with degrees
    left = requests.select(key, *SIDES).join(held.where("matched > 0"), key).withColumns({"_lat": (c("south") + c("north")) / 2, "_lon": (c("west") + c("east")) / 2})
    left = _kept(left.withColumn("_half", F.when(plain, half).otherwise(float("inf"))))
    found = []
    while True:
        part = left.withColumns({"_s": F.greatest("south", c("_lat") - c("_half")), "_n": F.least("north", c("_lat") + c("_half")), "_w": F.greatest("west", c("_lon") - c("_half") / cos), "_e": F.least("east", c("_lon") + c("_half") / cos)})
        # no station of the box outside the part is nearer; null if the part is the box
        along = F.asin(cos * F.sin(F.least(F.radians(c("_half") / cos), F.lit(np.pi / 2))))
        reach = F.least(F.when((c("_s") > c("south")) | (c("_n") < c("north")), F.radians("_half")), F.when((c("_w") > c("west")) | (c("_e") < c("east")), along))
        part = part.select(key, "_lat", "_lon", (reach * (G.EARTH_M * (1 - 1e-9))).alias("_reach"), c("_w").alias("west"), c("_s").alias("south"), c("_e").alias("east"), c("_n").alias("north"))
        met = inside(spots, part, [key, "_lat", "_lon", "_reach"]).withColumn("distance", G.haversine("_lat", "_lon", "lat", "lon"))
        first = met.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", station))).where(c("rank") <= limit)
        first = first.withColumn("_last", F.max(F.when(c("rank") == limit, c("distance"))).over(Window.partitionBy(key)))
        first = _kept(first.select(key, station, "distance", "rank", "_last", (c("_reach").isNull() | F.coalesce(c("_last") <= c("_reach"), F.lit(False))).alias("_done")))
        found.append(first.where("_done").select(key, station, "distance", "rank"))
        to_last = F.when(c("_last").isNotNull(), F.greatest(F.degrees(c("_last") / G.EARTH_M) * 1.01, c("_half") * 1.1))
        left = left.join(first.where("rank = 1").select(key, "_last", "_done"), key, "left").where("not coalesce(_done, false)")
        left = _kept(left.withColumn("_half", F.coalesce(to_last, c("_half") * 2)).drop("_last", "_done"))
        if left.isEmpty():
            break
    ranked = found[0]
    for x in found[1:]:
        ranked = ranked.unionByName(x)
    return requests.select(key).join(held, key, "left").join(ranked, key, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def meeting(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Pairs of keys of boxes that share a point, edges included. Both sides meet in the cells of the larger box's level; each pair once."""
    left, right = (covered(x.select(k, *SIDES)).withColumnsRenamed({s: f"{s}_{n}" for s in SIDES}) for x, k, n in ((a, key_a, "a"), (b, key_b, "b")))

    def lifted(df: DataFrame) -> DataFrame:
        """With the cells that hold a cover's cells in all larger levels."""
        up = df.withColumnsRenamed({"_level": "_l", "_i": "_a", "_j": "_b"}).withColumn("_level", F.explode(F.sequence("_l", F.lit(LEVELS - 1))))
        step = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("_level") - F.col("_l"))).cast("bigint")
        return up.withColumns({"_i": step("_a"), "_j": step("_b")}).drop("_a", "_b", "_l").distinct()

    sharing = (F.col("west_a") <= F.col("east_b")) & (F.col("west_b") <= F.col("east_a")) & (F.col("south_a") <= F.col("north_b")) & (F.col("south_b") <= F.col("north_a"))
    pairs = left.join(lifted(right), CELL).where(sharing).select(key_a, key_b).unionByName(lifted(left).join(right, CELL).where(sharing).select(key_a, key_b))
    return pairs.distinct()
