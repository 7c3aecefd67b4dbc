"""Networks as one table, stored runs, boxes by cells, tiled discs, metrics left one out of, cycles and directories on streams."""

import datetime as dt
import gzip
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfield.functions import geo as G
from gustfield.functions import tables as T
from gustfield.operators import grid, kernels, places, scoring
from gustfield.plans import stations
from gustfield.sources import networks, stores
from gustfield.streaming import streams

from .test_oracles import SF
from .test_streaming import at


# ---- networks

def document(station, time, speed):
    q = lambda v: {"unitCode": "wmoUnit:km_h-1", "value": v, "qualityControl": "V"}
    return json.dumps({"features": [{"properties": {"stationId": f"https://x/{station}", "timestamp": time, "windSpeed": q(speed), "windGust": q(None), "windDirection": {"unitCode": "d", "value": 90.0, "qualityControl": "V"}}}]})


def minute(local, clock, direction, speed):
    return f"04931KXYZ{'0007'}{local}{clock}".ljust(70) + f"{direction:>4}{speed:>5}" + " " * 15


@pytest.fixture
def root(tmp_path):
    def put(network, station, year, name, text):
        d = tmp_path / f"network={network}/station={station}/year={year}"
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_bytes(text if isinstance(text, bytes) else text.encode())

    put("weather", "KA", 2023, "a.json", document("ka", "2023-12-31T23:30:00Z", 36.0))
    put("weather", "KA", 2024, "a.json", document("ka", "2024-01-01T00:30:00Z", 18.0))
    put("weather", "KB", 2024, "b.json", document("kb", "2024-01-01T00:40:00Z", None))
    put("airport", "KC", 2024, "c.txt", minute("202401010010", "0710", 270, 10) + "\n" + minute("202406010010", "0710", 270, 10) + "\n")
    broken = gzip.compress(b"x" * 1000)[:20]
    for where in (("weather", "KA", 2021), ("weather", "KZ", 2024), ("mesonet", "KA", 2024)):
        put(*where, "broken.gz", broken)  # fails whoever opens it
    return str(tmp_path)


def test_only_wanted_files_are_opened(spark, root):
    begin, end = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 12)
    got = networks.observations(spark, root, ["weather", "airport"], begin, end, ["KA", "KB", "KC"])
    rows = sorted(tuple(r) for r in got.select("network", "station_id", "speed_mps", "code").collect())
    assert rows == [("airport", "0007", pytest.approx(10 * 1852 / 3600), None), ("weather", "KA", 5.0, None), ("weather", "KB", None, "no-wind")]
    assert "PartitionFilters" in got._jdf.queryExecution().toString()
    early = networks.observations(spark, root, ["weather"], dt.datetime(2023, 12, 31, 22), end, ["KA"])
    assert early.count() == 2
    with pytest.raises(Exception, match="(?i)eof|gzip|stream|incorrect"):
        networks.observations(spark, root, ["weather"], begin, end).collect()


def test_networks_refuse(spark, root):
    with pytest.raises(ValueError, match="no-such-network"):
        networks.observations(spark, root, ["tide"], at(0), at(1))
    with pytest.raises(ValueError, match="no-network"):
        networks.union({})
    with pytest.raises(ValueError, match="bad-window"):
        networks.years(at(2), at(1))
    assert networks.years(dt.datetime(2023, 12, 31, 12), dt.datetime(2024, 6, 1)) == [2023, 2024] and networks.years(dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31)) == [2023, 2024, 2025]


# ---- stores

def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store = stores.Store(spark, path, "station bigint, speed double", ["station"])
    rows = lambda *r: spark.createDataFrame(list(r), "station bigint, speed double")
    assert store.read().count() == 0 and store.read().columns == ["station", "speed", "run"]
    store.write(rows((1, 2.0), (2, 3.0)), "a")
    store.write(rows((1, 9.0)), "b")
    store.write(rows((1, 2.5), (3, 3.0)), "a")
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, 2.5, "a"), (1, 9.0, "b"), (3, 3.0, "a")]
    for bad, code in ((rows((5, 1.0), (5, 2.0)), "duplicate-key"), (rows((None, 1.0)), "no-key"), (rows((5, 1.0)).withColumn("x", F.lit(1)), "other-schema"), (rows((5, 1.0)).withColumn("speed", F.lit(1)), "other-schema")):
        with pytest.raises(stores.Refused) as e:
            store.write(bad, "b")
        assert e.value.code == code
    assert [tuple(r) for r in store.read("b").collect()] == [(1, 9.0, "b")]
    written = store.runs()
    with pytest.raises(stores.Refused, match="stale: runs a"):
        store.read("a", now_ms=written["a"] + 1001, max_age_ms=1000)
    assert store.read("a", now_ms=written["a"] + 1000, max_age_ms=1000).count() == 2
    with pytest.raises(stores.Refused, match="no-such-run: z; there are a, b"):
        store.read("z")
    with pytest.raises(stores.Refused, match="other-schema"):
        stores.Store(spark, path, "station bigint, gust double", ["station"]).read()
    store.write(rows(), "c")
    assert store.evict(max(store.runs().values()), keep=1) and len(store.runs()) == 1
    assert store.evict(max(store.runs().values()) + 10, max_age_ms=5) and store.runs() == {}


# ---- boxes

def test_boxes_by_cells(spark):
    r = random.Random(4)
    pts = [(i, round(r.uniform(-90, 90), 1), round(r.uniform(-180, 180), 1)) for i in range(250)]
    boxes = [(i, s := round(r.uniform(-90, 80), 1), w := round(r.uniform(-180, 170), 1), s + r.choice([0.0, 0.1, 3.0, 10.0]), w + r.choice([0.0, 0.1, 2.0, 60.0])) for i in range(80)]
    boxes += [(100, -90.0, -180.0, 90.0, 180.0), (101, 10.0, 10.0, 5.0, 20.0), (102, None, 1.0, 2.0, 3.0), (103, pts[0][1], pts[0][2], pts[0][1], pts[0][2])]
    p, b = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(boxes, "box int, south double, west double, north double, east double")
    good = [x for x in boxes if None not in x]
    want = {(x[0], i) for x in good for i, lat, lon in pts if x[1] <= lat <= x[3] and x[2] <= lon <= x[4]}
    got = places.inside(p, b, ["box"])
    pairs = [(x.box, x.id) for x in got.select("box", "id").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    meets = places.meeting(b, b.withColumnRenamed("box", "other"), "box", "other")
    assert {tuple(x) for x in meets.collect()} == {(x[0], y[0]) for x in good for y in good if x[1] <= x[3] and y[1] <= y[3] and x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4]}
    near = {x.box: x.matched for x in places.nearest(p, b, "box", "id", 3).collect()}
    assert near[100] == 250 and near[101] == 0 and near[103] >= 1 and set(near) == {x[0] for x in boxes}
    ranks = [(x.rank, x.distance) for x in places.nearest(p, b, "box", "id", 3).where("box = 100").orderBy("rank").collect()]
    assert [k for k, _ in ranks] == [1, 2, 3] and ranks == sorted(ranks)


def brute_counts(boxes, tiles):
    good = lambda x: None not in x[1:5] and x[1] <= x[3] and x[2] <= x[4]
    met = {x[0]: [y[5] or 0 for y in tiles if good(x) and good(y) and x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4]] for x in boxes}
    return {k: (len(v), sum(v)) for k, v in met.items()}


@pytest.mark.parametrize("strip", [3, 50_000])
def test_boxes_are_counted_without_pairs(spark, monkeypatch, strip):
    monkeypatch.setattr(places, "STRIP", strip)
    r = random.Random(strip)
    # many shared edges, boxes without extent, one that holds all, one inverted, one without a side
    some = lambda n: [(i, s := float(r.randint(-9, 9)), w := float(r.randint(-9, 9)), s + r.choice([0.0, 1.0, 4.0]), w + r.choice([0.0, 2.0, 5.0]), r.choice([None, -7, 2**40, i])) for i in range(n)]
    boxes, tiles = some(150) + [(500, -90.0, -180.0, 90.0, 180.0, 1), (501, 5.0, 0.0, 1.0, 9.0, 1), (502, None, 0.0, 1.0, 9.0, 1)], some(170) + [(500, 5.0, 0.0, 1.0, 9.0, 1), (501, 0.0, 0.0, None, 1.0, 1)]
    kind = "box int, south double, west double, north double, east double, v bigint"
    b, t = spark.createDataFrame(boxes, kind), spark.createDataFrame(tiles, kind)
    got = {x.box: (x.matched, x.total) for x in places.counted(b.drop("v"), t.drop("box"), "box", "v").collect()}
    assert got == brute_counts(boxes, tiles)
    assert {(x.box, x.matched) for x in places.counted(b, t.limit(0), "box").collect()} == {(x[0], 0) for x in boxes}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_meeting_tiles_are_not_paired(spark, monkeypatch):
    monkeypatch.setattr(places, "meeting", lambda *a: pytest.fail("boxes and tiles were paired"))
    got = stations.boxes_meeting_tiles(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/part.parquet").count() and got.agg(F.sum("tiles")).first()[0] > 0


def test_nearest_are_found_around_the_centre(spark, monkeypatch):
    r = random.Random(9)
    pts = [(i, round(r.uniform(30, 50), 2), round(r.uniform(-120, -80), 2)) for i in range(3000)]
    pts += [(3000 + i, round(r.gauss(44, 0.05), 2), round(r.gauss(-100, 0.05), 2)) for i in range(1000)] + [(4000 + i, 35.0, -90.0) for i in range(9)]  # a cluster, and one place with ties
    boxes = [(i, s := r.uniform(25, 45), w := r.uniform(-125, -85), s + r.uniform(5, 20), w + r.uniform(5, 30)) for i in range(60)]
    boxes += [(100, -90.0, -180.0, 90.0, 180.0), (101, 34.0, -91.0, 36.0, -89.0), (102, 49.9, -100.0, 80.0, -85.0), (103, 35.0, -130.0, 35.0, -80.0), (104, 60.0, 0.0, 61.0, 1.0), (105, None, 0.0, 61.0, 1.0), (106, -95.0, -400.0, 95.0, 100.0)]
    met, inside = [], places.inside
    monkeypatch.setattr(places, "inside", lambda *a: (met.append(inside(*a)), met[-1])[1])
    p, b = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(boxes, "box int, south double, west double, north double, east double")
    got = {}
    for x in sorted(places.nearest(p, b, "box", "id", 5).collect(), key=lambda x: (x.box, x.rank or 0)):
        got.setdefault(x.box, []).append((x.matched, x.id))
    pairs = sum(m.count() for m in met)
    cross = b.join(p, F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
    rows = cross.withColumn("d", G.haversine((F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2, "lat", "lon")).select("box", "d", "id").collect()
    for k, *_ in boxes:
        mine = sorted((x.d, x.id) for x in rows if x.box == k)
        assert got[k] == ([(len(mine), i) for _, i in mine[:5]] or [(0, None)])
    assert pairs < len(rows) / 3  # before: all of them


# ---- discs and metrics

def test_tiled_discs(spark):
    z = np.random.default_rng(1).normal(size=(41, 33))
    z[3:6, 7] = np.nan
    rows = [("d", r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z) if (r, c) != (20, 20)]
    z[20, 20] = np.nan
    cells = spark.createDataFrame(rows, "domain string, row int, col int, z double")
    want = kernels.disc_mean_grid(z, 75.0, 10.0, 12.0)
    got = {(r.row, r.col): r.disc_mean for r in kernels.disc_mean_tiled(cells, 75.0, 10.0, 12.0, tile=8).collect()}
    assert len(got) == len(rows) and all(got[k] == (None if np.isnan(want[k]) else pytest.approx(want[k])) for k in got)
    assert set(grid.disc(75.0, 10.0, 12.0)) == {(r, c) for r in range(-6, 7) for c in range(-7, 8) if (12 * r) ** 2 + (10 * c) ** 2 <= 75**2}


def test_metrics_left_one_out_of(spark):
    r = random.Random(2)
    rows = [(g, r.uniform(0, 9), None if r.random() < 0.1 else r.uniform(0, 360), r.random() < 0.1, r.uniform(0, 9), r.uniform(0, 360)) for g in "aabbbcccccd" for _ in range(6)]
    pairs = spark.createDataFrame(rows, "station string, obs_speed double, obs_from double, calm boolean, mod_speed double, mod_from double")
    got = {x.station: x for x in scoring.leave_one_out_of(pairs, "station", {"v": scoring.vector_rmse(), "t": scoring.circular_bias()}).collect()}
    for g in "abcd":
        rest = scoring.score(pairs.where(F.col("station") != g)).first()
        assert got[g].v_without == pytest.approx(rest.vec_rmse) and got[g].t_without == pytest.approx(rest.dir_bias)
        assert got[g].v_delta == pytest.approx(rest.vec_rmse - got[g].v)
    one = scoring.leave_one_out_of(pairs.where("station = 'a'"), "station", {"v": scoring.vector_rmse(), "t": scoring.circular_bias()}).first()
    assert one.v is not None and one.v_without is None and one.t_without is None


def test_searches_and_refusals(spark):
    d = spark.createDataFrame([("KA", "Alder Gulch", "CO", "on"), ("KB", None, " co", "off"), ("KC", "Basin", None, "on")], "id string, name string, state string, status string")
    found = lambda q: sorted(r.id for r in d.where(T.station_search(q, ["id", "name"], ("status",))).collect())
    assert found(" aLd ") == ["KA"] and found("k") == found(None) == found("") == found({}) == ["KA", "KB", "KC"]
    assert found({"state": "ut, co"}) == ["KA"] and found({"status": "on"}) == ["KA", "KC"] and found({"status": "ON"}) == [] and found({"name": "BASIN", "state": None}) == ["KC"]
    assert [r.id for r in d.where(T.in_states("state", "co, UT")).collect()] == ["KA"]
    assert spark.range(1).select(T.roughness_length(F.lit("0.4")), T.roughness_length(F.lit(None).cast("string"))).first()[:] == (0.4, None)
    with pytest.raises(Exception, match="no-such-roughness: lawnn"):
        spark.range(1).select(T.roughness_length(F.lit("lawnn"))).collect()


# ---- streams

CYCLE = "cycle timestamp, issued timestamp, valid_time timestamp"


def test_cycles_that_come_late_are_found_and_wrong_ones_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    have = [(at(3), at(3, 50), at(3))]
    feed = spark.readStream.schema("id long, time timestamp").parquet(str(tmp_path / "in"))
    writer = streams.paired_with_cycles(feed, lambda: spark.createDataFrame(have, CYCLE), str(tmp_path / "ok"), str(tmp_path / "refused"))
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).start()

    def put(*rows):
        spark.createDataFrame(list(rows), "id long, time timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()

    put((1, at(4)), (2, at(3, 40)), (3, at(10)))
    have += [(at(5), at(6, 10), at(5)), (at(9), at(9, 30), at(8))]
    put((4, at(6, 5)), (5, at(6, 10)), (6, at(9, 45)), (7, at(16)))
    q.stop()
    got = {r.id: r.cycle.hour for r in spark.read.parquet(str(tmp_path / "ok")).collect()}
    bad = {r.id: r.code for r in spark.read.parquet(str(tmp_path / "refused")).collect()}
    assert got == {1: 3, 4: 3, 5: 5} and bad == {2: "no-cycle", 3: "no-cycle", 6: "mismatched-time", 7: "no-cycle"}


def test_directory_serves_the_last_good_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "key string, time timestamp, listing string"
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.directory(feed, 3 * 3_600_000).writeStream.format("memory").queryName("served").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    seen = []
    for rows in ([("a", at(1), "one"), ("b", at(1), None)], [("a", at(2), None)], [("a", at(0, 30), "old")], [("a", at(3), "two"), ("a", at(3, 10), None)], [("a", at(7), None)]):
        before = spark.table("served").count()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        seen.append(sorted((r.key, r.listing, r.stale, r.error) for r in spark.table("served").collect()[before:]))
    q.stop()
    assert seen[0] == [("a", "one", False, False), ("b", None, False, True)]
    assert seen[1] == [("a", "one", True, False)] and seen[2] == [("a", "one", True, False)]
    assert seen[3] == [("a", "two", True, False)] and seen[4][-1] == ("a", None, False, True)
