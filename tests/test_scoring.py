import math

import pytest
from pyspark.sql import functions as F

from gustfield.functions import angles as A
from gustfield.operators import pairing, scoring

PAIR = "station string, obs_speed double, obs_from double, calm boolean, mod_speed double, mod_from double"


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIR)


def test_angles_keep_their_edges(spark):
    r = spark.range(1).select(A.signed_gap(F.lit(0.0), F.lit(180.0)).alias("a"), A.half_open_gap(F.lit(0.0), F.lit(180.0)).alias("b"), A.signed_gap(F.lit(10.0), F.lit(350.0)).alias("c"), A.round_up(F.lit(-2.5)).alias("d"), A.bearing_from(F.lit(0.0), F.lit(0.0)).alias("e"), A.bearing_from(F.lit(0.0), F.lit(0.0), 0.0).alias("f"), A.compass_point(F.lit(359.0)).alias("g")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (180.0, -180.0, 20.0, -2.0, None, 0.0, "N")


def test_score_by_hand(spark):
    r = scoring.score(pairs(spark, [("a", 2.0, 0.0, False, 3.0, 90.0), ("a", 0.1, None, True, 1.0, 10.0), ("a", 0.5, 20.0, False, 0.5, 20.0), ("b", 4.0, None, False, None, 0.0)])).first()
    assert (r.n, r.calm, r.dir_n, r.vec_n, r.light, r.within_30) == (3, 1, 1, 3, 1, 0)
    assert r.bias == pytest.approx((1 + 0.9 + 0) / 3)
    assert r.vec_rmse == pytest.approx(math.sqrt((13 + 1 + 0) / 3))
    assert r.bias_censoring == pytest.approx(scoring.CALM_CEILING / 3)


def test_empty_score(spark):
    r = scoring.score(pairs(spark, [])).first()
    assert (r.n, r.bias, r.bias_censoring, r.rmse) == (0, None, 0.0, None)


def test_jackknife_by_hand(spark):
    rows = [(g, 5.0, 0.0, False, 5.0 + e, 0.0) for g, e in (("A", 1.0), ("B", -1.0), ("C", 4.0)) for _ in range(2)]
    folds = scoring.leave_one_out(pairs(spark, rows), "station")
    got = {r.station: r.without for r in folds.collect()}
    assert folds.first().full == pytest.approx(math.sqrt(6))
    assert got["A"] == pytest.approx(math.sqrt(34 / 4)) and got["C"] == pytest.approx(1.0)
    one = scoring.leave_one_out(pairs(spark, rows[:2]), "station").first()
    assert (one.n_remaining, one.without, one.delta) == (0, None, None)


def test_jackknife_refit_is_brute_force(spark):
    rows = [(f"s{i % 5}", 2.0 + i % 7, 0.0, False, 1.0 + (i * 13 % 11) / 2, 0.0) for i in range(40)]
    got = {r.station: r.without for r in scoring.leave_one_out(pairs(spark, rows), "station", debias=True).collect()}
    for s in got:
        rest = [r for r in rows if r[0] != s]
        k = sum(r[1] for r in rest) / sum(r[4] for r in rest)
        assert got[s] == pytest.approx(math.sqrt(sum((k * r[4] - r[1]) ** 2 for r in rest) / len(rest)))


def test_ties_take_the_first_sample(spark):
    obs = spark.sql("select 1 as id, 7 as station, timestamp'2024-01-01 00:10:00' as time")
    sam = spark.sql("select * from values (5, 7, timestamp'2024-01-01 00:15:00', 1.0), (3, 7, timestamp'2024-01-01 00:05:00', 2.0), (9, 7, timestamp'2024-01-01 00:20:00', 3.0) as t(seq, station, time, speed)")
    r = pairing.nearest_in_time(obs, sam, ["station"], "time", "seq", 600, ["speed"], "id").first()
    assert (r.sample_seq, r.offset_us) == (3, -300_000_000)
    r = pairing.nearest_either_side(obs, sam, ["station"], "time", "seq").first()
    assert (r.nearest_seq, r.nearest_us) == (3, -300_000_000)
    edge = pairing.nearest_in_time(obs, sam.where("seq = 9"), ["station"], "time", "seq", 600, ["speed"], "id").first()
    assert edge.sample_seq == 9  # the tolerance is inclusive
    none = pairing.nearest_in_time(obs, sam.where("false"), ["station"], "time", "seq", 600, ["speed"], "id").first()
    assert none.sample_seq is None


def test_first_seen_mode(spark):
    d = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, v string, s int")
    assert tuple(scoring.first_seen_mode(d, ["k"], "v", "s").first()) == (1, "b", 2, 4)
