"""Joins in time and values by rank where one key holds most rows, against plain searches."""

import bisect
import random

import pytest

from gustfield.operators import pairing, scoring


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    stamp = lambda span: rng.randrange(span)
    obs = [(i, "hot" if rng.random() < 0.8 else rng.choice("ab"), stamp(900)) for i in range(300)] + [(300, None, 5), (301, "a", None), (302, "alone", 7), (303, "hot", 450), (304, "hot", 450)]
    samples = [(i, "hot" if rng.random() < 0.8 else rng.choice("ab"), stamp(90) * 10) for i in range(150)] + [(150, None, 5), (151, "hot", None), (152, "unasked", 3)]
    frame = lambda rows, first: spark.createDataFrame(rows, f"{first} long, station string, s long").selectExpr(first, "station", "timestamp_seconds(s) time")
    return obs, samples, frame(obs, "id"), frame(samples, "seq")


@pytest.mark.parametrize("bucket_s", [7.0, 100.0, 86400.0])
def test_as_of(series, bucket_s):
    obs, samples, o, s = series
    got = {r.id: (r.asof_us, r.asof_seq) for r in pairing.as_of(o, s, ["station"], "time", "seq", bucket_s).collect()}
    assert len(got) == len(obs)
    for i, k, t in obs:
        before = [(-x, q) for q, station, x in samples if None not in (k, t, x) and station == k and x <= t]
        best = min(before, default=None)
        assert got[i] == ((None, None) if best is None else ((-best[0] - t) * 1_000_000, best[1]))


@pytest.mark.parametrize("bucket_s", [7.0, 100.0, 86400.0])
def test_nearest_either_side(series, bucket_s):
    obs, samples, o, s = series
    got = {r.id: (r.nearest_us, r.nearest_seq) for r in pairing.nearest_either_side(o, s, ["station"], "time", "seq", bucket_s).collect()}
    assert len(got) == len(obs)
    for i, k, t in obs:
        near = [(abs(x - t), q, x) for q, station, x in samples if None not in (k, t, x) and station == k]
        best = min(near, default=None)
        assert got[i] == ((None, None) if best is None else ((best[2] - t) * 1_000_000, best[1]))


def test_no_samples_and_no_observations(series):
    _, _, o, s = series
    assert pairing.as_of(o, s.limit(0), ["station"], "time", "seq").where("asof_us is not null").count() == 0
    assert pairing.nearest_either_side(o.limit(0), s, ["station"], "time", "seq").count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
def test_by_rank(spark, rounds):
    rng = random.Random(9)
    groups = {
        "hot": [rng.expovariate(0.01) for _ in range(3000)] + [1e300, -1e300],
        "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(500)],
        "one": [3.0],
        "ends": [float("-inf"), 1.0, 2.0, float("inf")],
        None: [0.1 * k for k in range(40)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("void", None)]
    shares = {"least": 0.0, "p5": 0.05, "mid": 0.5, "p95": 0.95, "most": 1.0}
    got = {r["g"]: r for r in scoring.by_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, rounds).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, q in shares.items():
            assert got[k][name] == sorted(vs)[min(int(q * len(vs)), len(vs) - 1)], (k, name)


def test_by_rank_without_groups_and_with_whole_numbers(spark):
    vs = [7, 3, 3, 9, 2**53 + 1, 2**53, 1]
    got = scoring.by_rank(spark.createDataFrame([(v,) for v in vs], "v long"), [], "v", {"mid": 0.5, "p80": 0.8, "most": 0.99}).first()
    ordered = sorted(vs)
    assert (got.mid, got.p80, got.most) == (ordered[3], ordered[5], ordered[6])
    assert bisect.bisect(ordered, got.p80) == 6
