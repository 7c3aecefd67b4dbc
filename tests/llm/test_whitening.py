"""Embedding whitening against numpy: exact sums and deviations, whitened values up to sign, nulls, copies and odd vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfield.llm import whitening
from gustfield.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n string, _x int"


def vectors(dims, rows, seed=1):
    r = random.Random(seed)
    mix = np.random.default_rng(seed).normal(size=(dims, dims)) * np.linspace(0.5, 0.02, dims)
    out = [np.float32(mix @ [r.gauss(0, 1) for _ in range(dims)]).tolist() for _ in range(rows)]
    odd = [None, [None] + out[0][1:], [float("nan")] + out[0][1:], [float("inf")] * dims, [float("-inf")] + out[0][1:]]
    return out + odd + out[:40] + [out[0]] * 200 + [[-0.0] * dims, [0.0] * dims]


def frame(spark, rows):
    return spark.createDataFrame([(i if i % 50 else None, v, i, "n", 7) for i, v in enumerate(rows)], SCHEMA)


def folder(spark, base, rows):
    frame(spark, rows).repartition(5).write.parquet(f"{base}/embeddings.parquet")
    return str(base)


@pytest.mark.parametrize("dims", [1, 3, 37])
def test_query(spark, tmp_path, dims):
    rows = vectors(dims, 300)
    got = QUERIES["op12_whitening"](spark, folder(spark, tmp_path / "f", rows)).collect()
    n, dev, white, share = whitening.brute_force(rows)
    k = min(4, dims)
    kept = [i for i, d in enumerate(dev) if d is not None]
    assert len(got) == k * len(kept) and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-9 and r.explained == pytest.approx(share[r.component - 1], rel=1e-9) for r in got)
    mine = {(r.vec_id, r.component): r for r in got if r.vec_id is not None}
    signs = [np.sign(mine[1, c].whitened * white[1][c - 1]) for c in range(1, k + 1)]
    for i in kept:
        if i % 50:
            assert all(mine[i, c].deviation == dev[i] and mine[i, c].whitened * signs[c - 1] == pytest.approx(white[i][c - 1], abs=1e-8) for c in range(1, k + 1))


def test_odd_tables(spark, tmp_path):
    assert QUERIES["op12_whitening"](spark, folder(spark, tmp_path / "none", [])).count() == 0
    assert QUERIES["op12_whitening"](spark, folder(spark, tmp_path / "null", [None, [], [None]])).count() == 0
    one = QUERIES["op12_whitening"](spark, folder(spark, tmp_path / "one", [[0.5, -0.25, 3.0]] * 3)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)} and len(one) == 9


def test_few_vectors_and_other_lengths(spark):
    rows = [[1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 1.0, 0.0, 1.0, 0.0], [1.0], [1.0, 2.0], [9.0] * 9]
    df = frame(spark, rows)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    assert len(got) == 2 and model.n == 2 and model.error < 1e-9
    assert [abs(round(w, 9)) for w in got[0].whitened] == [1, 0, 0, 0] and got[0].explained[0] == pytest.approx(1)


def test_columns_pass_and_overflow(spark):
    df = frame(spark, vectors(6, 50)).withColumn("Whitened", F.lit("mine"))
    got = whitening.whiten(df, whitening.fit(df), components=6)
    assert got.columns == ["vec_id", "embedding", "label", "_x", "n", "deviation", "whitened", "explained", "identity_error"] and got.where("_x = 7").count() == got.count()
    wide = frame(spark, [[1e9, 1.0], [2.0, 3.0], [4.0, 9.0]])
    dev = whitening.brute_force([[1e9, 1.0], [2.0, 3.0], [4.0, 9.0]])[1]
    assert max(dev) > 1 << 63
    with pytest.raises(Exception, match="passes 64 bits"):
        whitening.whiten(wide, whitening.fit(wide)).collect()
