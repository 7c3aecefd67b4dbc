"""Embedding whitening by a tiled covariance.

1. Rows whose vector is null or holds null or non-finite entries go. Entry c becomes the integer floor(SCALE * c); each distinct
   vector of integers stands once in the fit list, a written table. Its number n and its sums by dimension are exact.
2. The fit list is cut into blocks of rows, and each block into blocks of columns (tiles of dimensions). Column blocks are shuffled by their row block; a
   task multiplies the pairs of tiles of each of its row blocks, centred first, and adds the products up by tile key (a
   pair of tiles). The tasks' sums are added in a tree. No task sees more than one row block and one sum of each pair of tiles.
3. The tiles make up the covariance, whose eigenvectors are taken where the job is driven: its size is that of the model, dimensions squared, whatever the number of rows.
4. Rows are projected where they lie. How far the whitened fit list's own covariance is from the identity is measured in a pass over it.

Equal vectors count once in the fit, so copies shift nothing, and all get equal results. Vectors of another length than most
(of equally frequent lengths the longest) have no place in the space and go, as do empty ones. Null ids and rows with equal ids stay. An empty table has no model and
gives no rows. Components without variance (one distinct vector, or fewer of them than dimensions) are whitened to 0.
Deviations that pass 64 bits fail the run. Other columns pass through; those that bear the name of an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columnar as C

#: Entries are taken in units of 1 / SCALE.
SCALE = 256
#: Dimensions of a tile, rows of a row block.
TILE, BLOCK = 16, 2048
#: Eigenvalues below this share of the largest are none.
LEAST = 1e-12


@dataclass
class Model:
    """n distinct vectors, their sums, eigenvalues and unit eigenvectors (columns) by falling eigenvalue; trace; error of the first ``measured`` components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float
    measured: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    def projection(self, components: int) -> np.ndarray:
        """dims x components: to whitened values from centred vectors."""
        e = self.values[:components]
        known = e > LEAST * max(self.values[0], 0.0)
        return np.where(known, self.vectors[:, :components] / np.sqrt(np.where(known, e, 1.0)), 0.0)


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _mean(n: int, sums: list[int]) -> np.ndarray:
    return np.array([s / n for s in sums])


def fit(df: DataFrame, vector: str = "embedding", scale: int = SCALE, measured: int = 4) -> Model | None:
    """The model of the distinct vectors; None if there are none. measured: components whose whitened covariance is compared with the identity."""
    spark, scratch = df.sparkSession, C.Scratch(df.sparkSession, "whitening")
    usable = df.select(F.col(f"`{vector}`").alias("v")).where(finite(F.col("v")))
    lengths = usable.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    dims = lengths[0]["d"]
    listed = scratch.write(usable.where(F.size("v") == dims).select(integers(F.col("v"), scale).alias("x")).distinct(), "listed")
    sums = _sums(listed, dims)
    n, totals = sums[0][0], [s for _, s in sums]
    total = np.zeros((dims, dims))
    with C.small_batches(spark, 64):
        tiles = C.tree_sum(_products(_column_blocks(listed), n, totals), ["i", "j"], "float64").collect()
    for i, j, value in tiles:
        a, b = (slice(k * TILE, min((k + 1) * TILE, dims)) for k in (i, j))
        block = C.unpacked(bytes(value), "float64").reshape(a.stop - a.start, b.stop - b.start)
        total[a, b], total[b, a] = block, block.T
    covariance = total / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    model = Model(n, totals, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(covariance)), 0.0, min(measured, dims))
    model.error = _identity_error(listed, model)
    scratch.drop(listed)
    return model


def _sums(listed: DataFrame, dims: int) -> list[tuple[int, int]]:
    """For each dimension the number of vectors and their sum."""

    def fn(batches):
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(C.column(batch, "x"), dims)
            n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(total)], ["k", "n", "s"])

    rows = listed.mapInArrow(fn, "k bigint, n bigint, s bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [(r["n"], int(r["s"])) for r in rows.orderBy("k").collect()]


def _column_blocks(listed: DataFrame) -> DataFrame:
    """block (of rows), tile (of dimensions), kind and cells (row by row) of the fit list."""

    def cut(k: int, x: np.ndarray) -> pa.RecordBatch:
        kind = np.promote_types(np.min_scalar_type(int(x.min())), np.min_scalar_type(-1 - int(x.max()))).str
        cells = [C.packed(x[:, at : at + TILE].astype(kind)) for at in range(0, x.shape[1], TILE)]
        same = lambda v, t: pa.array([v] * len(cells), t)
        return pa.RecordBatch.from_arrays([same(k, pa.int64()), pa.array(range(len(cells)), pa.int64()), same(kind, pa.string()), same(len(x), pa.int64()), pa.array(cells, pa.binary())], ["block", "tile", "kind", "rows", "cells"])

    def fn(batches):
        k, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            if batch.num_rows:
                lists = C.column(batch, "x")
                held.append(_matrix(lists, len(lists[0])))
            if sum(map(len, held)) >= BLOCK:
                yield cut(k, np.concatenate(held))
                k, held = k + 1, []
        if held:
            yield cut(k, np.concatenate(held))

    return listed.mapInArrow(fn, "block bigint, tile bigint, kind string, rows bigint, cells binary")


def _products(blocks: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """i, j, value: what a task's row blocks add to the products of each pair of tiles i <= j."""
    mean = _mean(n, sums)

    def fn(batches):
        total: dict[tuple[int, int], np.ndarray] = {}

        def add(tiles: dict[int, np.ndarray]):
            for i, a in tiles.items():
                for j, b in tiles.items():
                    if i <= j:
                        total[i, j] = total.get((i, j), 0) + a.T @ b

        now, tiles = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    add(tiles)
                    now, tiles = row["block"], {}
                at = row["tile"] * TILE
                tiles[row["tile"]] = C.unpacked(row["cells"], row["kind"]).reshape(row["rows"], -1) - mean[at : at + TILE]
        add(tiles)
        for (i, j), value in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([C.packed(value)], pa.binary())], ["i", "j", "value"])

    return blocks.repartition("block").sortWithinPartitions("block", "tile").mapInArrow(fn, "i bigint, j bigint, value binary")


def _identity_error(listed: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over components with variance."""
    mean, project, k = _mean(model.n, model.sums), model.projection(model.measured), model.measured

    def fn(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_matrix(C.column(batch, "x"), len(mean)) - mean) @ project
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "s"])

    rows = listed.mapInArrow(fn, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    total = np.array([r["s"] for r in rows]).reshape(k + 1, k) / model.n
    own = np.flatnonzero(project.any(0))
    off = (total[:k] - np.outer(total[k], total[k]) - np.eye(k))[np.ix_(own, own)]
    return float(np.abs(off).max()) if len(own) else 0.0


ADDED = {"n": "bigint", "deviation": "bigint", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}


def whiten(df: DataFrame, model: Model | None, vector: str = "embedding", scale: int = SCALE, components: int = 4) -> DataFrame:
    """Rows with usable vectors, with ``n``, ``deviation`` (sum over dimensions of (n x - sums)^2), ``whitened`` and ``explained`` (by component) and ``identity_error``."""
    x, ok = C.fresh(df, "_x"), F.col(f"`{vector}`")
    if model is None:
        return df.drop(*[c for c in df.columns if c.lower() in ADDED]).withColumns({k: F.lit(None).cast(t) for k, t in ADDED.items()}).where("false")
    k = min(components, model.dims)
    n, sums, mean, project = model.n, model.sums, _mean(model.n, model.sums), model.projection(k)
    share = (model.values[:k] / model.trace).tolist() if model.trace > 0 else [0.0] * k
    error = model.error

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        own = _matrix(C.column(batch, x), len(sums))
        most = n * max(abs(int(own.max(initial=0))), abs(int(own.min(initial=0)))) + max(map(abs, sums))
        if len(sums) * most * most < 1 << 63:
            dev = ((n * own - np.array(sums, np.int64)) ** 2).sum(1).tolist()
        else:
            dev = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in own.tolist()]
            if max(dev, default=0) >= 1 << 63:
                raise OverflowError("a deviation passes 64 bits")
        white, m = (own - mean) @ project, len(own)
        off = np.arange(m + 1) * k
        return [pa.array([n] * m, pa.int64()), pa.array(dev, pa.int64()), C.list_column(white.ravel(), off, pa.float64()), C.list_column(np.tile(share, m), off, pa.float64()), pa.array([error] * m, pa.float64())]

    rows = df.where(finite(ok) & (F.size(ok) == model.dims)).withColumn(x, integers(ok, scale)).drop(*[c for c in df.columns if c.lower() in ADDED])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != x) + "".join(f", {c} {t}" for c, t in ADDED.items())
    step = C.Step(fn, ADDED, (x,))
    return rows.mapInArrow(lambda batches: map(step, batches), schema)


def brute_force(vectors: list, scale: int = SCALE, components: int = 4):
    """n, deviations and (up to signs) whitened values of usable vectors (others None), and explained shares. For tests."""
    import math

    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) for v in vectors]
    x = [[math.floor(scale * c) for c in v] if o else None for v, o in zip(vectors, ok)]
    distinct = np.array(sorted({tuple(r) for r in x if r}), object)
    n, sums = len(distinct), distinct.sum(0)
    dev = [None if r is None else sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = (distinct.astype(float)) - (sums / n).astype(float)
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    e, v = values[::-1][:components], vectors_[:, ::-1][:, :components]
    white = [None if r is None else (np.array(r, float) - (sums / n).astype(float)) @ v / np.sqrt(e) for r in x]
    return n, dev, white, e / values.sum()
