"""Vectorised text primitives shared by the operators of this subpackage.

All of them work on the UTF-8 bytes of an Arrow string column with numpy, so that no Python object is made
per word. Texts are processed whole, in slices of whole documents of about ``SLICE_BYTES`` (one document is
never cut, so the bound on memory is the larger of that and the longest text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

#: Word separators of the white-space word definition: \x20 and \x09-\x0D.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path under the folder that the cluster shares (spark.checkpoint.dir), for a written table.

    Only where the setting is absent (tests, a local session) a folder of this machine is taken instead.
    """
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run in a folder under the shared one; each goes when nothing reads it any more."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.paths, self.made = spark, shared_dir(spark, what), {}, 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete what ``write`` has returned, and its list of files; nothing else may read it afterwards."""
        for t in tables:
            _, path = self.paths.pop(id(t))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Let the driver give up the plans, broadcasts and shuffles that nothing reads any more.

    Spark removes them when the JVM has collected its handles on them, and the JVM would rather let its heap grow. For
    loops of many small jobs, once in a while.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name``1, ``name``2, ... that no column of ``df`` has (in any case)."""
    taken, k, out = {c.lower() for c in df.columns}, 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}{k}"
    return out


#: Bits of the map by which rows are told that may be wanted: the size of what is broadcast, whatever is wanted.
MAP_BITS = 22


def may_be(df: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: false where no row of ``wanted`` has the key (null is a key), true where one has it and now and then elsewhere.

    A map of 2**MAP_BITS bits in words of 64 is broadcast: 2**(MAP_BITS - 6) rows at most.
    """
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - MAP_BITS)
    word, bits = fresh(df, "_word"), fresh(df, "_bits")
    at = wanted.select(place(F.col(f"`{key}`")).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias(bits))
    told = df.withColumn(word, F.shiftright(place(F.col(f"`{key}`")), 6)).join(F.broadcast(words), word, "left")
    hit = F.expr(f"coalesce(shiftrightunsigned(`{bits}`, cast(shiftrightunsigned(xxhash64(`{key}`), {64 - MAP_BITS}) & 63 as int)) & 1 = 1, false)")
    return told.withColumn(flag, hit).drop(word, bits)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """While it holds, Arrow batches have at most ``rows`` rows: for wide rows, so that a batch's memory stays bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of whole rows with about ``limit`` bytes of ``column`` each (one row at least)."""
    limit = limit or SLICE_BYTES
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at, base = 0, 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            base, at = int(ends[to - 1]), to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Step:
    """One operator's work on a batch: ``fn`` returns the columns ``adds`` (name -> Spark type); ``drops`` go.

    ``fn`` must not depend on how rows are sliced.
    """

    def __init__(self, fn: Callable[[pa.RecordBatch], list[pa.Array]], adds: dict[str, str], drops: tuple[str, ...] = ()):
        self.fn, self.adds, self.drops = fn, adds, drops

    def names(self, before: list[str]) -> list[str]:
        """Input columns that bear the name of an output column are replaced."""
        return [n for n in before if n not in self.drops and n not in self.adds] + [*self.adds]

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        made = self.fn(batch)
        kept = [n for n in batch.schema.names if n not in self.drops and n not in self.adds]
        return pa.RecordBatch.from_arrays([*(column(batch, n) for n in kept), *made], [*kept, *self.adds])


#: What a worker holds for the task at hand (powers, tokenizers, window sets); emptied when the task ends.
STORES: list[dict] = []


def release() -> None:
    """Give back memory that a finished task leaves in its worker, which stays for later tasks of any operator."""
    import ctypes
    import gc

    for store in STORES:
        store.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(fn: Callable) -> Callable:
    """``fn`` (of batches), followed by ``release``."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def apply(df: DataFrame, by: str, *steps: Step, limit: int | None = None) -> DataFrame:
    """Run ``steps`` one after the other in a single Python worker, over slices of whole rows cut by the bytes of column ``by`` (``limit`` bytes, SLICE_BYTES by default)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = df.columns
    for step in steps:
        names, kinds = step.names(names), kinds | step.adds
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)

    def run(batches):
        for piece in slices(batches, by, limit):
            for step in steps:
                piece = step(piece)
            yield piece

    return df.mapInArrow(tidy(run), schema)


def raw(strings: pa.Array, end: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by the separator ``end``, and the offsets of the texts in them. Null: empty."""
    strings = pc.binary_join_element_wise(pc.fill_null(strings.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(end, pa.large_string()))
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    if data is None or not len(strings):
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


@lru_cache(maxsize=8)
def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(members)] = 1
    return out


def ws_word_bytes() -> np.ndarray:
    """1 for bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    return 1 - byte_class(SPACE_BYTES)


def word_spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, and for each text the index of its first word (n + 1 entries).

    ``member`` says which bytes belong to words; every text must end with a byte that doesn't (see ``raw``).
    """
    edge = np.flatnonzero(np.diff(member[data], prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, off)


_GROW = {}
STORES.append(_GROW)


def _powers(base: int, n: int) -> np.ndarray:
    have = _GROW.get(base)
    if have is None or len(have) < n:
        size = (n >> 18) + 1 << 18
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(out, dtype=np.uint64)
        _GROW[base] = have
    return have[:n]


#: Odd multiplier of the hashes of runs and its inverse modulo 2**64.
WORD_BASE = 0xD1342543DE82EF95
WORD_INV = pow(WORD_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser over 64-bit values; equal values stay equal, everything else spreads."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """For each byte the 64-bit value of the eight bytes from it on (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(data) + 1,), (1,))


#: What stays of eight bytes if only the first k belong to a range.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, a function of the bytes (and the seed) alone.

    Eight bytes at a time are mixed with their place in the range, and the sum is mixed again. Neither step is linear, so
    that no arrangement of bytes collides whatever they are; seeds give independent hashes.
    """
    lens = ends - starts
    value, place = eights(data), lambda j: mix(j.astype(np.uint64) + np.uint64(1), seed + 17)
    with np.errstate(over="ignore"):
        total = mix((value[starts] & FIRST_BYTES[np.minimum(lens, 8)]) ^ place(np.zeros(1, np.int64)), seed)
        long = np.flatnonzero(lens > 8)
        if len(long):
            more = (lens[long] - 1) // 8
            j = ranges(np.ones(len(long), np.int64), more)
            own = np.repeat(long, more)
            part = mix((value[starts[own] + 8 * j] & FIRST_BYTES[np.minimum(lens[own] - 8 * j, 8)]) ^ place(j), seed)
            total[long] += np.add.reduceat(part, np.cumsum(more) - more)
        return mix(total + lens.astype(np.uint64) * np.uint64(WORD_BASE), seed + 29)


class Windows:
    """Hashes of runs of consecutive items, each a function of the items alone, in constant time a run."""

    def __init__(self, items: np.ndarray):
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * _powers(WORD_BASE, len(items)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        raised = (self.sums[ends] - self.sums[starts]) * _powers(WORD_INV, len(self.sums))[starts]
        return mix(raised + (ends - starts).astype(np.uint64), seed)


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``width`` items that lie in one text, and the text of each; ``first``: see word_spans."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    return ranges(first[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(total)


def lower_az(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only, byte by byte."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    return to[data]


def packed(values: np.ndarray) -> bytes:
    """An array's bytes, compressed: sums of rare things are mostly zeros."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(value: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), kind)


def tree(rows: DataFrame, keys: list[str], kind: str, add: Callable[[np.ndarray | None, np.ndarray], np.ndarray], fan: int = 64) -> DataFrame:
    """Combines arrays: ``keys`` (integers) and ``value`` (``packed`` arrays of numpy type ``kind``), one row for each key.

    add: what is held so far (None at first) and one more array. In two rounds, the first over ``fan`` parts of each key; a task
    reads the rows of a key one after the other and holds one result and an Arrow batch of rows: run it under ``small_batches``.
    """

    def run(batches):
        now, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in now), pa.array([packed(total.astype(kind))], pa.binary())], [*keys, "value"])
        for batch in batches:
            for *key, value in zip(*(column(batch, k).to_pylist() for k in keys), column(batch, "value")):
                if key != now:
                    if now is not None:
                        yield out()
                    now, total = key, None
                total = add(total, unpacked(value.as_buffer(), kind))
        if now is not None:
            yield out()

    schema = ", ".join([*(f"`{k}` bigint" for k in keys), "value binary"])
    salted = rows.select(*keys, "value").repartition(*keys, F.pmod(F.spark_partition_id(), F.lit(fan))).sortWithinPartitions(*keys)
    return salted.mapInArrow(run, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tree_sum(rows: DataFrame, keys: list[str], kind: str, most: int | None = None) -> DataFrame:
    """Sums arrays, equally long for a key, by ``tree``. Sums end at ``most``."""

    def add(total, each):
        if total is None:
            return each.astype(np.int64 if np.dtype(kind).kind in "iu" else np.float64)
        total += each
        return total if most is None else np.minimum(total, most, out=total)

    return tree(rows, keys, kind, add)


def crc32_mod(doc_id: str, of: int):
    """crc32 of the decimal text of an id, modulo ``of``, as a column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(of)


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def string_list(offsets: np.ndarray, values: list[str]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.string()))
