"""Token ids in files of fixed-width bit packing.

``write_packed`` encodes texts with the tokenizers library, appends an end id to each and stores the ids in
ascending order of the document id. The file format: a folder of Parquet shards, each row one block:
``shard``, ``block`` (its number in the shard), ``first`` (ids of the shard before it), ``n_ids``, ``width`` (bits
of one id: the minimum for the vocabulary), ``doc_ids`` and ``doc_starts`` (documents of the block and where each
begins in it, in ids), and ``payload``, in which id k takes bits ``k*width`` to ``(k+1)*width`` (little-endian, low
bit first). ``first`` and ``doc_starts`` are the block offsets: any id of any document is found and unpacked alone.

Shards are ranges of the document id, in order; a shard's size follows from the input, so that no task
gathers more than its share. Null ids come first. Rows with the same id stay together in no defined order.
Null texts are empty; they hold the end id only. An empty table makes an empty folder that reads as no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import columnar as C
from .bpe import codec, vocabulary_path

BLOCK_IDS = 1 << 18
#: Text bytes of one shard, about.
SHARD_BYTES = 256 << 20
SCHEMA = "shard int, block bigint, first bigint, n_ids bigint, width int, doc_ids array<bigint>, doc_starts array<bigint>, payload binary"


def width_of(vocabulary: int) -> int:
    """Bits that the largest of ``vocabulary`` ids needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Low bit first, ``width`` bits an id."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; reads the bytes that hold them only."""
    stop = len(payload) * 8 // width if stop is None else stop
    n = stop - start
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", n, start * width // 8).astype(np.uint32)
    lo = start * width
    part = np.frombuffer(payload, np.uint8)[lo // 8 : -(-(stop * width) // 8)]
    bits = np.unpackbits(part, bitorder="little")[lo % 8 : lo % 8 + n * width].reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def write_packed(df: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = 2, shards: int | None = None) -> None:
    """Writes the folder ``out``. shards: their number; by default one for each SHARD_BYTES of text, and as many as a shuffle has partitions at least."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    if not shards:
        size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")) + 64)).first()[0] or 0
        shards = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // SHARD_BYTES))
    n = shards
    ranged = df.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")).repartitionByRange(n, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first())

    def run(batches):
        from pyspark import TaskContext

        enc = codec(path, special_as_text=False)
        width = width_of(enc.tok.get_vocab_size())
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held, names, starts, size = [], [], [], 0

        def flush():
            nonlocal block, first, held, names, starts, size
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block]), pa.array([first]), pa.array([size]), pa.array([width], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([pack(np.concatenate(held), width)], pa.binary())], ["shard", "block", "first", "n_ids", "width", "doc_ids", "doc_starts", "payload"])
            block, first, held, names, starts, size = block + 1, first + size, [], [], [], 0
            return row

        for batch in C.slices(batches, "_text"):
            flat, off = enc.encode(C.column(batch, "_text"))
            if end_id is not None:
                flat = np.insert(flat, off[1:], end_id)
                off = off + np.arange(len(off))
            held.append(flat)
            names += C.column(batch, "_id").to_pylist()
            starts += (off[:-1] + size).tolist()
            size += len(flat)
            if size >= BLOCK_IDS:
                yield flush()
        if names:
            yield flush()

    ranged.mapInArrow(run, SCHEMA).write.parquet(out)


def read_packed(spark: SparkSession, path: str, *steps: C.Step) -> DataFrame:
    """Reads a folder back: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (binary, little-endian
    unsigned 32-bit). ``steps`` run on what was read, in the same worker."""
    kinds = {"shard": "int", "doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids": "binary"}
    names = [*kinds]
    for step in steps:
        names, kinds = step.names(names), kinds | step.adds

    def fn(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                ids = unpack(row["payload"], row["width"], 0, row["n_ids"])
                cuts = np.array([*row["doc_starts"], row["n_ids"]], np.int64)
                for i in range(0, len(cuts) - 1, 4096):
                    own = cuts[i : i + 4097]
                    off = ((own - own[0]) * 4).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(ids[own[0] : own[-1]]))])
                    out = pa.RecordBatch.from_arrays([pa.array(np.full(len(own) - 1, row["shard"], np.int32)), pa.array(row["doc_ids"][i : i + 4096], pa.int64()), pa.array(own[:-1] + row["first"]), pa.array(np.diff(own)), data], ["shard", "doc_id", "start", "n_tokens", "ids"])
                    for step in steps:
                        out = step(out)
                    yield out

    blocks = spark.read.schema(SCHEMA).parquet(path)
    docs = blocks.mapInArrow(fn, ", ".join(f"`{n}` {kinds[n]}" for n in names))
    return docs.join(F.broadcast(shard_starts(blocks)), "shard").withColumn("start", F.col("base") + F.col("start")).drop("shard", "base")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard. One row a shard: as many as the writer had partitions, whatever the rows are."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def random_access(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with this id: the blocks that list it are read, and of their payloads only its bits."""
    out = []
    for row in spark.read.schema(SCHEMA).parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("bigint"))).toLocalIterator():
        cuts = [*row["doc_starts"], row["n_ids"]]
        out += [unpack(bytes(row["payload"]), row["width"], cuts[k], cuts[k + 1]) for k, d in enumerate(row["doc_ids"]) if d == doc_id]
    return out
