"""Language-model scores by stupid backoff, from count tables of the corpus itself.

The words are the ids of the byte-level BPE vocabulary, so the unigram table has a row for each id and no more; it is
summed by Spark and broadcast (its size is the vocabulary's). Bigrams and trigrams have no such bound: each block of documents counts its
own, the counts go to the partition of their hash, are summed there over all blocks into the count table, and each
block gets the sums of its n-grams back, joins them with its exploded n-grams and sums the scores of each document. Counts
travel packed, a row for each block and partition, because a row for each n-gram would be several times the text.

A document is scored against the rest of the corpus: its own occurrences are taken off every count. With c' for such a
count, N' for all ids, V for the vocabulary: a trigram (u, v, w) that occurs elsewhere scores log10 c'(uvw)/c'(uv); else a bigram that
does, log10 alpha c'(vw)/c'(v); any other id, log10 alpha^2 (c'(w) + 1) / (N' + V). A second id begins with its bigram, a first
one with itself, without the factors of what isn't there.

A block is a run of rows of one partition of the input, and its size is bounded (``BLOCK`` bytes of text, or one longer document). Texts are
encoded once, where they are read: a block's ids are written as one row beside the columns that pass through; n-grams are counted from there. An n-gram that every document holds is one entry a block, not a document.

Null and empty texts have no ids and a null score. Equal rows are copies of each other, so what they say occurs elsewhere.
Rows with the same id are scored one by one. Other columns pass through, or those of them that are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C
from .bpe import codec, vocabulary_path

BLOCK = 2 << 20
#: Bits of one id in an n-gram's key; the bit that tells a trigram's key from a bigram's.
ID_BITS, TRIGRAM = 20, np.uint64(1 << 60)


def squeeze(x: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane."""
    x = np.ascontiguousarray(x.astype("<u8"))
    return len(x).to_bytes(8, "little") + zstd.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueeze(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.ascontiguousarray(np.frombuffer(zstd.decompress(b[8:]), np.uint8).reshape(8, n).T).view("<u8").ravel() if n else np.zeros(0, np.uint64)


def ngrams(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of all bigrams and then all trigrams, the text of each, and the number of bigrams."""
    ids, keys, docs = flat.astype(np.uint64), [], []
    for order in (2, 3):
        at, doc = C.window_starts(off, order)
        key = np.zeros(len(at), np.uint64)
        for k in range(order):
            key = (key << np.uint64(ID_BITS)) | ids[at + k]
        keys.append(key | TRIGRAM if order == 3 else key), docs.append(doc)
    return np.concatenate(keys), np.concatenate(docs), len(keys[0])


def by_range(keys: np.ndarray, ranges: int) -> list[np.ndarray]:
    """Positions of sorted keys by range, in order. A range holds the keys of some first ids (and some of the second ones, so that
    a frequent id is split): they lie close together and pack well."""
    at = np.where(keys >= TRIGRAM, np.uint64(ID_BITS), np.uint64(0))
    first, second = (keys & ~TRIGRAM) >> (at + np.uint64(ID_BITS)), (keys >> at) & np.uint64(15)
    r = C.mix(first << np.uint64(4) | second, 31) % np.uint64(ranges)
    order = np.argsort(r.astype(np.uint16 if ranges <= 1 << 16 else np.int64), kind="stable")
    return np.split(order, np.searchsorted(r[order], np.arange(1, ranges).astype(np.uint64)))


def runs(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys; which of the sorted ones are new; how often each sorted one's document holds its key.

    Documents must not decrease among equal keys.
    """
    order = np.argsort(keys, kind="stable")
    key, own = keys[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = new.copy()
    begin[1:] |= own[1:] != own[:-1]
    length = np.diff(np.append(np.flatnonzero(begin), len(key)))
    return order, new, np.repeat(length, length)


def trimmed() -> None:
    """Give freed memory back, but keep the worker's stores."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def score(df: DataFrame, text: str = "text", path: str | None = None, alpha: float = 0.4, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``, ``n_seen`` (trigrams that occur elsewhere), ``score`` (mean log10 an id; null without ids). keep: columns that pass through (all)."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    spark, outer = df.sparkSession, [c for c in df.columns if c.lower() not in ("n_tokens", "n_seen", "score") and (keep is None or c in keep)]
    at_block, at_row, at_ids = C.fresh(df, "_block"), C.fresh(df, "_row"), C.fresh(df, "_ids")
    width, limit = 2 if codec(path).tok.get_vocab_size() <= 1 << 16 else 4, BLOCK
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")) + 64)).first()[0] or 0
    ranges = max(1, -(-int(size) // BLOCK) // 4)

    def encoded(batches):
        """The rows, without text, and for each block one row of its ids, its texts' lengths and its counts of ids."""
        from pyspark import TaskContext

        block, names = TaskContext.get().partitionId() << 32, [*outer, at_block, at_row, at_ids]
        for batch in C.slices(batches, at_ids, limit):
            flat, off = codec(path).encode(C.column(batch, at_ids))
            own, n = [C.column(batch, c) for c in outer], len(batch)
            yield pa.RecordBatch.from_arrays([*own, pa.array([block] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, IDS)], names)
            ids, counts = np.unique(flat, return_counts=True)
            row = {"flat": zstd.compress(flat.astype(f"<u{width}").tobytes(), 3), "sizes": squeeze(np.diff(off)), "ids": ids.tolist(), "counts": counts.tolist()}
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in own), pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.array([row], IDS)], names)
            block += 1
        trimmed()

    def opened(flat: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(zstd.decompress(flat), f"<u{width}").astype(np.uint32), np.concatenate([[0], np.cumsum(unsqueeze(sizes).astype(np.int64))])

    def count(batches):
        for batch in batches:
            for block, flat, sizes in zip(*(C.column(batch, c).to_pylist() for c in ("_block", "flat", "sizes"))):
                keys, n = np.unique(ngrams(*opened(flat, sizes))[0], return_counts=True)
                rows = [{"r": r, "_block": block, "k": squeeze(np.diff(keys[at], prepend=np.uint64(0))), "n": squeeze(n[at])} for r, at in enumerate(by_range(keys, ranges)) if len(at)]
                yield pa.RecordBatch.from_pylist(rows, COUNTED)
        trimmed()

    def total(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unsqueeze(b), dtype=np.uint64) for b in table.column("k").to_pylist()]
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, np.concatenate([unsqueeze(b) for b in table.column("n").to_pylist()]).astype(np.float64)).astype(np.int64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"r": table.column("r"), "_block": table.column("_block"), "n": pa.array([squeeze(sums[b]) for b in np.split(back, cuts)], pa.binary())})

    kinds = {**{c: df.schema[c].dataType.simpleString() for c in outer}, at_block: "bigint", at_row: "int", at_ids: "struct<flat:binary,sizes:binary,ids:array<int>,counts:array<bigint>>"}
    texts = df.select(*[f"`{c}`" for c in outer], F.col(f"`{text}`").alias(at_ids))
    dealt = C.written(texts.mapInArrow(encoded, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())), "ids")
    held_ids = dealt.where(F.col(at_ids).isNotNull())
    unigram = held_ids.select(F.explode(F.arrays_zip(f"{at_ids}.ids", f"{at_ids}.counts")).alias("x")).groupBy("x.ids").agg(F.sum("x.counts").alias("n"))
    partial = held_ids.select(F.col(at_block).alias("_block"), f"{at_ids}.flat", f"{at_ids}.sizes").mapInArrow(count, "r int, _block bigint, k binary, n binary")
    held = spark.sparkContext.broadcast(_dense(unigram, path))
    sums = partial.groupBy("r").applyInArrow(total, "r int, _block bigint, n binary")

    def join(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out_schema.empty_table()
        ids = docs.filter(pc.is_valid(docs.column(at_ids))).column(at_ids)[0]
        docs = docs.filter(pc.is_valid(docs.column(at_row))).sort_by(at_row)
        flat, off = opened(ids["flat"].as_py(), ids["sizes"].as_py())
        keys, doc, n_two = ngrams(flat, off)
        order, new, own = runs(keys, doc)
        distinct = keys[order[new]]
        table = np.zeros(len(distinct), np.int64)
        parts = by_range(distinct, ranges)
        for r, n in zip(found.column("r").to_pylist(), found.column("n").to_pylist()):
            table[parts[r]] = unsqueeze(n).astype(np.int64)
        sizes, one = np.diff(off), held.value
        vocabulary, everything = len(one), int(one.sum())
        whose = np.repeat(np.arange(len(sizes)), sizes)
        # counts of the rest of the corpus: a document's own are taken off
        rest = np.zeros(len(keys), np.int64)
        rest[order] = table[np.cumsum(new) - 1] - own
        order, _, own = runs(flat.astype(np.uint16 if vocabulary <= 1 << 16 else np.int64), whose)
        alone = np.zeros(len(flat), np.int64)
        alone[order] = one[flat[order]] - own
        left = (everything - sizes)[whose] + vocabulary
        two, three = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)  # by the last id of each
        two[C.ranges(off[:-1] + 1, np.maximum(sizes - 1, 0))] = rest[:n_two]
        three[C.ranges(off[:-1] + 2, np.maximum(sizes - 2, 0))] = rest[n_two:]
        place = np.arange(len(flat)) - off[:-1][whose]
        before = lambda x: np.concatenate([[1], x[:-1]]) if len(x) else x
        context = np.where(three > 0, before(two), before(alone))
        steps = np.minimum(place, 2) - np.where(three > 0, 2, np.where(two > 0, 1, 0))  # times that it backs off
        share = np.where(two > 0, np.where(three > 0, three, two) / np.maximum(context, 1), (alone + 1) / left)
        values = np.log10(share) + steps * np.log10(alpha)
        total = np.bincount(whose, values, len(sizes)).astype(np.float64)
        seen = np.bincount(whose, three > 0, len(sizes)).astype(np.int64)
        means = pa.array(total / np.maximum(sizes, 1), mask=sizes == 0)
        trimmed()
        return pa.table([*(docs.column(c) for c in outer), pa.array(sizes), pa.array(seen), means], [*outer, "n_tokens", "n_seen", "score"])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in outer] + ["n_tokens bigint", "n_seen bigint", "score double"])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, LongType, StructType

    full = StructType([df.schema[c] for c in outer])
    out_schema = to_arrow_schema(full.add("n_tokens", LongType()).add("n_seen", LongType()).add("score", DoubleType()))
    lean = dealt.withColumn(at_ids, F.when(F.col(at_ids).isNotNull(), F.struct(f"{at_ids}.flat", f"{at_ids}.sizes")))
    return lean.groupBy(at_block).cogroup(sums.groupBy("_block")).applyInArrow(join, schema)


#: A block's ids, and its counts of a range of n-grams.
IDS = pa.struct([("flat", pa.binary()), ("sizes", pa.binary()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
COUNTED = pa.schema([("r", pa.int32()), ("_block", pa.int64()), ("k", pa.binary()), ("n", pa.binary())])


def _dense(unigram: DataFrame, path: str) -> np.ndarray:
    """Counts by id; no more rows than the vocabulary has ids."""
    out = np.zeros(codec(path).tok.get_vocab_size(), np.int64)
    for row in unigram.toLocalIterator():
        out[row["ids"]] = row["n"]
    return out


def brute_force(texts: list[str | None], encode, vocabulary: int, alpha: float = 0.4) -> list[tuple[int, int, float | None]]:
    """(ids, trigrams seen elsewhere, score) of each text. For tests."""
    import math
    from collections import Counter

    ids = [encode(t or "") for t in texts]
    cut = lambda d, n: [tuple(d[i : i + n]) for i in range(len(d) - n + 1)]
    counts = {n: Counter(g for d in ids for g in cut(d, n)) for n in (1, 2, 3)}
    everything, out = sum(counts[1].values()), []
    for d in ids:
        own = {n: Counter(cut(d, n)) for n in (1, 2, 3)}
        c = lambda g: counts[len(g)][g] - own[len(g)][g]
        total, seen = 0.0, 0
        for i in range(len(d)):
            most = min(i, 2) + 1
            for n in range(most, 1, -1):
                g = tuple(d[i - n + 1 : i + 1])
                if c(g):
                    seen += n == 3
                    total += math.log10(alpha ** (most - n) * c(g) / c(g[:-1]))
                    break
            else:
                total += math.log10(alpha ** (most - 1) * (c((d[i],)) + 1) / (everything - len(d) + vocabulary))
        out.append((len(d), seen, total / len(d) if d else None))
    return out
