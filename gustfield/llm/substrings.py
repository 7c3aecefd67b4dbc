"""Substring deduplication by De Bruijn compaction.

Edges of the graph are runs of ``width`` consecutive words (token k-mers). Building all of them as rows would move more
than the text itself, so edges travel in compacted paths from the start:

1. Every edge has a minimizer: the smallest hash among its runs of ``seed`` words, a function of its words alone. The
   consecutive edges of a document with the same minimizer form a path without branches within that document; it is
   sent as one row (minimizer, hash of all words of the path, source coordinates: row key, first edge, number of edges).
2. Paths whose minimizer occurs once, in all and in the path, hold no repeated edge; a join with the repeated minimizers drops them.
3. Paths with the same minimizer and the same words are one path of the graph with that many source coordinates, and
   all their edges repeat. (Two hashes must agree: the minimizer, then the path's; they are made from independent hashes of the words.)
4. Where paths of one minimizer differ, or one comes back to its minimizer, the graph branches: one source of each is opened into single edges, edges are
   counted over the branches, and the edges that repeat are joined back.
5. The repeated edges of each document, as coordinates, join its text. There coordinates that the text
   doesn't have fail the run, adjacent edges merge into maximal repeated spans, and the words are cut.

An edge is repeated if the same words also start anywhere else, in the same document or another; edges are judged on
the input. Every step is linear in the input: a group of n copies is n rows of each of its paths, never pairs. Counts
are combined before they are shuffled, joins can be split by Spark when they are skewed.

Null texts have no words, like empty ones; texts of fewer than ``width`` words are kept as they are. Equal rows (same id
and text) are copies of each other. Rows with the same id and different texts are different documents. Other columns
pass through; those that bear the name of an output column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C

#: Words of a seed, and the most edges of one path.
SEED, PATH = 8, 31


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


#: Bits of the place that a seed's hash shares a 64-bit value with while the smallest is searched.
PLACE = 28


def paths(strings: pa.Array, width: int):
    """(text, first edge as a word index in it, number of edges, minimizer, hash of the words, whether the minimizer stands
    in it twice) of every path. Minimizers are compared by the leading bits of their hashes, then the place."""
    data, off = C.raw(strings)
    starts, ends, first = C.word_spans(data, off, C.ws_word_bytes())
    words, apart = (C.Windows(C.span_hashes(data, starts, ends, k)) for k in (0, 1))
    at, doc = C.window_starts(first, width)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z.astype(bool)
    seed = min(SEED, width)
    seeds = np.arange(len(starts) - seed + 1)
    hashes, mask = words(seeds, seeds + seed, 3), (1 << PLACE) - 1
    lead = (hashes & np.uint64(~mask & (1 << 64) - 1)) | (seeds & mask).astype(np.uint64)
    low = (_sliding_min(lead, width - seed + 1)[at] & np.uint64(mask)).astype(np.int64)
    place = at + ((low - at) & mask)
    least = hashes[place]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    pieces = -(-length // PATH)  # a long run of one minimizer (periodic text) is cut
    head = C.ranges(begin * 0, pieces) * PATH + np.repeat(begin, pieces)
    count = np.minimum(np.repeat(begin + length, pieces) - head, PATH)
    whole = apart(at[head], at[head] + count + width - 1, 5)
    twice = place[head] != place[head + count - 1]
    return doc[head], at[head] - first[doc[head]], count, least[head].view(np.int64), whole.view(np.int64), twice


def repeated_spans(df: DataFrame, text: str = "text", width: int = 35, key: str = "_row") -> tuple[DataFrame, DataFrame]:
    """``df`` with the row key, and the repeated edges by it: ``cover``, an array of (start, n): n edges from word ``start`` on."""
    keyed = df.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]))
    source = keyed.select(key, F.col(f"`{text}`").alias("_text")).where(F.col("_text").isNotNull())

    def to_paths(batches):
        for batch in C.slices(batches, "_text"):
            doc, start, n, m, s, twice = paths(C.column(batch, "_text"), width)
            rows = C.column(batch, key).to_numpy(zero_copy_only=False)[doc]
            for i in range(0, len(doc), 1 << 16):
                j = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(m[j]), pa.array(s[j]), pa.array(rows[j]), pa.array(start[j].astype(np.int32)), pa.array(n[j].astype(np.int32)), pa.array(twice[j])], ["m", "s", key, "start", "n", "twice"])

    found = source.mapInArrow(to_paths, f"m bigint, s bigint, `{key}` bigint, start int, n int, twice boolean")
    common = found.groupBy("m").agg(F.count("*").alias("c"), ((F.min("s") != F.max("s")) | F.bool_or("twice")).alias("branches")).where("c > 1 or branches").select("m", "branches")
    kept = C.written(found.join(common, "m"), "paths")
    classes = kept.groupBy("m", "s").agg(F.count("*").alias("c"), F.first("branches").alias("branches"), F.min(F.struct(key, "start", "n")).alias("rep"))
    whole = kept.join(classes.where("c > 1").select("m", "s"), ["m", "s"]).select(key, "start", "n")

    # branches: one source of each path, opened into edges
    open_paths = classes.where("branches").select("m", "c", "rep.*").groupBy(key).agg(F.collect_list(F.struct("m", "c", "start", "n")).alias("open"))

    def to_edges(batches):
        for batch in C.slices(batches, "_text"):
            data, off = C.raw(C.column(batch, "_text"))
            starts, ends, first = C.word_spans(data, off, C.ws_word_bytes())
            words = C.Windows(C.span_hashes(data, starts, ends, 1))
            lists = C.column(batch, "open")
            each = lists.flatten()
            own = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            m, c, start, n = (each.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            rows = C.column(batch, key).to_numpy(zero_copy_only=False)
            w = C.ranges(start.astype(np.int64), n.astype(np.int64))
            of = np.repeat(np.arange(len(n)), n)
            at = w + first[own[of]]
            e = words(at, at + width, 9).view(np.int64)
            for i in range(0, len(w), 1 << 16):
                j = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(m[of[j]]), pa.array(e[j]), pa.array(c[of[j]]), pa.array(rows[own[of[j]]]), pa.array(w[j].astype(np.int32))], ["m", "e", "c", key, "start"])

    opened = source.join(open_paths, key).mapInArrow(to_edges, f"m bigint, e bigint, c bigint, `{key}` bigint, start int")
    # equal rows are several rows with one key: their edges come once each, and count as often as their path did
    opened = C.written(opened.dropDuplicates(["m", "e", key, "start"]), "edges")
    repeats = opened.groupBy("m", "e").agg(F.sum("c").alias("t")).where("t > 1").select("m", "e")
    single = opened.where("c = 1").join(repeats, ["m", "e"]).select(key, "start", F.lit(1).alias("n"))
    cover = whole.unionByName(single).groupBy(key).agg(F.collect_set(F.struct("start", "n")).alias("cover"))
    return keyed, cover


def remove_repeats(df: DataFrame, text: str = "text", width: int = 35) -> DataFrame:
    """Adds ``n_words``, ``n_removed``, ``spans`` (maximal repeated stretches: arrays of first word, end word) and ``kept`` (the rest, joined by one space)."""
    return _cut(df, text, width, False)


def digest_repeats(df: DataFrame, text: str = "text", width: int = 35) -> DataFrame:
    """As remove_repeats, with ``kept_sha256`` in the place of the text and what was kept."""
    return _cut(df, text, width, True)


def _cut(df: DataFrame, text: str, width: int, digest: bool) -> DataFrame:
    key, held = C.fresh(df, "_row"), C.fresh(df, "cover")
    keyed, cover = repeated_spans(df, text, width, key)
    joined = keyed.join(cover.withColumnRenamed("cover", held), key, "left").drop(key)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        data, off = C.raw(C.column(batch, text))
        starts, ends, first = C.word_spans(data, off, C.ws_word_bytes())
        lists = C.column(batch, held)
        each = lists.flatten()
        own = np.repeat(np.arange(batch.num_rows), np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))
        start, n = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        lo = start + first[own]
        hi = lo + n - 1 + width
        if len(hi) and (hi > first[own + 1]).any():
            raise ValueError("coordinates of repeated edges that the text doesn't have")
        delta = np.zeros(len(starts) + 1, np.int64)
        np.add.at(delta, lo, 1)
        np.add.at(delta, hi, -1)
        gone = np.cumsum(delta)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[first]
        stay = np.flatnonzero(~gone)
        lens = ends[stay] - starts[stay] + 1  # with the separator behind
        flat = data[C.ranges(starts[stay], lens)].copy()
        upto = np.concatenate([[0], np.cumsum(lens)])
        flat[upto[1:] - 1] = 0x20
        cuts = upto[np.searchsorted(stay, first)]
        raw = flat.tobytes()
        parts = [raw[a : b - 1] if b > a else b"" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        out = [pa.array(np.diff(first)), pa.array(np.diff(removed))]
        if digest:
            return [*out, pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
        spans = []
        for d in range(batch.num_rows):
            g = gone[first[d] : first[d + 1]].astype(np.int8)
            edge = np.diff(np.concatenate([[0], g, [0]]))
            spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist())
        return [*out, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([p.decode() for p in parts], pa.string())]

    adds = {"n_words": "bigint", "n_removed": "bigint"} | ({"kept_sha256": "string"} if digest else {"spans": "array<array<bigint>>", "kept": "string"})
    return C.apply(joined, text, C.Step(fn, adds, (held, text) if digest else (held,)))


def brute_force(texts: list[str | None], width: int = 35) -> list[tuple[int, int, str]]:
    """(words, removed, kept) of each text. For tests."""
    import re
    from collections import Counter

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out
