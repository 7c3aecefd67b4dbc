"""Benchmark decontamination: windows of test words, as a hash set that every executor holds, searched in all training words.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A window is ``width`` consecutive
words of a benchmark item; an item of fewer words (one at least) is one window. A document word inside any
occurrence of a window is hit. A hash that hits is verified against the window's words before it counts.

The set is broadcast in blocks of items whose texts hold about ``BLOCK_BYTES``, however many items there are: the
size is checked first, and a larger benchmark is searched block by block, each against all documents, and the hits
of a document are united. What a block has found is written before the next one's turn, so that one block's set is in memory
at a time, however large the benchmark is.

Null texts have no words; documents and items without words hit nothing. Copies have equal results. Repeated items
all count. Rows with the same document id are handled one by one. Other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C

#: Text bytes of one block of the benchmark.
BLOCK_BYTES = 8 << 20

#: Bytes of words after lower-casing: digits, a-z, and all of non-ASCII characters.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])

ADDED = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "hit_starts": "array<bigint>", "hit_ends": "array<bigint>"}


def words_of(strings: pa.Array):
    data, off = C.raw(strings)
    data = C.lower_az(data)
    starts, ends, first = C.word_spans(data, off, C.byte_class(WORD_BYTES))
    return data, off, starts, ends, first


class WindowSet:
    """Hashes of a block's windows, by length, with the items and the words of each."""

    def __init__(self, ids: list, texts: list[str], width: int):
        data, _, starts, ends, first = words_of(pa.array(texts, pa.string()))
        hashes = C.Windows(C.span_hashes(data, starts, ends))
        joined = data.tobytes()
        self.chained: dict[tuple[int, int], list[tuple[bytes, set]]] = {}
        for k, item in enumerate(ids):
            n = int(first[k + 1] - first[k])
            long = min(width, n)
            at = np.arange(first[k], first[k + 1] - long + 1) if n else np.zeros(0, np.int64)
            for a, h in zip(at.tolist(), hashes(at, at + long).tolist()):
                words = b" ".join(joined[starts[i] : ends[i]] for i in range(a, a + long))
                for known, items in self.chained.setdefault((long, h), []):
                    if known == words:
                        items.add(item)
                        break
                else:
                    self.chained[long, h].append((words, {item}))
        self.by_length = {}
        for long in sorted({key[0] for key in self.chained}):
            h = np.array(sorted(k[1] for k in self.chained if k[0] == long), np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_length[long] = (h, bits)

    def search(self, strings: pa.Array):
        """For each text: its words, their byte spans, a flag for each hit word, and the items that occur."""
        data, off, starts, ends, first = words_of(strings)
        hashes = C.Windows(C.span_hashes(data, starts, ends))
        cover = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set] = {}
        joined = None
        for long, (known, bits) in self.by_length.items():
            at, doc = C.window_starts(first, long)
            h = hashes(at, at + long)
            near = np.flatnonzero(bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            near = near[known[np.minimum(np.searchsorted(known, h[near]), len(known) - 1)] == h[near]]
            if len(near) and joined is None:
                joined = data.tobytes()
            for a, d, key in zip(at[near].tolist(), doc[near].tolist(), h[near].tolist()):
                words = b" ".join(joined[starts[i] : ends[i]] for i in range(a, a + long))
                for text, own in self.chained[long, key]:
                    if text == words:
                        cover[a] += 1
                        cover[a + long] -= 1
                        items.setdefault(d, set()).update(own)
        return off, starts, ends, first, np.cumsum(cover)[:-1] > 0, items


_SETS: dict = {}
C.STORES.append(_SETS)


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[tuple[list, list[str]]]:
    """Items by blocks of a checked size: ids (as text) and texts."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = sorted((r[0] or "", r[1]) for r in part.toLocalIterator())
        yield [r[0] for r in rows], [r[1] for r in rows]


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted ids, as text, of items with occurring windows) and the hit stretches
    of the text as ``hit_starts`` and ``hit_ends`` (arrays, byte offsets in UTF-8). Columns of these names are replaced.
    """
    now, held = docs, None
    for k, (ids, texts) in enumerate(_blocks(benchmark, item_id, item_text)):
        if held is not None:
            now = C.written(now, "searched")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def fn(batch: pa.RecordBatch, held=held, later=k > 0) -> list[pa.Array]:
            if _SETS.get("of") is not held.value:
                _SETS.update({"of": held.value, "set": WindowSet(*held.value, width)})
            strings = C.column(batch, text)
            off, starts, ends, first, hit, items = _SETS["set"].search(strings)
            n = len(strings)
            own = [sorted(items.get(d, ())) for d in range(n)]
            if later:  # unite with what the blocks before have found
                own = [sorted({*a, *b}) for a, b in zip(own, C.column(batch, "items").to_pylist())]
                at = C.column(batch, "hit_starts")
                for d, (a, b) in enumerate(zip(at.to_pylist(), C.column(batch, "hit_ends").to_pylist())):
                    lo, hi = np.searchsorted(starts, np.array(a, np.int64) + off[d]), np.searchsorted(ends, np.array(b, np.int64) + off[d], side="right")
                    for x, y in zip(lo, hi):
                        hit[x:y] = True
            # stretches of adjacent hit words of one document
            fresh = hit.copy()
            fresh[1:] &= ~hit[:-1]
            inner = np.zeros(len(hit) + 1, bool)
            inner[first[:-1]] = True
            fresh |= hit & inner[:-1]
            last = hit.copy()
            last[:-1] &= ~hit[1:] | inner[1:-1]
            a, b = np.flatnonzero(fresh), np.flatnonzero(last)
            cuts = np.searchsorted(a, first)
            base = np.repeat(off[:-1], np.diff(cuts))
            hits = np.concatenate([[0], np.cumsum(hit)])[first]
            return [pa.array(np.diff(first)), pa.array(np.diff(hits)), pa.array(own, pa.list_(pa.string())), C.list_column(starts[a] - base, cuts, pa.int64()), C.list_column(ends[b] - base, cuts, pa.int64())]

        now = C.apply(now, text, C.Step(fn, ADDED))
    return now


def removed(docs: DataFrame, benchmark: DataFrame, text: str = "text", spans: bool = False, **options) -> DataFrame:
    """``docs`` without what the benchmark holds: contaminated documents go, or with spans=True only the hit stretches."""
    columns = docs.columns
    found = search(docs, benchmark, text, **options)
    if not spans:
        return found.where("n_hit = 0").select(*[f"`{c}`" for c in columns])

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for t, a, b in zip(C.column(batch, text).to_pylist(), C.column(batch, "hit_starts").to_pylist(), C.column(batch, "hit_ends").to_pylist()):
            if a:
                raw, at, parts = t.encode(), 0, []
                for x, y in zip(a, b):
                    parts.append(raw[at:x])
                    at = y
                t = b"".join([*parts, raw[at:]]).decode()
            out.append(t)
        return [pa.array(out, pa.string())]

    return C.apply(found, text, C.Step(fn, {text: "string"})).select(*[f"`{c}`" for c in columns])


def items_digest(items):
    """sha256 of the ids, sorted and joined by commas, as a column."""
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(texts: list[str | None], items: dict, width: int = 10) -> list[tuple[int, int, list[str]]]:
    """(words, hit words, items) of each text, by comparing every window with every window. For tests."""
    import re

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = {i: [w[k : k + min(width, len(w))] for k in range(len(w) - min(width, len(w)) + 1)] for i, t in items.items() if (w := cut(t))}
    out = []
    for t in texts:
        words = cut(t)
        hit, own = [False] * len(words), set()
        for i, windows in sets.items():
            for x in windows:
                for k in range(len(words) - len(x) + 1):
                    if words[k : k + len(x)] == x:
                        own.add(str(i))
                        hit[k : k + len(x)] = [True] * len(x)
        out.append((len(words), sum(hit), sorted(own)))
    return out
