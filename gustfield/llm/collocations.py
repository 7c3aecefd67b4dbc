"""Phrase collocations: minimal perfect hashes of words and of phrases, Apriori-safe n-grams counted by range.

Phrases are 2 to 4 consecutive words of a piece (texts are cut into pieces at marks), counted in each language apart. A phrase can
only be frequent if all its parts are, so:

1. Words are counted as rows. Words are known by 64-bit hashes; the vocabulary is searched for words that share one, and if any do, other hashes
   are taken. The frequent ones (``least`` times or more) of each language get a minimal perfect hash: a word's slot, in which a second, independent
   hash and its count are stored, is its number from here on.
2. Mappers count pairs of frequent words. Their distinct pairs go, sorted and packed, to the ranges that the leading words belong to, where the counts of all
   mappers are added up. These counts are exact; what stays below ``least`` goes. Each range also gives a map of bits of its frequent pairs.
3. Longer n-grams all of whose pairs stand in the maps are counted in the same way.
4. The frequent n-grams of a range get a minimal perfect hash, and the counts of the parts that a phrase begins with are read by slot; those of the parts
   that it ends with likewise, in the ranges of the last two words.
5. Scores, the search for longer phrases that hold a candidate, and the ranks are DataFrame operations, in decimals where products may pass 64 bits.

The texts are read three times whatever their number and that of the phrases. Broadcast are the frequent words (24 bytes each) and the maps
of pairs, whose size ends at 2**SLOT_BITS[2] bits; beyond it they let more n-grams be counted in vain, not fewer.

Null texts are empty; null languages are ``und``. Texts without words, and tables without frequent phrases, give nothing. Copies count each.
Very long texts are read whole, by themselves. Equal scores and counts are ordered by the phrase's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import columnar as C
from .ngram_scores import squeeze, unsqueeze

MARKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 4
#: Most bits of the maps of frequent n-grams by their length, and bits of a range's number.
SLOT_BITS, KEY_BITS = {2: 28}, 9
#: Distinct n-grams of a length that a task holds before it hands them on or adds them up.
BLOCK = 1 << 20
#: Bytes of text that a mapper works on at a time.
SLICE = 2 << 20
#: Rows of phrases in an Arrow batch.
ROWS = 1 << 15


class Words:
    """Words of texts: hashes, piece and language of each."""

    def __init__(self, strings: pa.Array, langs: pa.Array, seed: int):
        data, off = C.raw(strings)
        self.data = C.lower_az(data)
        marks = C.byte_class(MARKS)
        self.starts, self.ends, first = C.word_spans(self.data, off, 1 - C.byte_class(MARKS + BLANKS))
        self.hash = C.span_hashes(self.data, self.starts, self.ends, seed)
        self.piece = np.cumsum(marks[self.data], dtype=np.int32)[self.starts]
        self.doc = np.repeat(np.arange(len(strings)), np.diff(first))
        self.lang = _lang_hashes(langs)[self.doc]


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    data, off = C.raw(langs)
    return C.span_hashes(data, off[:-1], off[1:] - 1, 41)


def first_key(hashes: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
    return C.mix(hashes ^ C.mix(lang, seed), seed)


def next_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of the n-gram that ends with one more word."""
    return C.mix(key * np.uint64(C.WORD_BASE) + word)


def number_bits(words: int) -> int:
    """Bits of the number of one of so many words."""
    return max(1, words.bit_length())


def joined(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """N-grams of numbers of so many bits (32 at most) as one column of integers, or two, in the same order."""
    out = []
    for i in range(0, len(ids), 64 // bits):
        col = np.zeros(len(ids[0]), np.uint64)
        for x in ids[i : i + 64 // bits]:
            col = col << np.uint64(bits) | x
        out.append(col)
    return out


def apart(cols: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    """The numbers that ``joined`` has put together."""
    out, mask = [], np.uint64((1 << bits) - 1)
    for i, col in zip(range(0, n, 64 // bits), cols):
        k = min(64 // bits, n - i)
        out += [col >> np.uint64(bits * (k - 1 - j)) & mask for j in range(k)]
    return out


def tallied(cols: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order and the sums of their counts (1 each if there are none)."""
    if len(cols) == 1 and counts is None:
        keys, n = np.unique(cols[0], return_counts=True)
        return [keys], n
    order = np.argsort(cols[0]) if len(cols) == 1 else np.lexsort(cols[::-1])
    cols, new = [c[order] for c in cols], np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    at = np.flatnonzero(new)
    if counts is None or not len(at):
        return [c[at] for c in cols], np.diff(np.append(at, len(order)))
    return [c[at] for c in cols], np.add.reduceat(counts[order], at)


def part_of(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Range of a pair of words' numbers."""
    return (C.mix(one << np.uint64(32) | two, 31) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


class PairMap:
    """Maps of bits of the frequent pairs of each range, two bits a pair."""

    def __init__(self, parts: dict[int, bytes]):
        self.base, self.mask = np.zeros(1 << KEY_BITS, np.int64), np.full(1 << KEY_BITS, 63, np.uint64)
        at, bits = 8, [bytes(8)]
        for part, own in parts.items():
            self.base[part], self.mask[part] = at, len(own) * 8 - 1
            at += len(own)
            bits.append(own)
        self.bits = np.frombuffer(b"".join(bits), np.uint8)

    @staticmethod
    def places(one: np.ndarray, two: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
        h = C.mix(one << np.uint64(32) | two, 3)
        return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)

    @staticmethod
    def made(one: np.ndarray, two: np.ndarray, most: int) -> bytes:
        """Map of the pairs of one range, of 2**most bits at most."""
        size = 1 << max(6, min(most, (16 * len(one)).bit_length()))
        bits = np.zeros(size, bool)
        for at in PairMap.places(one, two, np.uint64(size - 1)):
            bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        part, out = part_of(one, two), np.ones(len(one), bool)
        for at in self.places(one, two, self.mask[part]):
            out &= self.bits[self.base[part] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1 > 0
        return out


class PerfectHash:
    """Slots 0 to n - 1 of n different keys: levels of bits, a key's slot is the rank of the first bit that is its alone."""

    def __init__(self, keys: np.ndarray):
        self.sizes, words, level = [], [], 0
        while len(keys):
            size = -(-len(keys) * 2 // 64) * 64
            at = self._at(keys, level, size)
            n = np.bincount(at, minlength=size)
            words.append(np.packbits(n == 1, bitorder="little"))
            self.sizes.append(size)
            keys = keys[n[at] != 1]
            level += 1
            if level > 200:
                raise ValueError("equal keys have no slots of their own")
        self.bytes = np.concatenate([*words, np.zeros(0, np.uint8)])
        self.base = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bytes), dtype=np.int64)])

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (C.mix(keys, 101 + level) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1, or the slot of another, for keys that have none."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._at(keys[left], level, size) + self.base[level]
            byte, bit = self.bytes[at >> 3], (at & 7).astype(np.uint8)
            mine = (byte >> bit) & 1 > 0
            low = byte[mine] & ((1 << bit[mine].astype(np.int64)) - 1).astype(np.uint8)
            out[left[mine]] = self.rank[at[mine] >> 3] + np.bitwise_count(low)
            left = left[~mine]
            if not len(left):
                break
        return out


class Block:
    """Words or phrases: slots, the stored keys, and counts by slot once they are known."""

    def __init__(self, keys: np.ndarray, stored: np.ndarray, **by_slot: np.ndarray):
        self.hash = PerfectHash(keys)
        at = self.hash(keys)
        for name, values in {"stored": stored, **by_slot}.items():
            own = np.zeros(len(keys), values.dtype)
            own[at] = values
            setattr(self, name, own)

    def find(self, keys: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """Slots, -1 for what isn't in the block."""
        at = self.hash(keys)
        if len(self.stored):
            at[self.stored[at] != stored] = -1
        return at


def _tuple_keys(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Key and stored key of n-grams given by the numbers of their words."""
    none = np.zeros(len(words[0]), np.uint64)
    key, stored = first_key(words[0], none, 0), first_key(words[0], none, 5)
    for w in words[1:]:
        key, stored = next_key(key, w), next_key(stored, w)
    return key, stored


def _phrase_block(phrases: list[tuple[list[np.ndarray], np.ndarray]]) -> Block:
    """Phrases (numbers of words, counts) of several lengths with their counts by slot."""
    keys = [_tuple_keys(ids) for ids, _ in phrases]
    none = np.zeros(0, np.uint64)
    return Block(*(np.concatenate([none, *(k[i] for k in keys)]) for i in (0, 1)), counts=np.concatenate([np.zeros(0, np.int64), *(c for _, c in phrases)]))


def _counts(block: Block, words: list[np.ndarray]) -> np.ndarray:
    """Counts of phrases that are all in the block."""
    at = block.find(*_tuple_keys(words))
    if (at < 0).any():
        raise ValueError("a part of a frequent phrase isn't frequent")
    return block.counts[at]


class Mining:
    def __init__(self, docs: DataFrame, text: str, lang: str, least: int, seed: int = 0):
        self.spark, self.least, self.seed = docs.sparkSession, least, seed
        self.docs = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang")).where("text != ''")
        self.scratch = C.Scratch(self.spark, "phrases")

    def mapped(self, fn, schema: str) -> DataFrame:
        """``fn`` (of an iterator of Words, with the languages of their texts) over all texts."""
        seed = self.seed

        def run(batches):
            yield from fn((Words(C.column(b, "text"), C.column(b, "lang"), seed), C.column(b, "lang")) for b in C.slices(batches, "text", SLICE))

        return self.docs.mapInArrow(C.tidy(run), schema)

    def vocabulary(self) -> DataFrame:
        """g and lang (a language's hash and name), word, h (its hash), f (how often it occurs); no two words have one hash."""

        def fn(pieces):
            for w, langs in pieces:
                if len(w.hash):
                    _, one, c = np.unique(first_key(w.hash, w.lang, 0), return_index=True, return_counts=True)
                    raw, s, e = w.data.tobytes(), w.starts[one].tolist(), w.ends[one].tolist()
                    names = pa.array([raw[a:b] for a, b in zip(s, e)], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(w.lang[one].view(np.int64)), langs.take(pa.array(w.doc[one])), names, pa.array(w.hash[one].view(np.int64)), pa.array(c)], ["g", "lang", "word", "h", "c"])

        while True:
            with C.small_batches(self.spark, 2000):
                found = self.scratch.write(self.mapped(fn, "g bigint, lang string, word string, h bigint, c bigint").groupBy("g", "lang", "word", "h").agg(F.sum("c").alias("f")), "words")
            if found.groupBy("h").agg((F.min("word") != F.max("word")).alias("shared")).where("shared").isEmpty():
                return found
            self.scratch.drop(found)
            self.seed += 1

    def numbered(self, frequent: DataFrame) -> tuple[Block, DataFrame]:
        """The frequent words' block (count and language by slot), and the words with their slots as ``id``."""
        table = frequent.select("h", "g", "f").toArrow()
        h, g, f = (table.column(c).to_numpy() for c in ("h", "g", "f"))
        h, g = h.view(np.uint64), g.view(np.uint64)
        block = Block(first_key(h, g, 0), first_key(h, g, 5), counts=f, lang=g.view(np.int64))
        held = self.spark.sparkContext.broadcast(block)

        def fn(batches):
            for batch in batches:
                h, g = (C.column(batch, c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h", "g"))
                yield pa.RecordBatch.from_arrays([pa.array(held.value.find(first_key(h, g, 0), first_key(h, g, 5))), C.column(batch, "word")], ["id", "word"])

        return block, frequent.select("h", "g", "word").mapInArrow(C.tidy(fn), "id bigint, word string")

    def counted(self, words: Block, lengths: list[int], pairs: PairMap | None = None) -> DataFrame:
        """n, part, k, m, c (packed: n-grams as ``joined`` has them, counts), bits (of pairs: their map): n-grams of frequent words that occur ``least`` times or
        more, those without a pair that ``pairs`` doesn't have."""
        held, known = self.spark.sparkContext.broadcast(words), self.spark.sparkContext.broadcast(pairs)
        bits, least, most, map_bits = self.bits, self.least, BLOCK, SLOT_BITS[2] - KEY_BITS

        def united(parts):
            return tallied([np.concatenate(c) for c in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts])) if len(parts) > 1 else parts[0]

        def row(n, part, cols, counts, *more):
            second = squeeze(cols[1]) if len(cols) > 1 else None
            return [pa.array([n]), pa.array([part]), *(pa.array([x], pa.binary()) for x in (squeeze(np.diff(cols[0], prepend=np.uint64(0))), second, squeeze(counts), *more))]

        def handed(n, parts):
            cols, counts = united(parts)
            one, two = apart(cols, n, bits)[:2]
            part = part_of(one, two)
            order = np.argsort(part.astype(np.uint16), kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(own):
                    yield pa.RecordBatch.from_arrays(row(n, int(part[own[0]]), [c[own] for c in cols], counts[own]), ["n", "part", "k", "m", "c"])

        def fn(pieces):
            got, size = {n: [] for n in lengths}, dict.fromkeys(lengths, 0)
            for w, _ in pieces:
                at = held.value.find(first_key(w.hash, w.lang, 0), first_key(w.hash, w.lang, 5))
                ids, ok = at.astype(np.uint64), (at[:-1] >= 0) & (at[1:] >= 0) & (w.piece[:-1] == w.piece[1:])
                if known.value is not None:
                    may = np.flatnonzero(ok)
                    ok[may] = known.value.has(ids[may], ids[may + 1])
                for n in range(2, max(lengths) + 1):
                    at = np.flatnonzero(ok)
                    if n in lengths and len(at):
                        got[n].append(tallied(joined([ids[at + k] for k in range(n)], bits)))
                        size[n] += len(got[n][-1][1])
                        if size[n] > most:
                            yield from handed(n, got[n])
                            got[n], size[n] = [], 0
                    ok = ok[:-1] & ok[1:]
            for n, parts in got.items():
                if parts:
                    yield from handed(n, parts)

        def total(batches):
            now, held, size = None, [], 0

            def done():
                n, part = now
                cols, counts = united(held)
                often = counts >= least
                cols, counts = [c[often] for c in cols], counts[often]
                own = PairMap.made(*apart(cols, 2, bits), map_bits) if n == 2 else None
                return pa.RecordBatch.from_arrays(row(n, part, cols, counts, own), ["n", "part", "k", "m", "c", "bits"])

            for batch in batches:
                for *key, k, m, c in zip(*(C.column(batch, x).to_pylist() for x in ("n", "part", "k", "m", "c"))):
                    if key != now:
                        if now is not None:
                            yield done()
                        now, held, size = key, [], 0
                    held.append(([np.cumsum(unsqueeze(k), dtype=np.uint64), *([] if m is None else [unsqueeze(m)])], unsqueeze(c).astype(np.int64)))
                    size += len(held[-1][1])
                    if size > most + 2 * len(held[0][1]):
                        held = [united(held)]
                        size = len(held[0][1])
            if now is not None:
                yield done()

        packed = "n bigint, part bigint, k binary, m binary, c binary"
        with C.small_batches(self.spark, 64):
            rows = self.mapped(fn, packed).repartition("n", "part").sortWithinPartitions("n", "part")
            return self.scratch.write(rows.mapInArrow(C.tidy(total), f"{packed}, bits binary"), "counts")

    def with_cuts(self, words: Block, counted: DataFrame) -> DataFrame:
        """g, n, w1 to w4 (numbers of words), a, l1 to l3, r1 to r3: the frequent phrases with the counts of the parts of their cuts."""
        held, bits = self.spark.sparkContext.broadcast(words), self.bits
        ids, cuts = [f"w{k}" for k in range(1, LONGEST + 1)], ["l1", "l2", "l3", "r1", "r2", "r3"]
        names = ["g", "n", *ids, "a", *cuts, "part"]

        def left(batches):
            """Of a range of leading pairs: what begins a phrase, and the counts of last words."""
            for found in together(batches):
                block = {n: (apart(cols, n, bits), counts) for n, (cols, counts) in opened(found).items()}
                known = _phrase_block([block[n] for n in range(2, LONGEST) if n in block])
                for n, (own, a) in block.items():
                    at = [x.astype(np.int64) for x in own]
                    sums = {"l1": held.value.counts[at[0]], f"r{n - 1}": held.value.counts[at[-1]]} | {f"l{k}": _counts(known, own[:k]) for k in range(2, n)}
                    none = np.zeros(len(a), np.int64)
                    values = [held.value.lang[at[0]], np.full(len(a), n), *at, *[None] * (LONGEST - n), a, *(sums.get(c, none) for c in cuts), part_of(*own[-2:])]
                    for i in range(0, len(a), ROWS):
                        size = len(a[i : i + ROWS])
                        yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if v is None else pa.array(v[i : i + ROWS]) for v in values], names)

        def opened(found):
            """Phrases of one range by length; a length has one row."""
            out = {}
            for n, k, m, c in zip(*(found.column(x).to_pylist() for x in ("n", "k", "m", "c"))):
                out[n] = [np.cumsum(unsqueeze(k), dtype=np.uint64), *([] if m is None else [unsqueeze(m)])], unsqueeze(c).astype(np.int64)
            return out

        def together(batches):
            """Tables of the rows of each range, which come one after the other."""
            rest = []
            for batch in batches:
                part = C.column(batch, "part").to_numpy(zero_copy_only=False)
                at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                for a, b in zip(at[:-1], at[1:]):
                    if rest and C.column(rest[0], "part")[0].as_py() != part[a]:
                        yield pa.Table.from_batches(rest)
                        rest = []
                    if b > a:
                        rest.append(batch.slice(a, b - a))
            if rest:
                yield pa.Table.from_batches(rest)

        def right(batches):
            """Of a range of last pairs: what ends a phrase."""
            for found in together(batches):
                have = {c: found.column(c).to_numpy() for c in ("n", "a", *cuts)}
                rows = {n: np.flatnonzero(have["n"] == n) for n in range(2, LONGEST + 1)}
                own = {n: [found.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[at].view(np.uint64) for c in ids[:n]] for n, at in rows.items()}
                known = _phrase_block([(own[n], have["a"][rows[n]]) for n in range(2, LONGEST)])
                sums = {c: have[c].copy() for c in cuts}
                for n, at in rows.items():
                    for k in range(1, n - 1):
                        sums[f"r{k}"][at] = _counts(known, own[n][k:])
                out = pa.table([pa.array(sums[c]) if c in sums else found.column(c) for c in names[:-1]], names[:-1])
                yield from out.combine_chunks().to_batches(ROWS)

        kinds = ", ".join(f"{c} bigint" for c in names)
        with C.small_batches(self.spark, 64):
            lefts = self.scratch.write(counted.drop("bits").repartition("part").sortWithinPartitions("part").mapInArrow(C.tidy(left), kinds), "left")
        return self.scratch.write(lefts.repartition("part").sortWithinPartitions("part").mapInArrow(C.tidy(right), kinds.removesuffix(", part bigint")), "cuts")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, scale: int = 2_000_000, percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language.

    a: occurrences of the phrase, which are ``least`` at least; l, r: of the parts before and behind its weakest cut; n: of all words of the
    language; score: floor(scale * a / (l + r)). Phrases that a longer one of ``percent`` of their occurrences holds are left out.
    """
    run = Mining(docs, text, lang, least)
    words = run.vocabulary()
    known, named = run.numbered(words.where(F.col("f") >= least))
    run.bits = number_bits(len(known.stored))
    pairs = run.counted(known, [2])
    bits = PairMap({part: bytes(own) for part, own in pairs.select("part", "bits").collect()})
    longer = run.counted(known, list(range(3, LONGEST + 1)), bits)
    return _ranked(run.with_cuts(known, pairs.unionByName(longer)), words, named, top, scale, percent)


def _ranked(cands: DataFrame, words: DataFrame, named: DataFrame, top: int, scale: int, percent: int) -> DataFrame:
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    own = ["g", "n", "w1", "w2", "w3", "w4"]
    cut = lambda k: f"if(n > {k}, named_struct('score', ({wide(scale)} * a) div ({wide(f'l{k}')} + r{k}), 'k', {k}, 'l', l{k}, 'r', r{k}), null)"
    # what holds a phrase holds one that is a word longer and occurs as often at least: parts without the first or last word are all that is needed
    part = lambda n, k: f"if(n = {n}, named_struct('n', {n - 1}L, " + ", ".join(f"'w{i}', " + (f"w{k + i}" if i < n else "cast(null as bigint)") for i in range(1, LONGEST + 1)) + "), null)"
    each = [part(n, k) for n in range(3, LONGEST + 1) for k in (0, 1)]
    held = cands.where("n > 2").select("g", "a", F.explode(F.expr(f"filter(array({', '.join(each)}), x -> x is not null)")).alias("p")).select("g", "p.*", "a").groupBy(*own).agg(F.max("a").alias("most"))
    same = F.expr(" and ".join(f"c.{c} <=> h.{c}" for c in own))
    scored = cands.withColumn("cut", F.expr(f"array_min(filter(array({', '.join(map(cut, range(1, LONGEST)))}), x -> x is not null))"))
    alone = scored.alias("c").join(held.alias("h"), same, "left").where(f"most is null or {wide('most')} * 100 < {wide('c.a')} * {percent}").select("c.*")
    # words take the place of their numbers; only phrases that may be among the first need them
    order = [F.desc("cut.score"), F.desc("a")]
    floor = alone.withColumn("_r", F.rank().over(Window.partitionBy("g").orderBy(*order))).where(F.col("_r") <= top).drop("_r")
    for k in range(1, LONGEST + 1):
        floor = floor.join(named.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    spelled = floor.withColumn("phrase", F.concat_ws(" ", *[f"word{k}" for k in range(1, LONGEST + 1)]))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    totals = words.groupBy("g", "lang").agg(F.sum("f").alias("n"))
    return ranked.drop("n").join(totals, "g").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("bigint").alias("score"))


def brute_force(rows: list[tuple[str | None, str | None]], least: int = 30, top: int = 2000, scale: int = 2_000_000, percent: int = 80) -> list[tuple]:
    """lang, rank, phrase, a, l, r, n, score of (text, lang) rows. For tests."""
    import re
    from collections import Counter

    count: dict[str, Counter] = {}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            count.setdefault("und" if lang is None else lang, Counter()).update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    out = []
    for lang, f in sorted(count.items()):
        n, cands = sum(c for p, c in f.items() if len(p) == 1), {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner: dict = {}
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(inner.get(p[i : i + m], 0), a)
        best = []
        for p, a in cands.items():
            if 100 * inner.get(p, 0) < percent * a:
                score, _, left, right = min((scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return out
