"""Exact n-gram Jaccard join in a metric space: pivots, regions, triangle-inequality windows, recursion.

Documents are sets of distinct ``width``-word shingles; distance is 1 - Jaccard similarity, a metric. Two documents link at
distance 1 - threshold (the radius) or less. Documents with equal sets are one class; classes are what is joined.

**First regions.** Nearly all distances between unrelated texts are 1, so regions of random pivot documents would have windows
that hold every document. Regions therefore begin with shingles, in a global order: a class is replicated to the
regions of its first ``n - ceil(threshold * n) + 1`` shingles; by counting, two classes within the radius share one of these. The
order puts frequent shingles last, so that regions are small; it is only a matter of speed, any order gives the same links.

**Pivots and windows.** A region's pivot is a member (the least class), and every member's distance to it is bounded, then
computed where it may be within the radius. Regions of more than ``FAN`` members with one pivot become one, for they
share most members. Members that links connect with the pivot are settled. Any other member x can link with y only if
their distances to the pivot differ by the radius at most: what no such window reaches leaves the region.

**Recursion.** Of the members that aren't settled ``FIRST`` become pivots in the next round, eight times as many in each round after
it, and are compared with the region's members in their windows, as far as sketches let them link. A pivot that has been compared is done. A region
ends when nothing in it is left to be settled, so the recursion ends without a limit on rounds, and no pair is left out.

**Bounds.** Every class has a sketch: the parity of how many of its shingles fall on each of about n to 2n bits (4n to 8n for small sets). Bits in which
two sketches differ are at least one different shingle each; a pair whose bound lies beyond the radius is never compared.
Others are by their sets. Sets are made once, for classes of such pairs only.

Equality of shingles and classes is that of 64-bit hashes. Nothing is collected but the ``HOT`` most frequent shingles (for the
order), and what is broadcast are they and bit maps of a fixed size. A shingle counts as frequent if blocks of documents repeat it. Regions
of frequent shingles are salted by class. Links are found between classes, as many as connect what the definition connects. A round is
many small jobs; between them the driver gives up what it held for those before (``columnar.forget``).

Null texts and texts without words have no shingles and link with nothing; texts of fewer words than a shingle have
the whole sequence as one. Equal rows are copies of each other; rows with a null id count as documents. Whole texts are used. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import columnar as C

#: Pivots of a region in the first round of recursion: few, for one of them may settle a large group; regions of one pivot with more members become one.
FIRST, FAN = 2, 16
#: Shingles that the order knows as frequent, at most; documents from which on one is, and from which on a block tells of it; shingles of a block.
HOT, FREQUENT, REPEATED, BLOCK = 1 << 20, 4, 2, 1 << 21
#: Salts of a frequent shingle's region.
SALTS = 64
#: Rows of an Arrow batch of texts, and of pairs of sets.
TEXTS, PAIRS = 1000, 250


def words_of(strings: pa.Array):
    data, off = C.raw(strings)
    data = C.lower_az(data)
    starts, ends, first = C.word_spans(data, off, C.ws_word_bytes())
    return C.span_hashes(data, starts, ends), first


def shingles(strings: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their offsets."""
    hashes, first = words_of(strings)
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    at = C.ranges(first[:-1], n)
    own = C.Windows(hashes)(at, np.minimum(at + width, np.repeat(first[1:], n)), 11)
    upto = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        own[a:b].sort()
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    new[upto[:-1][n > 0]] = True
    return own[new], np.concatenate([[0], np.cumsum(new)])[upto]


def class_keys(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each set that doesn't depend on order."""
    with np.errstate(over="ignore"):
        a = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(sets, 1), dtype=np.uint64)])
        b = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(sets, 2), dtype=np.uint64)])
        total = C.mix(a[off[1:]] - a[off[:-1]], 3) ^ C.mix(b[off[1:]] - b[off[:-1]], 4)
    return C.mix(total + np.diff(off).astype(np.uint64)).view(np.int64)


def sketches(sets: np.ndarray, off: np.ndarray) -> pa.Array:
    """Parity bits of each set in words of 64: a power of two of words, for n bits or more (4n for small sets). Halves of a sketch folded by XOR are the sketch of half its size."""
    n = np.diff(off)
    size = 1 << np.ceil(np.log2(np.maximum(np.where(n <= 512, 4 * n, n), 64) / 64)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(n)), n)
    word = base[doc] + ((sets >> np.uint64(6)).astype(np.int64) & (size[doc] - 1))
    odd = np.bincount(word * 64 + (sets & np.uint64(63)).astype(np.int64), minlength=int(base[-1]) * 64) & 1
    return C.list_column(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), base, pa.int64())


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


class Frequent:
    """Rank of shingles in the global order: 0, or for frequent ones the logarithm of their number."""

    MASK = (1 << 22) - 1

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.rank = hashes[order], np.log2(counts[order]).astype(np.uint8)
        self.bits = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.bits is None:
            self.bits = np.zeros(self.MASK + 1, bool)
            self.bits[(self.hashes & np.uint64(self.MASK)).astype(np.int64)] = True
        out = np.zeros(len(x), np.uint8)
        near = np.flatnonzero(self.bits[(x & np.uint64(self.MASK)).astype(np.int64)])
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, x[near]), len(self.hashes) - 1)
            out[near] = np.where(self.hashes[at] == x[near], self.rank[at], 0)
        return out


def _both(df: DataFrame, left: str, right: str) -> DataFrame:
    """Ends of pairs as one column ``class``."""
    return df.select(F.col(left).alias("class")).unionByName(df.select(F.col(right).alias("class"))).distinct()


def apart(x: str, y: str) -> str:
    """SQL: bits in which two sketches differ. Sizes that fit differ by a factor below 2, so sketches do by a factor of 2 at most."""
    fold = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x ^ y)"
    same = lambda x, y: f"if(size({x}) > size({y}), {fold.format(x)}, {x})"
    return f"aggregate(zip_with({same(x, y)}, {same(y, x)}, (x, y) -> bit_count(x ^ y)), 0, (acc, x) -> acc + x)"


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class Join:
    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75):
        self.width, self.percent, self.radius = width, percent, 1 - percent / 100
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        self.id_type = self.docs.schema["doc_id"].dataType.simpleString()
        self.scratch = C.Scratch(self.spark, "jaccard")
        self.sets: list[DataFrame] = []

    # -- one pass over the texts: members and repeated shingles ----------------------------------------------------------

    def scan(self) -> DataFrame:
        """Rows (doc_id, n, class, sketch) of documents, and rows (h, c) of shingles that a block of documents repeats."""
        width = self.width
        schema = f"doc_id {self.id_type}, n bigint, class bigint, sketch array<bigint>, h bigint, c bigint"

        def fn(batches):
            names, held, size, kind = ["doc_id", "n", "class", "sketch", "h", "c"], [], 0, None

            def counted():
                h, c = np.unique(np.concatenate(held), return_counts=True)
                often = np.flatnonzero(c >= REPEATED)
                for i in range(0, len(often), 1 << 15):
                    part = often[i : i + (1 << 15)]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), *(pa.nulls(k, pa.int64()),) * 2, pa.nulls(k, pa.list_(pa.int64())), pa.array(h[part].view(np.int64)), pa.array(c[part])], names)

            for batch in C.slices(batches, "text"):
                sets, off = shingles(C.column(batch, "text"), width)
                n, ids = np.diff(off), C.column(batch, "doc_id")
                kind = ids.type
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(class_keys(sets, off), mask=n == 0), sketches(sets, off), none, none], names)
                held.append(sets)
                size += len(sets)
                if size >= BLOCK:
                    yield from counted()
                    held, size = [], 0
            if held:
                yield from counted()

        with C.small_batches(self.spark, TEXTS):
            return self.scratch.write(self.docs.mapInArrow(C.tidy(fn), schema), "scan")

    def frequent(self, scanned: DataFrame) -> Frequent:
        sums = scanned.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
        found = sums.orderBy(F.desc("c"), "h").limit(HOT).toArrow()
        return Frequent(found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy())

    # -- first regions ---------------------------------------------------------------------------------------------------

    def regions(self, frequent: Frequent) -> DataFrame:
        """h (shingle), pivot, class (another member) of all regions of two classes or more."""
        width, percent = self.width, self.percent
        held = self.spark.sparkContext.broadcast(frequent)

        def fn(batches):
            for batch in C.slices(batches, "text"):
                sets, off = shingles(C.column(batch, "text"), width)
                keys, n = class_keys(sets, off), np.diff(off)
                _, one = np.unique(keys, return_index=True)
                one = one[n[one] > 0]
                doc = np.repeat(np.arange(len(one)), n[one])
                own = sets[C.ranges(off[one], n[one])]
                rank, need = held.value(own), prefix_length(n[one], percent)
                rare, often = np.flatnonzero(rank == 0), np.flatnonzero(rank)
                often = often[np.lexsort((own[often], rank[often], doc[often]))]
                have = np.bincount(doc[rare], minlength=len(one))
                for at, most, salted in ((rare, need, False), (often, need - have, True)):
                    first = np.searchsorted(doc[at], np.arange(len(one)))
                    at = at[np.arange(len(at)) - first[doc[at]] < most[doc[at]]]
                    who = keys[one][doc[at]]
                    salt = pa.array((who % SALTS).astype(np.int16)) if salted else pa.nulls(len(at), pa.int16())
                    for i in range(0, len(at), 1 << 15):
                        j = slice(i, i + (1 << 15))
                        yield pa.RecordBatch.from_arrays([pa.array(own[at[j]].view(np.int64)), salt[j], pa.array(who[j])], ["h", "salt", "class"])

        shared = Window.partitionBy("h", "salt").orderBy("class")
        with C.small_batches(self.spark, TEXTS):
            rows = self.docs.where(F.octet_length("text") > 0).mapInArrow(C.tidy(fn), "h bigint, salt smallint, class bigint")
            least = rows.withColumn("pivot", F.first("class").over(shared))
            parts = self.scratch.write(least.where("salt is not null or class != pivot"), "parts")
        # the pivot of a salted region is the least of its parts'
        salted = parts.where("salt is not null")
        pivots = self.scratch.write(salted.groupBy("h").agg(F.min("pivot").alias("least")), "pivots")
        whole = salted.join(pivots, "h").select("h", F.col("least").alias("pivot"), "class").where("class != pivot")
        out = self.scratch.write(parts.where("salt is null").select("h", "pivot", "class").unionByName(whole).distinct(), "regions")
        self.scratch.drop(parts, pivots)
        return out

    # -- distances -------------------------------------------------------------------------------------------------------

    def bounds(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """a, b, near (they may link), lo (no distance is less): from sizes and sketches."""
        side = lambda k: classes.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("apart", F.expr(f"if({self.fits('na', 'nb')}, {apart('sa', 'sb')}, null)"))
        return both.select("a", "b", F.expr(f"coalesce({self.close('na', 'nb', 'apart')}, false)").alias("near"), F.expr("coalesce(2 * apart / (na + nb + apart), 1 - least(na, nb) / greatest(na, nb))").alias("lo"))

    def fits(self, n: str, m: str) -> str:
        return f"100 * least({n}, {m}) >= {self.percent} * greatest({n}, {m})"

    def close(self, n: str, m: str, apart: str) -> str:
        """Whether sets of these sizes with so many different shingles at least may link."""
        return f"100 * ({n} + {m} - {apart}) >= {self.percent} * ({n} + {m} + {apart})"

    def make_sets(self, wanted: DataFrame) -> None:
        """Sets (binary of sorted hashes) of classes (class, doc_id of one member). Only texts that may be wanted are shuffled."""
        width = self.width
        ids = wanted.select("doc_id").distinct()
        told = C.may_be(self.docs, "doc_id", ids, "_maybe").where("_maybe").select("doc_id", "text")
        texts = told.alias("t").join(ids.alias("w"), F.expr("t.doc_id <=> w.doc_id"), "left_semi").select("text")

        def fn(batches):
            for batch in C.slices(batches, "text"):
                sets, off = shingles(C.column(batch, "text"), width)
                yield pa.RecordBatch.from_arrays([pa.array(class_keys(sets, off)), pa.array([sets[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], ["class", "set"])

        with C.small_batches(self.spark, TEXTS):
            made = texts.mapInArrow(C.tidy(fn), "class bigint, set binary").join(wanted.select("class"), "class", "left_semi")
            self.sets.append(self.scratch.write(made.dropDuplicates(["class"]), "sets"))

    def all_sets(self) -> DataFrame:
        out = self.sets[0]
        for s in self.sets[1:]:
            out = out.unionByName(s)
        return out

    def exact(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked, d of pairs, from their sets."""
        percent, sets = self.percent, self.all_sets()
        side = lambda k, v: sets.select(F.col("class").alias(k), F.col("set").alias(v))

        def fn(batches):
            for batch in C.slices(batches, "x"):
                shared, joint = [], []
                for x, y in zip(C.column(batch, "x"), C.column(batch, "y")):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    shared.append(common), joint.append(len(p) + len(q) - common)
                s, j = np.array(shared, np.int64), np.array(joint, np.int64)
                yield pa.RecordBatch.from_arrays([C.column(batch, "a"), C.column(batch, "b"), pa.array(100 * s >= percent * j), pa.array(1 - s / np.maximum(j, 1))], ["a", "b", "linked", "d"])

        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(C.tidy(fn), "a bigint, b bigint, linked boolean, d double")

    def linked(self, close: DataFrame, classes: DataFrame) -> DataFrame:
        """a, b, linked, d of distinct pairs; the sets that no round before has made are made."""
        need = classes.select("class", "doc_id").join(_both(close, "a", "b"), "class")
        if self.sets:
            need = need.join(self.all_sets().select("class"), "class", "left_anti")
        need = self.scratch.write(need, "wanted")
        if not self.sets or not need.isEmpty():
            self.make_sets(need)
        with C.small_batches(self.spark, PAIRS):
            out = self.scratch.write(self.exact(close), "distances")
        self.scratch.drop(need)
        C.forget(self.spark)
        return out

    # -- windows and recursion -------------------------------------------------------------------------------------------

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """Members (doc_id, n, class), and the component of each class that links with another (node, component)."""
        scanned = self.scan()
        members = scanned.where("h is null").select("doc_id", "n", "class", "sketch")
        first = self.regions(self.frequent(scanned))
        ends = _both(first, "pivot", "class")
        classes = self.scratch.write(members.where("class is not null").join(ends, "class").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
        bound = self.scratch.write(self.bounds(first.select(*_pair("pivot", "class")).distinct(), classes), "bounds")
        known = self.linked(bound.where("near").select("a", "b"), classes)
        group = components(known.where("linked").select("a", "b"), self.scratch)
        C.forget(self.spark)
        # large regions of one pivot share most members and become one
        sizes = first.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
        merged = first.join(sizes, "h").select(F.when(F.col("size") > FAN, F.lit(0)).otherwise(F.col("h")).alias("region"), "pivot", "class").distinct()
        merged = self.scratch.write(self.comparable(merged, classes), "members")
        far = known.select("a", "b", F.col("d").alias("lo"), F.col("d").alias("hi")).unionByName(bound.where("not near").select("a", "b", "lo", F.lit(1.0).alias("hi")))
        region = merged.withColumns({"a": F.least("pivot", "class"), "b": F.greatest("pivot", "class")}).join(far, ["a", "b"]).select("region", "pivot", "class", "lo", "hi", F.lit(False).alias("done"))
        fan = FIRST
        while True:
            region = self.settle(region, group)
            if region.isEmpty():
                break
            pairs, marked = self.round(region, known, classes, fan)
            fan *= 8
            if pairs.isEmpty():
                region = marked
                continue
            fresh = self.linked(pairs, classes)
            group = self.joined(group, fresh.where("linked").select("a", "b"))
            known, region = known.unionByName(fresh), marked
            self.scratch.drop(pairs)
        self.scratch.drop(first, bound, merged, *self.sets)
        return members.select("doc_id", "n", "class"), group

    def joined(self, group: DataFrame, links: DataFrame) -> DataFrame:
        """``group`` with more links: components are what is joined, so that only new links move."""
        side = lambda k: group.select(F.col("node").alias(k), F.col("component").alias(f"_{k}"))
        over = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a != b").distinct()
        over = self.scratch.write(over, "over")
        more = components(over, self.scratch).select(F.col("node").alias("component"), F.col("component").alias("to"))
        nodes = group.unionByName(_both(links, "a", "b").select(F.col("class").alias("node"), F.col("class").alias("component")).join(group.select("node"), "node", "left_anti"))
        out = self.scratch.write(nodes.join(more, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "groups")
        self.scratch.drop(over)
        C.forget(self.spark)
        return out

    def comparable(self, region: DataFrame, classes: DataFrame) -> DataFrame:
        """Members of small regions go if no other member but the pivot has a size that fits theirs: what a link needs."""
        sized = region.where("region != 0").join(classes.select("class", "n"), "class")
        by_size = Window.partitionBy("region", "pivot").orderBy("n", "class")
        near = sized.withColumns({"_before": F.lag("n").over(by_size), "_behind": F.lead("n").over(by_size)}).where(f"{self.fits('n', '_before')} or {self.fits('n', '_behind')}")
        return near.select(*region.columns).unionByName(region.where("region = 0"))

    def settle(self, region: DataFrame, group: DataFrame) -> DataFrame:
        """Rows of regions with something to settle, with ``comp``, ``live`` (a member not connected with the pivot and never a pivot itself) and how many of these are open."""
        side = lambda k, v: group.select(F.col("node").alias(k), F.col("component").alias(v))
        at = region.select("region", "pivot", "class", "lo", "hi", "done").join(side("class", "_c"), "class", "left").join(side("pivot", "_p"), "pivot", "left")
        at = at.withColumn("comp", F.coalesce("_c", "class")).withColumn("live", ~F.col("done") & (F.col("comp") != F.coalesce("_p", "pivot")))
        state = at.groupBy("region", "pivot").agg(F.count("*").alias("members"), F.count_if("live").alias("open"), F.min(F.when(F.col("live"), F.col("lo"))).alias("nearest"))
        # what lies nearer to the pivot than any open member's window reaches can't link with one
        kept = at.join(state.where("open > 0 and members > 1"), ["region", "pivot"]).where(F.col("hi") >= F.col("nearest") - self.radius - 1e-9)
        return self.scratch.write(kept.select("region", "pivot", "class", "lo", "hi", "done", "comp", "live", "open"), "settled")

    def round(self, region: DataFrame, known: DataFrame, classes: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
        """Pairs of ``fan`` pivots in each region with the members in their windows, as far as they may link; the region with those pivots done."""
        least = region.where("live").groupBy("region", "pivot").agg(F.min("class").alias("least"))
        share = F.pmod(F.xxhash64("class", F.lit(fan)), F.lit(1 << 20)) * F.col("open") < F.lit(fan << 20)
        told = region.join(least, ["region", "pivot"], "left").withColumn("now", F.col("live") & (share | (F.col("class") == F.col("least")))).drop("least")
        chosen = told.where("now").select("region", "pivot", F.col("class").alias("q"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"), F.col("comp").alias("qcomp"))
        sized = classes.select("class", "n", "sketch")
        x = told.where("not done").select("region", "pivot", "class", "lo", "hi", "comp", "now").join(sized, "class")
        q = chosen.join(sized.select(F.col("class").alias("q"), F.col("n").alias("qn"), F.col("sketch").alias("qsketch")), "q")
        slack = self.radius + 1e-9
        # two pivots of one round meet once
        window = f"comp != qcomp and (not now or class < q) and lo <= qhi + {slack} and qlo <= hi + {slack} and {self.fits('n', 'qn')} and {self.close('n', 'qn', apart('sketch', 'qsketch'))}"
        met = x.alias("x").join(q.alias("q"), (F.col("x.region") == F.col("q.region")) & (F.col("x.pivot") == F.col("q.pivot")) & F.expr(window))
        pairs = met.select(*_pair("q", "class")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        return self.scratch.write(pairs, "pairs"), told.withColumn("done", F.col("done") | F.col("now")).drop("now")


def components(links: DataFrame, scratch: C.Scratch | None = None) -> DataFrame:
    """node, component (the smallest node reachable) for all ends of ``links`` (a, b): labels spread to neighbours and then
    jump to their label's label, until nothing changes. Every round is a written table."""
    scratch = scratch or C.Scratch(links.sparkSession, "components")
    edge = scratch.write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = scratch.write(edge.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c"), F.lit(True).alias("moved")), "labels")
    while not label.where("moved").isEmpty():
        was = label.select("a", "c")
        told = edge.join(was.select(F.col("a").alias("b"), "c"), "b").select("a", "c", F.lit(False).alias("own"))
        spread = told.unionByName(was.withColumn("own", F.lit(True))).groupBy("a").agg(F.min("c").alias("m"), F.min(F.when(F.col("own"), F.col("c"))).alias("was"))
        jumped = spread.join(was.select(F.col("a").alias("m"), F.col("c").alias("cc")), "m", "left").select("a", F.least("m", "cc").alias("c"), "was")
        new = scratch.write(jumped.select("a", "c", (F.col("c") != F.col("was")).alias("moved")), "labels")
        scratch.drop(label)
        label = new
    scratch.drop(edge)
    return label.select(F.col("a").alias("node"), F.col("c").alias("component"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, class, component_id (the smallest id reachable by links, its own included).

    ``docs`` is read several times, so it must be a table or a view of one. A component of rows with null ids alone has a null id.
    """
    run = Join(docs, doc_id, text, width, percent)
    members, component = run.groups()
    joined = members.join(component, members["class"] == component["node"], "left").withColumn("c", F.coalesce("component", "class")).drop("node", "component")
    least = run.scratch.write(joined.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least")), "least")
    return joined.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), "class", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each component, and all that link with nothing (rows without id too).

    Of rows with one id all stay if any does. Other columns pass through. Texts aren't shuffled but for those that go, and the few that a map of
    fixed size takes for them.
    """
    found = join(docs, doc_id, text, **options).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = C.written(found.where("not stays").select(F.col("doc_id").alias(doc_id)), "gone")
    flag = C.fresh(docs, "_maybe")
    told = C.may_be(docs, doc_id, gone, flag)
    return told.where(~F.col(flag)).drop(flag).unionByName(told.where(flag).drop(flag).join(gone, doc_id, "left_anti").select(*[f"`{c}`" for c in docs.columns]))


def brute_force(texts: list[str | None], width: int = 5, percent: int = 75) -> list[tuple[int, int]]:
    """(set size, index of the component's first text) of each text, from all pairs. For tests."""
    import re
    from collections import Counter

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, common in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]
