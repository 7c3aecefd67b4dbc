"""Texts without id count in the Jaccard join as any other: as the pivot of a large group, and as the one bridge in one."""

import random

import pyarrow as pa

from gustfield.llm import jaccard


def words(seed, n=200):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def changed(base, *places):
    out = list(base)
    for p in places:
        out[p] = f"changed{p}"
    return " ".join(out)


def keys_of(texts):
    return jaccard.class_keys(*jaccard.shingles(pa.array(texts), 5))


def test_jaccard_null_id_pivot_and_bridge(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 2)
    base = words(1)
    near = [changed(base, 7 * i) for i in range(14)]
    pivot = near[int(keys_of(near).argmin())]
    two = words(2)
    ends = [changed(two, 10, 30, 50, 70, 80 + i) for i in range(6)] + [changed(two, 120, 140, 160, 180, 104 + i) for i in range(6)]
    bridge = " ".join(two)
    alone = words(3)
    apart = [" ".join(alone), changed(alone, 9)]
    texts = [*near, *ends, bridge, *apart, " ".join(words(4))]
    # without the bridge its group falls in two
    assert len({c for _, c in jaccard.brute_force(ends)}) == 2
    nameless = {pivot, bridge, *apart}
    ids = [None if t in nameless else 100 + i for i, t in enumerate(texts)]
    least: dict = {}
    brute = jaccard.brute_force(texts)
    for i, (_, c) in zip(ids, brute):
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    want = {int(k): (i, n, least[c]) for k, i, (n, c) in zip(keys_of(texts), ids, brute)}
    got = jaccard.join(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    assert {r["class"]: (r.doc_id, r.n_shingles, r.component_id) for r in got} == want
