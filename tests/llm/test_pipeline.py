"""The stages of the corpus pipeline against brute force, each on what the one before kept."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gustfield.llm import decontaminate, jaccard  # noqa: E402

from .test_operators import letters, near_copies, reference  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    r = random.Random(1)
    texts = [letters("xx", s, 50) for s in range(30)] + [letters("yy", s, 50) for s in range(30)]
    item = letters("xx", 500, 14)
    texts += [texts[3], texts[3] + " lo", letters("xx", 77, 20) + " " + item + " lo", None, "12 34", "mi token=" + "%032x" % r.getrandbits(128) + " ra " + letters("xx", 9, 30)]
    rows = [(i, t, "yy" if 30 <= i < 60 else "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict(enumerate(texts)), {1: item}


def test_stages(spark, folder, tmp_path):
    d, texts, items = folder
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), set(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert ids - set(kept) == {i for i, t in texts.items() if t is None or not any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            order = sorted(ids)
            assert set(kept) == {order[c] for _, c in jaccard.brute_force([texts[i] for i in order])}
        elif name == "decontamination":
            order = sorted(ids)
            assert set(kept) == {i for i, (_, hit, _) in zip(order, decontaminate.brute_force([texts[i] for i in order], items)) if not hit}
        elif name == "secrets":
            assert set(kept) == ids and "[SECRET]" in kept[max(ids)].text and kept[max(ids)].n_chars == len(kept[max(ids)].text)
            assert all(kept[i].text == texts[i] for i in ids - {max(ids)})
            texts = {i: r.text for i, r in kept.items()}
        else:
            enc = reference(True)
            assert all(r.n_tokens == len(enc(texts[i])) for i, r in kept.items())
        ids = set(kept)
    assert corpus_pipeline.run(spark, d).select(F.sort_array(F.collect_list("doc_id"))).first()[0] == sorted(ids)
    assert near_copies(1, 1)
