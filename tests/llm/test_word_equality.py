"""Different words are never taken for equal: Thue-Morse words of 1,024 letters collide under polynomial hashes modulo 2**64 of any odd base."""

import hashlib

import numpy as np
import pytest

from gustfield.llm import bpe, jaccard, ngram_scores, substrings
from gustfield.llm.columnar import span_hashes
from gustfield.llm.queries import QUERIES

from .test_operators import reference, words


def morse(a, b, n=1024):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


ONE, OTHER = morse("a", "b"), morse("b", "a")
LEAD = words(8, 34)
TEXTS = [f"{LEAD} {ONE}", f"{LEAD} {OTHER}", ONE, OTHER, ONE * 3, f"{ONE}{OTHER}{ONE}"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("morse"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def rows(spark, folder, name):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


def test_hashes_differ():
    data = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    a, b = span_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b
    assert (span_hashes(data, np.array([3, 3]), np.array([40, 40])) == span_hashes(data[3:], np.array([0]), np.array([37]))).all()
    assert span_hashes(data, np.array([0]), np.array([9]), 1) != span_hashes(data, np.array([0]), np.array([9]))


def test_substring_dedup(spark, folder):
    got = rows(spark, folder, "op1_substring_dedup")
    for i, (n, gone, kept) in enumerate(substrings.brute_force(TEXTS)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    assert got[0].n_removed == 0


def test_jaccard(spark, folder):
    got = rows(spark, folder, "op2_jaccard_join")
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(TEXTS))] == jaccard.brute_force(TEXTS)
    assert got[3].component_id == 3


def test_encoders(spark, folder):
    got, packed, want = rows(spark, folder, "op5_byte_bpe"), rows(spark, folder, "op7_bit_packing"), reference(True)
    for i, text in enumerate(TEXTS):
        ids = want(text)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert packed[i].n_tokens == len(ids) + 1


def test_lm_scores(spark, folder):
    got = rows(spark, folder, "op10_lm_scores")
    for i, (n, _, score) in enumerate(ngram_scores.brute_force(TEXTS, reference(True), 50257)):
        assert got[i].n_tokens == n and got[i].score == pytest.approx(score, abs=1e-9)


def test_encoder_survives_colliding_keys(monkeypatch):
    """Even where all pieces of one length share a key, ids are those of the text."""
    import pyarrow as pa

    monkeypatch.setattr(bpe.C, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["one two six ten", "", None, "two one ten, six", "alone"]
    flat, off = bpe.Codec(bpe.vocabulary_path("byte_bpe_50k.json")).encode(pa.array(texts))
    want = reference(True)
    assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [want(t or "") for t in texts]
