"""Phrase collocations against brute force and SQL: marks, overlaps, ties, nulls, long texts, several blocks, slots that many share."""

import random

import duckdb
import numpy as np
import pytest

from gustfield.llm import collocations
from gustfield.llm.queries import ORACLES, QUERIES


def texts():
    r = random.Random(3)
    names = [f"w{i}" for i in range(30)] + ["ÉTÉ", "été", "x" * 70, "a-b", "it's", "Zug"]
    say = lambda n: "".join(r.choice(names[: r.choice([4, 10, 36])]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?"]) for _ in range(n))
    rows = [(say(r.randrange(1, 120)), r.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(160)]
    rows += [("New York City Hall stands. new york city", "en")] * 31 + [("the the the the the the", "de")] * 10 + [("uno dos\ntres cuatro", "es")] * 30
    return rows + [(None, "en"), ("", "de"), (" \t ", None), ("...!", "fr"), (say(9000), "en"), ("one\x0btwo\x0cthree four five", "de")] * 2


ROWS = texts()
SCHEMA = "doc_id long, text string, lang string, n long, key long, a int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("phrases"))
    df = spark.createDataFrame([(i, t, lang, 1, 2, 3) for i, (t, lang) in enumerate(ROWS)], SCHEMA)
    df.repartition(3).write.parquet(f"{d}/full/documents.parquet")
    df.where("false").write.parquet(f"{d}/none/documents.parquet")
    return d


def rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_brute_force_and_sql(spark, folder):
    got = rows(QUERIES["op13_collocations"](spark, f"{folder}/full"))
    want = sorted(collocations.brute_force(ROWS))
    assert got == want and len(want) > 70 and len({w[0] for w in want}) > 3
    assert ("es", 1, "tres cuatro", 30, 30, 30, 120, 1_000_000) in want or ("es", 2, "uno dos", 30, 30, 30, 120, 1_000_000) in want
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/full/documents.parquet/*.parquet'")
    assert sorted(con.sql(f"select lang, rank, phrase, a, l, r, n, score from ({ORACLES['op13_collocations']})").fetchall()) == want


def test_empty(spark, folder):
    assert QUERIES["op13_collocations"](spark, f"{folder}/none").count() == 0


def test_blocks_shared_slots_and_cut_lists(spark, folder, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 150)
    monkeypatch.setattr(collocations, "SLOT_BITS", {1: 17, 2: 16, 3: 16, 4: 16})
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    assert rows(collocations.phrases(docs, least=4, top=7, percent=50)) == sorted(collocations.brute_force(ROWS, least=4, top=7, percent=50))


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)
    keys = np.unique(keys)
    block = collocations.Block(keys, ~keys)
    slots = block.find(keys, ~keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (block.find(keys + np.uint64(1), ~keys) == -1).all() or (block.find(keys[:9] ^ np.uint64(1 << 40), ~keys[:9] ^ np.uint64(3)) == -1).all()
    empty = collocations.Block(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    assert (empty.find(keys[:3], keys[:3]) == -1).all()
    with pytest.raises(ValueError, match="equal keys"):
        collocations.PerfectHash(np.array([5, 5], np.uint64))


def test_vocabulary(spark):
    docs = spark.createDataFrame([("one two six, ONE", "en"), ("two", None)] * 30, "text string, lang string")
    run = collocations.Mining(docs, "text", "lang", 30)
    assert sorted((r.lang, r.word, r.f) for r in run.vocabulary().collect()) == [("en", "one", 60), ("en", "six", 30), ("en", "two", 30), ("und", "two", 30)]


def test_passes_do_not_follow_the_number_of_phrases(spark, folder, monkeypatch):
    passes, mapped = [], collocations.Mining.mapped
    monkeypatch.setattr(collocations, "BLOCK", 20)
    monkeypatch.setattr(collocations.Mining, "mapped", lambda self, *a: passes.append(1) or mapped(self, *a))
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    assert rows(collocations.phrases(docs, least=3)) == sorted(collocations.brute_force(ROWS, least=3))
    assert len(passes) == 3


@pytest.mark.parametrize("bits", [17, 32])
def test_numbers_that_fill_two_columns(spark, folder, monkeypatch, bits):
    monkeypatch.setattr(collocations, "number_bits", lambda words: bits)
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    assert rows(collocations.phrases(docs, least=4)) == sorted(collocations.brute_force(ROWS, least=4))
