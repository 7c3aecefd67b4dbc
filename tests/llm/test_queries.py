"""The first ten registered queries on a table with nulls, empty and long texts, repeats and clashing columns: contract columns, digests, SQL."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfield.llm import decontaminate, jaccard, ngram_scores, secrets, substrings
from gustfield.llm.queries import ORACLES, QUERIES

from .test_operators import letters, near_copies, odd_texts, reference, words

COLUMNS = {
    "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op2_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op3_media_jpeg": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_bit_packing": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_lm_scores": ["doc_id", "n_tokens", "score"],
}
HEX = hashlib.sha256(b"x").hexdigest()
TEXTS = odd_texts() + near_copies(3, 5) + [letters("xx", s, 40) for s in range(15)] + [letters("yy", s, 40) for s in range(15)] + [f"key secret = '{HEX}' AKIA{'B2' * 8} end {HEX[:20]}", "x " + words(3, 40) + " y"]
ITEMS = {10: words(3, 30), 9: "the same", 8: None, 7: "...", 6: "the same"}
DOC = "doc_id long, text string, lang string, source string, n_chars long, _row long, cover string, _t string, _a int, spans string, items string"


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("queries"))
    rows = [(i, t, ("xx" if i % 2 else "yy") if i < 25 else "xx" if i < 40 else "yy", "s", len(t or ""), 1, "c", "t", 2, "s", "i") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, DOC).coalesce(2).write.parquet(f"{d}/full/documents.parquet")
    spark.createDataFrame(rows, DOC).where("false").write.parquet(f"{d}/none/documents.parquet")
    for part in ("full", "none"):
        spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").coalesce(1).write.parquet(f"{d}/{part}/benchmark.parquet")
        spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/{part}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: {r.doc_id: r for r in QUERIES[name](spark, f"{folder}/full").collect()} for name in COLUMNS}


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("name", COLUMNS)
def test_rows_and_columns(results, name):
    got = results[name]
    assert sorted(got) == list(range(len(TEXTS)))
    assert set(COLUMNS[name]) <= set(got[0].asDict())


@pytest.mark.parametrize("name", COLUMNS)
def test_empty_documents(spark, folder, name):
    got = QUERIES[name](spark, f"{folder}/none")
    assert got.count() == 0 and set(COLUMNS[name]) <= set(got.columns)


def test_digests(results):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    packed, start = reference(False), 0
    near, cut = jaccard.brute_force(TEXTS), substrings.brute_force(TEXTS)
    leaks, scores = decontaminate.brute_force(TEXTS, ITEMS), ngram_scores.brute_force(TEXTS, reference(True), 50257)
    for i, text in enumerate(TEXTS):
        t, row = text or "", {k: v[i] for k, v in results.items()}
        r = row["op1_substring_dedup"]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (*cut[i][:2], sha(cut[i][2].encode()))
        assert (row["op2_jaccard_join"].n_shingles, row["op2_jaccard_join"].component_id) == near[i]
        data = t.encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = row["op3_media_jpeg"]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        ids = tik(t)
        r = row["op5_byte_bpe"]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(data))
        ids = packed(t) + [2]
        r = row["op7_bit_packing"]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        r, (n, hit, items) = row["op8_decontamination"], leaks[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)
        assert r.items_sha256 == sha(",".join(sorted(map(str, items))).encode())
        r, base = row["op9_secrets"], secrets.brute_force(text)
        assert r.base_sha256 == sha(base.encode()) and [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in base.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base.split(",")) for k in ("assign", "access", "hex"))
        n, seen, score = scores[i]
        assert row["op10_lm_scores"].n_tokens == n and row["op10_lm_scores"].score == (None if score is None else pytest.approx(score, abs=1e-9))


def test_held_out_rows_and_predictions(results):
    for i, text in enumerate(TEXTS):
        tox, lang = results["op4_toxicity"][i], results["op6_language"][i]
        assert tox.held_out == (remainder(i, 3) == 1) and lang.held_out == (remainder(i, 4) == 2)
        assert 0 <= tox.score <= 1 and tox.predicted == int(tox.score >= 0.7) and 0 <= lang.score <= 1
        assert (lang.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    same = [i for i, t in enumerate(TEXTS) if t == TEXTS[7]]
    assert len(same) > 2
    for name, rows in results.items():
        if name not in ("op7_bit_packing", "op10_lm_scores"):
            copies = {tuple(v for k, v in rows[i].asDict().items() if k not in ("doc_id", "held_out")) for i in same}
            assert len(copies) == 1, name


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(COLUMNS)))  # others have tests of their own
def test_same_as_sql(results, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{os.path.join(folder, 'full', t + '.parquet')}/*.parquet'")
    want = con.sql(ORACLES[name])
    got = [tuple(r[c] for c in want.columns) for r in results[name].values()]
    assert sorted(got) == sorted(want.fetchall())


def test_operators_keep_columns_with_inner_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet").withColumns({c: F.lit("mine") for c in ("_block", "_base", "_more", "_c", "_maybe", "_h")})
    inner = [c for c in docs.columns if c not in ("spans", "items", "n_chars")]
    mine = docs.select(*inner).orderBy("doc_id").collect()
    ratios = secrets.train(docs)
    for got in (substrings.remove_repeats(docs), secrets.scan(docs, ratios), ngram_scores.score(docs), decontaminate.search(docs, spark.read.parquet(f"{folder}/full/benchmark.parquet"))):
        assert got.select(*inner).orderBy("doc_id").collect() == mine
    assert set(jaccard.keep_one(docs).columns) == set(docs.columns)
