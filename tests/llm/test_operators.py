"""Each operator against brute force, exact round trips or held-out accuracy, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustfield.llm import bpe, decontaminate, jaccard, language, media, ngram_scores, packing, secrets, substrings, toxicity
from gustfield.llm.columnar import apply

SCHEMA = "doc_id long, text string, source string"


def words(seed, n, of=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(of)}é" if r.random() < 0.1 else f"word{r.randrange(of)}" for _ in range(n))


def odd_texts():
    long = words(99, 4000, 50_000)
    return [None, "", " ", "\n\t ", "a", "the same " * 60, "x\n" * 80, words(1, 120), words(1, 120), words(1, 120) + " " + words(2, 80), words(3, 40) + "\n" + words(1, 120), long, long + " end", "日本語 テスト 😀😀 “quoted” — dash", "it's 's we'll  two  spaces nbsp em \x1c end ", "<|endoftext|> x <|endoftext|>", "　" * 5, "é" * 500, "A" * 3000, words(1, 120)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def reference(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = special
    return lambda x: t.encode(x, add_special_tokens=False).ids


# ---- byte-level BPE

def test_bpe_is_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = odd_texts()
    got = by_id(bpe.decode(bpe.encode(frame(spark, texts), offsets=True)))
    for i, t in enumerate(texts):
        ids = np.frombuffer(got[i].ids, np.uint32).tolist()
        assert ids == want(t or "") and got[i].n_tokens == len(ids) and got[i].decoded == (t or "")
        assert got[i].source == "s"
        for a, c in zip(got[i].byte_start, got[i].char_start):
            assert len((t or "").encode()[:a].decode(errors="ignore")) == c


def test_bpe_split_characters(spark):
    texts = ["😀" * 3 + "ẞ"]
    r = bpe.encode(frame(spark, texts), offsets=True).first()
    assert any(r.split)
    half = spark.createDataFrame([(bytearray(np.frombuffer(r.ids, np.uint32)[:1].tobytes()),), (None,)], "ids binary")
    got = [x.decoded for x in bpe.decode(half).collect()]
    assert got[1] is None and "�" in got[0] or got[0] == "😀"


def test_bpe_replaces_clashing_names_and_takes_empty_tables(spark):
    d = frame(spark, ["a b"]).withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(-1))
    assert bpe.encode(d).first().n_tokens == 2
    assert bpe.decode(bpe.encode(d.where("false"))).count() == 0


# ---- bit packing

@pytest.mark.parametrize("width", [1, 5, 8, 11, 16, 17, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    b = packing.pack(ids, width)
    assert len(b) == -(-width * 1000 // 8)
    assert np.array_equal(packing.unpack(b, width, 0, 1000), ids) and np.array_equal(packing.unpack(b, width, 137, 480), ids[137:480])


def test_packed_files(spark, tmp_path):
    texts = odd_texts()
    d = frame(spark, texts).orderBy(F.desc("doc_id")).union(spark.createDataFrame([(None, "no id", "s"), (5, "again", "s")], SCHEMA))
    out = str(tmp_path / "packed")
    packing.write_packed(d, out, shards=3)
    rows = packing.read_packed(spark, out).orderBy("start").collect()
    enc, at = reference(False), 0
    want = sorted([(-1, "no id"), (5, "again"), *enumerate(texts)], key=lambda x: x[0])
    assert [(-1 if r.doc_id is None else r.doc_id) for r in rows] == [w[0] for w in want]
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
        if r.doc_id is not None and r.doc_id != 5:
            assert np.frombuffer(r.ids, np.uint32).tolist() == enc(texts[r.doc_id] or "") + [2]
    assert packing.random_access(spark, out, 11)[0].tolist() == enc(texts[11]) + [2]
    empty = str(tmp_path / "none")
    packing.write_packed(d.where("false"), empty, shards=2)
    assert packing.read_packed(spark, empty).count() == 0
    assert packing.width_of(50257) == 16 and packing.width_of(2) == 1


# ---- media

def test_media_round_trip(spark):
    texts = odd_texts()
    got = by_id(media.features(media.store(frame(spark, texts))))
    for i, t in enumerate(texts):
        b = (t or "").encode()
        padded = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[7].feature == got[8].feature == got[19].feature and got[7].width == 512


def test_media_long_payload_and_slow_path():
    p = bytes(np.random.default_rng(0).integers(0, 256, 64 * 8192, dtype=np.uint8))
    found = media.images(media.encode_payload(p))
    assert len(found) == 2 and b"".join(i.luminance().tobytes() for i in found) == p
    small = media.images(media.encode_payload(p[:256]))[0]
    assert np.array_equal(np.clip(small._slow(*small.scans[0]) + 128, 0, 255), small.luminance())


def test_media_refuses_what_is_no_image(spark):
    d = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None), (3, bytearray(media.encode_payload(bytes(64))[:-40]))], "doc_id long, media binary")
    assert all(r.feature is None for r in media.features(d).collect())


def test_colour_scan_with_ac_values():
    """A 16 x 16 colour image, 2 x 2 subsampled, with AC values and restarts, written bit by bit."""
    dc, ac = {0: "00", 3: "01", 5: "10"}, {0x00: "0", 0x12: "10"}
    def table(key, codes):
        counts = [0] * 16
        for c in codes.values():
            counts[len(c) - 1] += 1
        return media._segment(media.DHT, bytes([key]) + bytes(counts) + bytes(sorted(codes, key=lambda s: codes[s])))
    lum = [20, 24, 24, 17]
    bits, last = "", 0
    def diff(d):
        cat = abs(d).bit_length()
        return dc[cat] + (f"{d if d > 0 else d + (1 << cat) - 1:0{cat}b}" if cat else "")
    for v in lum:
        bits += diff(v - last) + ac[0x12] + "11" + ac[0x00]
        last = v
    bits += (diff(0) + ac[0x00]) * 2
    bits = bits.ljust(-(-len(bits) // 8) * 8, "1")
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    import struct

    frame_ = media._segment(media.SOF0, struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    sos = media._segment(media.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    data = b"\xff\xd8" + media.QUANT + media._segment(media.DRI, b"\0\1") + frame_ + table(0x00, dc) + table(0x10, ac) + sos + scan + b"\xff\xd9"
    (image,) = media.images(data)
    assert image.luminance().tolist() == [[148, 152], [152, 145]]


# ---- substring deduplication

def test_substrings(spark):
    texts = odd_texts()
    got = by_id(substrings.remove_repeats(frame(spark, texts), width=35))
    for i, (n, gone, kept) in enumerate(substrings.brute_force(texts)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (n, gone, kept), i
    assert got[7].spans == [[0, 120]]


@pytest.mark.parametrize("seed", range(4))
def test_substrings_of_few_words(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice("ab") for _ in range(r.randrange(0, 60))) for _ in range(25)]
    got = by_id(substrings.remove_repeats(frame(spark, texts), width=9))
    assert [(got[i].n_words, got[i].n_removed, got[i].kept) for i in range(25)] == substrings.brute_force(texts, 9)


def test_substrings_equal_ids_and_empty_table(spark):
    t = words(5, 60)
    d = spark.createDataFrame([(1, t, "s"), (1, t, "s"), (1, words(6, 60), "s")], SCHEMA).withColumn("n_words", F.lit("mine"))
    assert sorted(r.n_removed for r in substrings.remove_repeats(d).collect()) == [0, 60, 60]
    assert substrings.remove_repeats(d.where("false")).count() == 0


# ---- Jaccard join

def near_copies(seed, n, of=60):
    r = random.Random(seed)
    base = words(seed, of).split(" ")
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        out.append(" ".join(w))
    return out


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 2)
    texts = odd_texts() + near_copies(11, 25) + near_copies(12, 12) + [words(s, 30) + " " + words(77, 40) for s in range(200, 220)] + ["A b C d", "a B c D"]
    got = by_id(jaccard.join(frame(spark, texts)))
    want = jaccard.brute_force(texts)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    kept = {r.doc_id for r in jaccard.keep_one(frame(spark, texts)).collect()}
    assert kept == {c for _, c in want}


def test_jaccard_of_nothing(spark):
    assert jaccard.join(frame(spark, ["a"]).where("false")).count() == 0
    got = by_id(jaccard.join(frame(spark, [None, "", None])))
    assert [(r.n_shingles, r.component_id) for r in (got[0], got[1], got[2])] == [(0, 0), (0, 1), (0, 2)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in jaccard.components(links).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0


# ---- decontamination

def test_decontamination(spark, monkeypatch):
    items = {1: words(1, 30), 2: "One, two; THREE", 3: None, 4: "...", 5: "", 6: words(3, 12), 7: "word1"}
    texts = odd_texts() + ["zero one two three four", "xx " + words(3, 12).upper() + " yy"]
    b = spark.createDataFrame([(k, v) for k, v in items.items()], "item_id long, text string")
    want = decontaminate.brute_force(texts, items)
    for block in (8 << 20, 150):  # in one block, and in several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        d = frame(spark, texts).withColumn("items", F.lit("mine"))
        got = by_id(decontaminate.search(d, b))
        assert [(got[i].n_words, got[i].n_hit, got[i].items) for i in range(len(texts))] == want
    cut = by_id(decontaminate.removed(frame(spark, texts), b, spans=True))
    assert cut[20].text == "zero  four"
    clean = {r.doc_id for r in decontaminate.removed(frame(spark, texts), b).collect()}
    assert clean == {i for i, w in enumerate(want) if not w[1]}
    assert decontaminate.search(frame(spark, texts), b.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.search(frame(spark, texts).where("false"), b).count() == 0


# ---- secrets

def test_secrets(spark):
    h = hashlib.sha256(b"x").hexdigest()
    token = base64.b64encode(hashlib.sha256(b"y").digest()).decode()
    texts = odd_texts() + [f"PassWord = '{h}' and AKIA{'A1' * 8} ünd {h[:16]}", f"a token=short token:{token} é {token} end", "apikey: abcdefghijkl, api_key=x secret  :  abc", f"{h} {h}{h}", "internationalization_of_configuration_parameters"]
    d = frame(spark, texts)
    ratios = secrets.train(d)
    got = by_id(secrets.scan(d, ratios))
    names = secrets.KINDS
    for i, t in enumerate(texts):
        assert ",".join(f"{names[s.kind]}:{s.start}:{s.end}" for s in got[i].base) == secrets.brute_force(t), i
        assert [s for s in got[i].spans if s.kind < 3] == got[i].base
    assert got[21].n_random == 1 and got[24].n_random == 0
    clean = by_id(secrets.redact(d, ratios))
    assert clean[20].text == "[SECRET]' and [SECRET] ünd [SECRET]" and clean[0].text is None and clean[7].text == texts[7]
    assert secrets.scan(d.where("false"), ratios).count() == 0


# ---- language

def letters(lang, seed, n):
    parts = {"xx": ["lo", "mi", "ra", "te"], "yy": ["krz", "och", "ult", "sk"]}[lang]
    r = random.Random(seed)
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    train = spark.createDataFrame([(letters(lang, s, 60), lang) for lang in ("xx", "yy") for s in range(40)] + [(None, "xx"), ("zz", None)], "text string, lang string")
    model = language.fit(train)
    texts = [letters(lang, s, 20) for lang in ("xx", "yy") for s in range(100, 120)] + [None, "", "123 !! ² ½ Ⅷ ①", "ώωψφ ξζθ ώωψφ ξζθ ώψφ θθθ ωψφωψφ ξξξ ωψφ ώξζ"]
    got = by_id(language.identify(frame(spark, texts).withColumn("score", F.lit("mine")), model))
    assert [got[i].lang_pred for i in range(40)] == ["xx"] * 20 + ["yy"] * 20
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (40, 41, 42))
    assert got[43].rejected and not any(got[i].rejected for i in range(40)) and all(0 <= r.score <= 1 for r in got.values())
    none = language.fit(train.where("false"))
    assert {r.lang_pred for r in language.identify(frame(spark, ["a"]), none).collect()} == {"und"}
    assert language.identify(frame(spark, texts).where("false"), model).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    model = language.Model({"xx": [language.normal(letters("xx", s, 30)) for s in range(20)]})
    alphabet = sorted({ord(c) for s in range(20) for c in language.normal(letters("xx", s, 30))})
    for context in ("lo ", "rat", "zzz"):
        points = np.array([[*map(ord, context), c] for c in alphabet], np.uint64)
        p = sum(np.exp(model._score(row, np.array([3]), 4)[0, 0]) for row in points)
        rest = np.exp(model._score(np.array([*map(ord, context), 0x4E00], np.uint64), np.array([3]), 4)[0, 0])
        assert p + rest == pytest.approx(1.0, abs=1e-4)


# ---- toxicity

def test_toxicity(spark):
    def text(s, bad):
        r = random.Random(s)
        w = ["".join(r.choice(["lo", "mi", "ra", "te", "ku", "san"]) for _ in range(r.randrange(1, 5))) for _ in range(150)]
        for _ in range(3 if bad else 0):
            w[r.randrange(len(w))] = r.choice(["vileness", "grotesque", "scoundrel"])
        return " ".join(w)
    docs = frame(spark, [text(s, s % 4 == 0) for s in range(400)] + [None, ""])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.classify(docs.withColumn("score", F.lit("mine")), model))
    right = sum(got[i].predicted == int(i % 4 == 0) for i in range(300, 400))
    assert right >= 95 and all(0 <= r.score <= 1 for r in got.values()) and got[400].score == got[401].score
    assert {r.score for r in toxicity.classify(docs.limit(2), toxicity.fit(docs, labels.where("toxic = 0"))).collect()} == {0.5}
    assert toxicity.classify(docs.where("false"), model).count() == 0


# ---- LM scores

def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(ngram_scores, "BLOCK", 3000)  # many blocks and ranges
    texts = odd_texts() + near_copies(5, 6)
    assert ngram_scores.score(frame(spark, [None, "", "a"])).where("score is not null").count() == 1  # no document of two ids
    got = by_id(ngram_scores.score(frame(spark, texts).withColumn("n_seen", F.lit("mine"))))
    want = ngram_scores.brute_force(texts, reference(True), 50257)
    for i, (n, seen, score) in enumerate(want):
        assert (got[i].n_tokens, got[i].n_seen) == (n, seen), i
        assert got[i].score == (None if score is None else pytest.approx(score, abs=1e-9))
    assert ngram_scores.score(frame(spark, texts).where("false")).count() == 0


def test_apply_keeps_other_columns(spark):
    assert apply(frame(spark, ["a"]), "text").columns == ["doc_id", "text", "source"]


def test_lm_scores_of_kept_columns_carry_no_text(spark, monkeypatch):
    monkeypatch.setattr(ngram_scores, "BLOCK", 3000)
    texts = [None, "", *(words(k % 30, 30) for k in range(40))]
    df = ngram_scores.score(frame(spark, texts), keep=["doc_id"])
    assert df.columns == ["doc_id", "n_tokens", "n_seen", "score"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "source#" not in plan  # ids are written once; texts aren't read, dealt or encoded again
    got = by_id(df)
    for i, (n, seen, score) in enumerate(ngram_scores.brute_force(texts, reference(True), 50257)):
        assert (got[i].n_tokens, got[i].n_seen, got[i].score) == (n, seen, score if score is None else pytest.approx(score, rel=1e-12))


def test_bpe_encode_works_on_small_slices(spark, monkeypatch):
    limits, inner = [], bpe.C.apply
    monkeypatch.setattr(bpe.C, "apply", lambda *a, limit=None, **k: limits.append(limit or bpe.C.SLICE_BYTES) or inner(*a, limit=limit, **k))
    texts = [words(k, 3000, 9000) for k in range(40)]  # several slices in a batch
    got = by_id(bpe.encode(frame(spark, texts).coalesce(1)))
    assert limits == [bpe.SLICE] and bpe.SLICE <= 1 << 18
    assert all(np.frombuffer(got[i].ids, np.uint32).tolist() == reference(True)(t) for i, t in enumerate(texts))
