"""Secret scans in DataFrame functions only: patterns, and two character Markov models compared by log-likelihood ratio.

Base kinds, leftmost and non-overlapping each: ``assign`` (a keyword, a sign, a value of 12 characters or more),
``access`` (AKIA and capitals or digits, 18 or more) and ``hex`` (16 or more digits 0-9a-f). The models add ``random``: runs of
16 or more characters of keys and tokens that are likelier under the model of random strings than under that of
ordinary identifiers, and that no base span touches. Spans are code points, end exclusive.

Labelled samples: random strings are hashes of numbers in hexadecimal and base64; ordinary identifiers are words of
8 to 15 letters or underscores from a bounded sample of the texts (``sample_docs``, chosen by a hash of the text; runs as long
as keys are left out, for they may be secrets) and words that programs are made of. Both are counted with DataFrame operations; the driver gets one table of 64 x 64 counts.

Null texts are empty texts: no spans. Copies have equal results. Rows with the same id are scanned one by one. Whole
texts are scanned; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ["assign", "access", "hex", "random"]

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: A run is random if its log-likelihood ratio in nats reaches both.
LEAST_TOTAL, LEAST_PER_CHAR = 14.0, 0.7

PROGRAM_WORDS = "configuration initialize_connection get_user_by_id max_retry_count default_timeout_seconds application_context response_handler database_connection_string authentication_provider http_request_header".split()


def _rank(char: Column) -> Column:
    """0 for marks, 1..62 for letters and digits."""
    return F.instr(F.lit(SYMBOLS), char)


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of adjacent symbols of the column ``s``."""
    at = strings.where("length(s) > 1").select("s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
    return at.groupBy(_rank_at("i").alias("a"), _rank_at("i + 1").alias("b")).count()


def _rank_at(i: str) -> Column:
    return F.expr(f"instr('{SYMBOLS}', substring(s, {i}, 1))")


def train(docs: DataFrame, text: str = "text", sample_docs: int = 2000, random_strings: int = 2000) -> list[float]:
    """64 x 64 log-likelihood ratios of adjacent symbols (random over ordinary), row by row."""
    spark = docs.sparkSession
    total = docs.count()
    share = min(1.0, sample_docs / total) if total else 1.0
    own = docs.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 40)) < F.lit(share * (1 << 40))))
    words = own.select(F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.col(text), RUN, " "), F.lit("[A-Za-z_]{8,}"), F.lit(0)))).alias("s"))
    words = words.unionByName(spark.range(20).select(F.explode(F.array(*map(F.lit, PROGRAM_WORDS))).alias("s")))
    digest = spark.range(random_strings).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    # in base64 a hash of 32 bytes is wrapped by nothing and ends with one "="
    chance = digest.select(F.explode(F.array("h", F.upper("h"), F.base64(F.unhex("h")), F.translate(F.base64(F.unhex(F.reverse("h"))), "+/=", "-_"))).alias("s"))
    tables = []
    for strings in (chance, words):
        counts = {(r["a"], r["b"]): r["count"] for r in _pairs(strings).toLocalIterator()}
        sums = [sum(counts.get((a, b), 0) for b in range(63)) for a in range(63)]
        alone = [(sum(counts.get((a, b), 0) for a in range(63)) + 0.5) / (sum(sums) + 31.5) for b in range(63)]
        # a symbol's followers, drawn towards how often they follow any
        tables.append([math.log((counts.get((a, b), 0) + 8 * alone[b]) / (sums[a] + 8)) if a < 63 and b < 63 else 0.0 for a in range(64) for b in range(64)])
    return [x - y for x, y in zip(*tables)]


def _found(text: Column, pattern: str) -> Column:
    """Spans of all matches as array<struct<start, end>>: what lies between them gives their places."""
    # evaluated only where the pattern occurs at all
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("between"))
    none = F.lit(None).cast("struct<m:array<string>,between:array<string>>")
    return F.when(text.rlike(pattern), cut).otherwise(none)


NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def _spans(cut: str, kind: int, values: str | None = None, least: int = 0) -> str:
    """SQL of the spans of one kind, from the matches and what lies between; values: an array whose short entries drop a match."""
    start = f"acc.at + length({cut}.between[i])"
    span = f"array(named_struct('start', {start}, 'kind', {kind}, 'end', {start} + length({cut}.m[i])))"
    if values:
        span = f"if(length({values}[i]) >= {least}, {span}, {NO_SPANS})"
    return f"""if({cut} is null, {NO_SPANS}, aggregate(sequence(0, size({cut}.m) - 1), named_struct('at', 0, 'out', {NO_SPANS}),
        (acc, i) -> named_struct('at', {start} + length({cut}.m[i]), 'out', concat(acc.out, {span})), acc -> acc.out))"""


ADDED = ["n_assign", "n_access", "n_hex", "n_random", "base", "spans"]


def scan(df: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """Adds counts of the kinds, ``base`` and ``spans`` (base and random): arrays of (start, kind, end), by start, then kind in the order of KINDS."""
    # the input's columns get names of their own on the way, which nothing here uses
    outer = [c for c in df.columns if c.lower() not in ADDED]
    keep = [f"in{i}" for i in range(len(outer))]
    ratio = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    now = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(outer, keep)], body.alias("_t"))
    now = now.select(*keep, "_t", _found(F.col("_t"), ASSIGN).alias("_a"), _found(F.col("_t"), ACCESS).alias("_k"), _found(F.col("_t"), HEX).alias("_h"), _found(F.col("_t"), RUN).alias("_r"))
    now = now.withColumn("_v", F.when(F.col("_a").isNotNull(), F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2))))
    # log-likelihood ratio of each run: over its symbols, two by two
    now = now.withColumn("_c", F.when(F.col("_r").isNotNull(), F.transform(F.col("_r.m"), lambda m: F.transform(F.split(m, ""), _rank))))
    now = now.withColumn("_l", F.when(F.col("_c").isNotNull(), F.transform("_c", lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(ratio, F.get(c, i - 1) * 64 + F.get(c, i))))))
    now = now.withColumn("_ra", F.expr(_spans("_r", 3)))
    now = now.withColumn("_base", F.expr(f"array_sort(concat({_spans('_a', 0, '_v', 12)}, {_spans('_k', 1)}, {_spans('_h', 2)}))"))
    likely = F.expr(f"filter(_ra, (r, i) -> _l[i] >= {LEAST_TOTAL} and _l[i] >= {LEAST_PER_CHAR} * (r.end - r.start) and not exists(_base, b -> b.start < r.end and r.start < b.end))")
    now = now.withColumn("_more", F.when(F.size("_ra") > 0, likely).otherwise(F.expr(NO_SPANS)))
    count = lambda k, name: F.expr(f"cast(size(filter({name}, x -> x.kind = {k})) as bigint)")
    return now.select(*[F.col(k).alias(c) for c, k in zip(outer, keep)], count(0, "_base").alias("n_assign"), count(1, "_base").alias("n_access"), count(2, "_base").alias("n_hex"), F.size("_more").cast("bigint").alias("n_random"), F.col("_base").alias("base"), F.array_sort(F.concat("_base", "_more")).alias("spans"))


def spelled(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def redact(df: DataFrame, ratios: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span (overlapping ones as one) replaced by ``mark``; texts without spans, null ones too, stay as they are."""
    found = scan(df, ratios, text)
    put = F.expr(f"""if(size(spans) = 0, `{text}`, aggregate(spans, named_struct('at', 0, 'out', ''),
        (acc, x) -> if(x.end <= acc.at, acc, named_struct('at', x.end, 'out', concat(acc.out, if(x.start < acc.at, '', concat(substring(`{text}`, acc.at + 1, x.start - acc.at), '{mark}'))))),
        acc -> concat(acc.out, substring(`{text}`, acc.at + 1))))""")
    return found.withColumn(text, put).select(*[f"`{c}`" for c in df.columns])


def brute_force(text: str | None) -> str:
    """Base spans of one text with Python's re. For tests."""
    import re

    t, out = text or "", []
    for m in re.finditer(ASSIGN.replace("(?i)", ""), t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
