"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text, and which of them
makes the windows of a text shorter.

Texts are lower-cased and the first letters of words written as capitals, so that a match tells where in a word it
lies. Both dictionaries are trained by zstandard: the ordinary one on windows of ordinary training texts, the toxic one on
windows of toxic training texts. Most of a toxic text is ordinary, so that its windows are chosen: those around words whose
beginnings stand in toxic training texts far more often than in ordinary ones (by the words before them, so that copies count once).
Compression sees the toxic dictionary with the ordinary one behind it, so that ordinary text costs the same with both.
A window of a text is about ``window`` bytes cut at white space. The gain of a window is the ordinary length less the toxic
length; the largest gains of a text go through a logistic curve that was fitted on training rows which the dictionaries haven't seen.

All is learned from a bounded sample of labelled rows (``sample_docs`` toxic rows and four times as many others, chosen
by a hash of the id). Null and empty texts score as texts without gain. Null labels aren't learned from. With rows of
one label only, or where no beginning of words tells, the score is 0.5 everywhere. Copies have equal scores. Whole texts are scored; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C

WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
HEAD = re.compile(rb"(?<![^\x00-\x40\x5B-\x60\x7B-\x7F])[^\x00-\x40\x5B-\x60\x7B-\x7F]{1,4}")
WINDOW, DICT_BYTES, LEVEL, TOP = 48, 1 << 13, 9, 4
#: Size of the toxic dictionary at most, and of the segments and strings that its training counts: words are short.
TOXIC_BYTES, TOXIC_SEGMENT, TOXIC_STRING = 1 << 13, 24, 6
#: A beginning of words tells if its odds of toxic text are this high and it stands behind so many different words, as a share of the toxic documents.
ODDS, SHARE, LENGTHS = 12, 0.02, range(4, 9)


def form(text: str | None) -> bytes:
    return HEAD.sub(lambda m: m[0].upper(), (text or "").lower().encode())


def contexts(texts: list[bytes]) -> set[tuple[bytes, bytes]]:
    """Words with the one before; what copies and near copies share counts once."""
    out: set[tuple[bytes, bytes]] = set()
    for t in texts:
        words = WORD.findall(t)
        out.update(zip([b"", *words], words))
    return out


def cut(data: bytes, window: int = WINDOW) -> list[bytes]:
    """Windows of about ``window`` bytes, cut behind white space; a longer word makes a longer window."""
    out, at = [], 0
    while at < len(data):
        to = at + window
        if to < len(data):
            space = max(data.rfind(b" ", at, to), data.rfind(b"\n", at, to))
            if space <= at:
                ahead = [x for x in (data.find(b" ", to), data.find(b"\n", to)) if x >= 0]
                space = min(ahead) if ahead else len(data) - 1
            to = space + 1
        out.append(data[at:to])
        at = to
    return out


def _trained(samples: list[bytes], size: int, k: int = 64, d: int = 8) -> bytes:
    """Content of a trained dictionary; with too few samples to train on, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstd.ZstdError:
        return b" ".join(samples)[-size:]


class Model:
    def __init__(self, toxic: list[str], ordinary: list[str]):
        hold = lambda t: zlib.crc32(t.encode()) % 4 == 3  # noqa: E731  for the curve only
        sides = [[form(t) for t in ts if not hold(t)] for ts in (toxic, ordinary)]
        both = [contexts(s) for s in sides]
        said = Counter(w[:n] for _, w in both[0] for n in LENGTHS if len(w) >= n)
        least = max(3, SHARE * len(sides[0]))
        said = {p: n for p, n in said.items() if n >= least}
        plain_said = Counter(w[:n] for _, w in both[1] for n in LENGTHS if w[:n] in said and len(w) >= n)
        telling: list[bytes] = []
        for p in sorted(said, key=lambda p: (len(p), p)):
            odds = (said[p] + 0.5) / (len(both[0]) + 1) * (len(both[1]) + 1) / (plain_said[p] + 0.5)
            if odds >= ODDS and not p.startswith(tuple(telling)):
                telling.append(p)
        samples = [w for t in sides[1] for w in cut(t, 256)]
        self.plain = _trained(samples, DICT_BYTES) if samples else b""
        chosen = [t[max(0, w.start() - 1) : w.end() + 1] for t in sides[0] for w in WORD.finditer(t) if w[0].startswith(tuple(telling))]
        self.toxic = (_trained(chosen, TOXIC_BYTES, TOXIC_SEGMENT, TOXIC_STRING) if chosen else b"") + self.plain
        self.curve = None
        self._ready()
        rows = [(t, 1) for t in toxic if hold(t)] + [(t, 0) for t in ordinary if hold(t)]
        if toxic and ordinary and telling:
            if len({y for _, y in rows}) < 2:
                rows = [(t, 1) for t in toxic] + [(t, 0) for t in ordinary]
            x = np.array([self.features(form(t)) for t, _ in rows])
            y = np.array([y for _, y in rows], float)
            self.curve = logistic(x, y)

    def _ready(self) -> None:
        def make(content: bytes) -> zstd.ZstdCompressor:
            how = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if held:
                held.precompute_compress(compression_params=how)
            return zstd.ZstdCompressor(dict_data=held, compression_params=how)

        self.a, self.b = make(self.plain), make(self.toxic)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("a", "b")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def features(self, data: bytes) -> list[float]:
        """The TOP largest window gains, and the mean gain."""
        a, b = self.a.compress, self.b.compress
        gains = sorted((len(a(w)) - len(b(w)) for w in cut(data)), reverse=True)
        return [*(gains + [0] * TOP)[:TOP], sum(gains) / len(gains) if gains else 0.0]

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.5
        mean, scale, w = self.curve
        x = (np.array(self.features(form(text))) - mean) / scale
        return float(1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple:
    """Ridge logistic regression by Newton steps; the rarer class weighs more, by a power of its odds."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    weight = np.where(y == 1, ((len(y) - y.sum()) / max(y.sum(), 1)) ** 0.75, 1.0)
    w, penalty = np.zeros(z.shape[1]), ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-6 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = 1500) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` that ``labels`` marks 0 or 1 (by ``doc_id``; of several labels the highest holds)."""
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_d")).agg(F.max(label).alias("_y"))
    n = {r[0]: r[1] for r in own.groupBy("_y").count().toLocalIterator()}
    share = F.when(F.col("_y") == 1, min(1.0, sample_docs / max(n.get(1, 0), 1))).otherwise(min(1.0, 4 * sample_docs / max(n.get(0, 0), 1)))
    chosen_ids = own.where(F.pmod(F.xxhash64("_d"), F.lit(1 << 40)) < share * float(1 << 40))
    rows = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).join(F.broadcast(chosen_ids), "_d").select("_t", "_y")
    sides: tuple[set, set] = (set(), set())
    for r in rows.toLocalIterator():
        sides[r["_y"] == 1].add(r["_t"])
    return Model(sorted(sides[1] - sides[0]), sorted(sides[0]))


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold); columns of these names are replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = [held.value.score(t) for t in C.column(batch, text).to_pylist()]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]

    return C.apply(df, text, C.Step(fn, {"score": "double", "predicted": "int"}))
