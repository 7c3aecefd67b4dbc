"""Language identification with interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

Texts are lower-cased, everything but letters becomes one space, and a space is put at both ends. The models are fitted
on a bounded sample of labelled rows (``sample_docs`` for each language, chosen by a hash of the text, so that equal
rows are chosen alike on any cluster). The prediction is the language with the lowest cross-entropy a character; what
fits none (above the calibrated threshold of the sample) is rejected.

Null texts and texts without letters are ``und``, score 0. Rows without label, or with null text, aren't learned from.
With nothing to learn from every text is ``und``. Ties go to the first language in order of name. Very short texts
have scores near 1 / languages. Copies have equal results. Whole texts are scored; other columns pass through.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C

ORDER = 4
#: Parts of the sample, each measured by a model of the others for the rejection threshold.
FOLDS = 3
DISCOUNT = 0.75
#: Text bytes that are scored at a time: each character has a row of values.
PIECE = 1 << 18
NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")
MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def normal(text: str | None) -> str:
    """Empty if the text has no letter; signs that only count as numbers (superscripts, fractions, numerals) are none."""
    out = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {out} " if any(map(str.isalpha, out)) else ""


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and their offsets."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return joined, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def grams(points: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the n characters that end at each of ``at``."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = out + (points[at - k] + np.uint64(1)) * MUL[k]
        out ^= out >> np.uint64(29)
    return C.mix(out)


class Model:
    """Log-probabilities of all languages: sorted hashes of n-grams by order, a row of values for each."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        kinds = len(self.langs)
        points = {lang: codes(texts) for lang, texts in samples.items()}
        alphabet = len(np.unique(np.concatenate([p for p, _ in points.values()]))) + 1 if kinds else 1
        self.base = -np.log(alphabet)
        self.keys, self.logp, self.ckeys, self.back = [], [], [], []
        below = None
        for n in range(1, ORDER + 1):
            found = []
            for lang in self.langs:
                p, off = points[lang]
                # positions whose n (and, for continuation counts, n + 1) characters lie in one text
                def ends(width):
                    counts = np.maximum(np.diff(off) - width + 1, 0)
                    return C.ranges(off[:-1] + width - 1, counts)

                if n == ORDER:
                    at = ends(n)
                    gram, first, count = np.unique(grams(p, n, at), return_index=True, return_counts=True)
                    at = at[first]
                else:  # how many different characters come before
                    at = ends(n + 1)
                    _, first = np.unique(grams(p, n + 1, at), return_index=True)
                    at = at[first]
                    gram, first, count = np.unique(grams(p, n, at), return_index=True, return_counts=True)
                    at = at[first]
                context = grams(p, n - 1, at - 1) if n > 1 else np.zeros(len(at), np.uint64)
                lower = grams(p, n - 1, at) if n > 1 else np.zeros(len(at), np.uint64)
                found.append((gram, count, context, lower))
            keys = np.unique(np.concatenate([f[0] for f in found])) if kinds else np.zeros(0, np.uint64)
            ckeys = np.unique(np.concatenate([f[2] for f in found])) if kinds else np.zeros(0, np.uint64)
            logp, back = np.zeros((len(keys), kinds), np.float32), np.zeros((len(ckeys), kinds), np.float32)
            context_of, lower_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for gram, _, context, lower in found:
                context_of[np.searchsorted(keys, gram)], lower_of[np.searchsorted(keys, gram)] = context, lower
            for k, (gram, count, context, _) in enumerate(found):
                c = np.searchsorted(ckeys, context)
                total, different = np.bincount(c, count, len(ckeys)), np.bincount(c, minlength=len(ckeys))
                with np.errstate(divide="ignore", invalid="ignore"):
                    back[:, k] = np.where(total > 0, np.log(DISCOUNT * different / total), 0)
                own = np.zeros(len(keys))
                own[np.searchsorted(keys, gram)] = np.maximum(count - DISCOUNT, 0) / total[c]
                under = np.full(len(keys), self.base) if n == 1 else self._find(lower_of, n - 1)[:, k]
                logp[:, k] = np.log(own + np.exp(back[np.searchsorted(ckeys, context_of), k] + under))
            self.keys.append(keys), self.logp.append(logp), self.ckeys.append(ckeys), self.back.append(back)
        self.limit = np.full(kinds, np.inf)

    def _find(self, gram: np.ndarray, n: int) -> np.ndarray:
        """Rows of order n; n-grams of the training sample only."""
        return self.logp[n - 1][np.searchsorted(self.keys[n - 1], gram)]

    def _score(self, p: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Log-probabilities of the characters at ``at`` after the n - 1 before them."""
        if n == 0:
            return np.full((len(at), len(self.langs)), self.base, np.float32)
        keys = self.keys[n - 1]
        gram = grams(p, n, at)
        where = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        out = self.logp[n - 1][where]
        unseen = np.flatnonzero(keys[where] != gram)
        if len(unseen):
            rest = self._score(p, at[unseen], n - 1)
            context = grams(p, n - 1, at[unseen] - 1) if n > 1 else np.zeros(len(unseen), np.uint64)
            ckeys = self.ckeys[n - 1]
            where = np.minimum(np.searchsorted(ckeys, context), len(ckeys) - 1)
            out[unseen] = rest + np.where((ckeys[where] == context)[:, None], self.back[n - 1][where], 0)
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character (nats) of normalised, non-empty texts in each language, and their lengths."""
        p, off = codes(texts)
        n = np.diff(off) - 1  # the first space isn't predicted
        total = np.zeros((len(texts), len(self.langs)))
        for width in range(2, ORDER + 1):  # the first characters have less before them
            at = off[:-1] + width - 1
            own = np.flatnonzero(at < off[1:])
            if width < ORDER:
                total[own] += self._score(p, at[own], width)
        counts = np.maximum(np.diff(off) - ORDER + 1, 0)
        at = C.ranges(off[:-1] + ORDER - 1, counts)
        if len(at):
            sums = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(self._score(p, at, ORDER), axis=0, dtype=np.float64)])
            upto = np.concatenate([[0], np.cumsum(counts)])
            total += sums[upto[1:]] - sums[upto[:-1]]
        return -total / np.maximum(n, 1)[:, None], n

    def calibrate(self, samples: dict[str, list[str]]) -> None:
        """Rejection threshold by language: the 99.9th percentile of all its sampled texts of 20 characters or more, plus half a nat.

        Each text is measured by a model of the texts of other folds (by hash); those of a language that no other fold has, by this model.
        """
        fold = lambda t: zlib.crc32(t.encode()) % FOLDS
        long = {lang: [t for t in samples[lang] if len(t) >= 20] for lang in self.langs}
        seen: dict[str, list[float]] = {lang: [] for lang in self.langs}
        for f in range(FOLDS):
            other = Model({lang: rest for lang in self.langs if (rest := [t for t in samples[lang] if fold(t) != f])})
            for k, lang in enumerate(other.langs):
                if own := [t for t in long[lang] if fold(t) == f]:
                    seen[lang].extend(other.entropy(own)[0][:, k])
        for k, lang in enumerate(self.langs):
            if own := long[lang]:
                self.limit[k] = np.quantile(seen[lang] or self.entropy(own)[0][:, k], 0.999) + 0.5

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        forms = [normal(t) for t in texts]
        own = [i for i, t in enumerate(forms) if t]
        out = [("und", 0.0, None, True)] * len(texts)
        if own and self.langs:
            h, n = self.entropy([forms[i] for i in own])
            best = h.argmin(1)
            low = h[np.arange(len(own)), best]
            score = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, 60)[:, None]).sum(1)
            for i, b, e, s, length in zip(own, best, low, score, n):
                out[i] = (self.langs[b], float(s), float(e), bool(e > self.limit[b] + 4 / np.sqrt(length)))
        return out


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = 1000) -> Model:
    """Fit on at most about ``sample_docs`` rows of each language (chosen by the hash of the text, all if there are fewer)."""
    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r[0]: r[1] for r in known.groupBy("l").count().toLocalIterator()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) < share * float(1 << 40))
    samples: dict[str, list[str]] = {}
    for r in chosen.toLocalIterator():
        if form := normal(r["t"]):
            samples.setdefault(r["l"], []).append(form)
    samples = {k: sorted(set(v)) for k, v in samples.items()}
    model = Model(samples)
    model.calibrate(samples)
    return model


ADDED = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` (nats a character) and ``rejected``; columns of these names are replaced.

    The model is broadcast: its size follows from the sample bound and the alphabet, not from the table.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = held.value.predict(C.column(batch, text).to_pylist())
        return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.bool_())]

    return C.apply(df, text, C.Step(fn, ADDED), limit=PIECE)
