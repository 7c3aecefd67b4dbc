"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``encode`` gives the ids of each text and where each id lies in it, in bytes and in characters; ``decode``
reverses the byte-to-character table of the vocabulary and puts characters that were split over several ids
together again.

Speed comes from one fact about the pattern of the vocabulary: a single space or line end between two
characters that aren't white space always begins a new match. Texts are cut there, every distinct piece is
encoded once by the library, and the ids of a text are gathered from those of its pieces with numpy. Pieces are
found by their hashes, so the ids' bytes are compared with the text's; where they differ the text is encoded whole. The
result is the same as encoding the whole text (tested against it). Texts with other white space, or with two
separators in a row, are encoded whole.

Nulls encode as empty texts. Texts without tokens have no ids. Copies have equal results. Other columns pass
through in ``encode`` and ``decode``; an input column that bears the name of an output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import columnar as C

#: Slots of a worker's store of pieces (a power of two), and the ids that it may hold before it starts anew.
SLOTS, POOL = 1 << 20, 1 << 25

#: Bytes of text that ``encode`` works on at a time: its arrays of words are many times as large.
SLICE = 1 << 18

#: White space other than space and line end: ASCII, and the UTF-8 forms of the rest (some that look alike to Python count too).
ODD_SPACE = bytes([0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)])
WIDE_SPACE = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in vocabularies of this kind: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One worker's encoder. special_as_text: the strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        with open(path, encoding="utf-8") as f:
            self.tok = Tokenizer.from_str(f.read())
        self.tok.encode_special_tokens = special_as_text
        # The same model where pieces that are one match each come parted by line ends, spelled in the byte alphabet.
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = CharDelimiterSplit("\n")
        self.spell = {b: c for c, b in byte_table().items()} | {10: "\n"}
        self.bytes = id_bytes(path)
        self.marks = {m: self.tok.encode(m, add_special_tokens=False).ids[0] for m in ".,\n"}
        self.special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        """Direct-mapped: a slot holds the piece that came last. key: hash of the piece's bytes and what stands before it."""
        self.key, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.begin, self.count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only (each one match of the pattern), and how many each has."""
        lead = " " if kind else ""
        spelled = (lead + ("\n" + lead).join(words)).encode().decode("latin-1").translate(self.spell)
        flat = np.array(self.bare.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.int64)
        word_ends = np.cumsum(np.fromiter(map(len, spelled.split("\n")), np.int64, len(words)))
        upto = np.searchsorted(np.cumsum(self.bytes.len[flat]), word_ends) + 1
        return flat, np.diff(upto, prepend=0)

    def _pieces(self, pieces: list[str], lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space and how many each has. lead: 0 nothing before it, 1 a space, 2 a line end."""
        core = [p.rstrip(".,") for p in pieces]
        marked = np.fromiter(map(len, pieces), np.int64, len(pieces)) - np.fromiter(map(len, core), np.int64, len(pieces))
        word = np.fromiter(map(str.isalpha, core), bool, len(pieces)) & (marked <= 1)
        n, lens = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        runs = []
        for spaced in (False, True):
            own = np.flatnonzero(word & ((lead == 1) == spaced))
            if len(own):
                flat, n[own] = self._letters([core[j] for j in own], int(spaced))
                runs.append((own, flat))
        other = np.flatnonzero(~word)
        got = self._whole([("", " ", "\n")[lead[k]] + pieces[k] for k in other]) if len(other) else []
        lens[word] = (n + marked + (lead == 2))[word]
        lens[other] = [len(g) for g in got]
        at = np.cumsum(lens) - lens
        out = np.zeros(int(lens.sum()), np.int64)
        out[at[word & (lead == 2)]] = self.marks["\n"]
        for own, flat in runs:
            out[C.ranges(at[own] + (lead[own] == 2), n[own])] = flat
        end = np.flatnonzero(word & (marked == 1))
        out[at[end] + lens[end] - 1] = [self.marks[pieces[k][-1]] for k in end]
        if len(other):
            out[C.ranges(at[other], lens[other])] = np.fromiter((t for g in got for t in g), np.int64)
        return out, lens

    def _store(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), 2 * len(ids)), self.pool.dtype)])
        at, self.used = self.used, self.used + len(ids)
        self.pool[at : self.used] = ids
        return at

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose only white space are single spaces and line ends."""
        apart = C.byte_class(b" \n")[data]
        edge = np.flatnonzero(np.diff(apart, prepend=np.int8(1)))
        starts, ends = edge[::2], edge[1::2]
        first = np.searchsorted(starts, off)
        before = data[np.maximum(starts - 1, 0)]
        lead = np.where(before == 10, 2, 1)
        opening = starts == np.repeat(off[:-1], np.diff(first))
        lead[opening] = 0
        key = C.span_hashes(data, starts, ends) ^ (lead.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        size = (ends - starts).astype(np.int32)
        begin, count = self.begin[slot], self.count[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != key) | (self.size[slot] != size))
        if len(miss):
            _, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            own = miss[one]
            text = data.tobytes()
            for i in range(0, len(own), 1 << 14):
                part = own[i : i + (1 << 14)]
                ids, lens = self._pieces([text[a:b].decode() for a, b in zip(starts[part].tolist(), ends[part].tolist())], lead[part])
                at = self._store(ids) + np.cumsum(lens) - lens
                begin[part], count[part] = at, lens
                s = slot[part]
                # of pieces that share a slot the last one stays, in all four arrays alike
                self.key[s], self.size[s], self.begin[s], self.count[s] = key[part], size[part], at, lens
            begin[miss], count[miss] = begin[own][back], count[own][back]
        flat = self.pool[C.ranges(begin, count)].astype(np.uint32)
        total = np.concatenate([[0], np.cumsum(count)])
        return self._verified(data, off, flat, total[first])

    def _verified(self, data: np.ndarray, off: np.ndarray, flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose bytes they spell; texts that a piece of another spelling got into are encoded whole."""
        made, upto = self.bytes.join(flat), np.concatenate([[0], np.cumsum(self.bytes.len[flat])])[cuts]
        own = np.ones(len(data), bool)
        own[off[1:] - 1] = False
        want, at = data[own], off - np.arange(len(off))
        if np.array_equal(upto, at) and np.array_equal(made, want):
            return flat, cuts
        bad = [i for i in range(len(at) - 1) if not np.array_equal(made[upto[i] : upto[i + 1]], want[at[i] : at[i + 1]])]
        ids = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i, got in zip(bad, self._whole([want[at[i] : at[i + 1]].tobytes().decode() for i in bad])):
            ids[i] = np.array(got, np.uint32)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(i) for i in ids])])

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their offsets. Null: as an empty text."""
        if self.used > POOL:
            self._reset()
        data, off = C.raw(strings)
        n = len(strings)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        apart = C.byte_class(b" \n")[data]
        bad = C.byte_class(ODD_SPACE)[data] != 0
        bad[1:] |= (apart[1:] & apart[:-1]) != 0
        lead = np.flatnonzero(C.byte_class(b"\xc2\xe1\xe2\xe3")[data[:-2]]) if len(data) > 2 else np.zeros(0, np.int64)
        if len(lead):
            three = (data[lead].astype(np.uint32) << 16) | (data[lead + 1].astype(np.uint32) << 8) | data[lead + 2]
            wide = [int.from_bytes(w, "big") for w in WIDE_SPACE if len(w) == 3]
            bad[lead[np.isin(three, wide) | np.isin(three >> 8, [int.from_bytes(w, "big") for w in WIDE_SPACE if len(w) == 2])]] = True
        if self.special:
            bad |= (data == ord("|")) | (data == ord("<"))
        odd = np.add.reduceat(bad, off[:-1], dtype=np.int64) > 0
        odd |= apart[off[:-1]] != 0  # a text that is empty or begins with a separator
        if not odd.any():
            return self._plain(data, off)
        keep = np.flatnonzero(~odd)
        flat, cuts = self._plain(*C.raw(strings.take(pa.array(keep)))) if len(keep) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        got = self._whole([t or "" for t in strings.take(pa.array(np.flatnonzero(odd))).to_pylist()])
        lens = np.zeros(n, np.int64)
        lens[keep], lens[odd] = np.diff(cuts), [len(g) for g in got]
        off = np.concatenate([[0], np.cumsum(lens)])
        out = np.zeros(off[-1], np.uint32)
        out[C.ranges(off[:-1][keep], lens[keep])] = flat
        out[C.ranges(off[:-1][odd], lens[odd])] = np.fromiter((t for g in got for t in g), np.uint32)
        return out, off


class Bytes:
    """Bytes of every id, as one array with offsets, for gathering."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table, size = byte_table(), 0
        vocab = spec["model"]["vocab"]
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = added[i] if i in added else bytes(table[c] for c in token)
        for i, token in added.items():
            tokens[i] = token
        self.len = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.len)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.data[C.ranges(self.at[ids], self.len[ids])]


_CACHE: dict = {}
C.STORES.append(_CACHE)


def codec(path: str, special_as_text: bool = True) -> Codec:
    key = (path, special_as_text)
    if key not in _CACHE:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CACHE[key] = Codec(path, special_as_text)
    return _CACHE[key]


def id_bytes(path: str) -> Bytes:
    if ("bytes", path) not in _CACHE:
        _CACHE["bytes", path] = Bytes(path)
    return _CACHE["bytes", path]


def _binary(flat: np.ndarray, offsets: np.ndarray, width: int) -> pa.Array:
    off = offsets.astype(np.int64) * width
    if off[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
    raise ValueError("a slice of more than 2 GiB of ids")


def char_starts(text: np.ndarray) -> np.ndarray:
    """For each byte offset (and the end) the index of the character that begins at or holds it."""
    begins = (text & 0xC0) != 0x80
    out = np.zeros(len(text) + 1, np.int64)
    out[:-1] = np.cumsum(begins) - 1
    out[-1] = out[-2] + 1 if len(text) else 0
    return out


def encoder(text: str = "text", path: str | None = None, special_as_text: bool = True, offsets: bool = False) -> C.Step:
    path = path or vocabulary_path("byte_bpe_50k.json")

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        strings = C.column(batch, text)
        flat, off = codec(path, special_as_text).encode(strings)
        cols = [_binary(flat, off, 4), pa.array(np.diff(off))]
        if offsets:
            data, at = C.raw(strings, "")
            lens = id_bytes(path).len[flat]
            begins = np.cumsum(lens) - lens
            chars = char_starts(data)
            inside = (data[begins] & 0xC0) == 0x80 if len(flat) else np.zeros(0, bool)
            each = np.diff(off)
            cols += [C.list_column(begins - np.repeat(at[:-1], each), off, pa.int64()), C.list_column(chars[begins] - np.repeat(chars[at[:-1]], each), off, pa.int64()), C.list_column(inside, off, pa.bool_())]
        return cols

    return C.Step(fn, {"ids": "binary", "n_tokens": "bigint"} | ({"byte_start": "array<bigint>", "char_start": "array<bigint>", "split": "array<boolean>"} if offsets else {}))


def decoder(ids: str = "ids", path: str | None = None, raw: bool = False) -> C.Step:
    path = path or vocabulary_path("byte_bpe_50k.json")

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        tokens = id_bytes(path)
        out = [tokens.join(np.frombuffer(v.as_buffer(), np.uint32)).tobytes() if v.is_valid else None for v in C.column(batch, ids)]
        return [pa.array(out, pa.binary()) if raw else pa.array([None if b is None else b.decode("utf-8", "replace") for b in out], pa.string())]

    return C.Step(fn, {"decoded": "binary" if raw else "string"})


def encode(df: DataFrame, **options) -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit integers as binary) and ``n_tokens``.

    offsets=True also adds ``byte_start`` and ``char_start`` (arrays: where each id begins; one that begins inside
    a character counts as that character) and ``split`` (ids that begin inside a character). Options: see encoder.
    """
    return C.apply(df, options.get("text", "text"), encoder(**options), limit=SLICE)


def decode(df: DataFrame, **options) -> DataFrame:
    """Adds ``decoded``: the text (raw=True: the bytes) of ``ids``. Null ids give null.

    Characters whose bytes were split over ids come out whole; bytes that form no character (ids cut in the
    middle of one) become U+FFFD in the text and stay as they are in the bytes. Options: see decoder.
    """
    return C.apply(df, options.get("ids", "ids"), decoder(**options))
