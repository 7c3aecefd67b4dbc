"""Media columns: baseline JPEG. Markers are parsed, scans Huffman-decoded, and the DC values of the luminance component
form a thumbnail of one pixel for each 8x8 block, in numpy; kept are the dimensions and hashes of the thumbnail.

``encode_payload`` stores bytes losslessly in this form: byte b becomes one block whose quantised DC value is b - 128
(quantiser 8, all AC values 0), so that the thumbnail is the payload. Its Huffman tables give category c of a DC
difference a code of 9 - c bits, so a difference and its bits take 9 bits always; with the 1-bit end of block every
block takes 10, and both directions are plain array arithmetic. ``thumbnail`` sees from the tables of a file whether
that holds; any other baseline scan (grey or colour, subsampled, with AC values and restarts) is decoded bit by bit.

A frame has 64 blocks a row and at most 8,191 rows; longer payloads take several images, one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import columnar as C

ROW, ROWS = 64, 8191
SOI, EOI, SOS, DQT, DHT, SOF0, DRI = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC0, 0xDD


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The 10 bits of a block for each difference -255..255 (at +255), and the difference for each 10 bits (-999: none)."""
    bits, back = np.zeros(511, np.uint16), np.full(1024, -999, np.int16)
    code = 0
    for cat in range(8, -1, -1):  # lengths 1, 2, ... 9: codes 0, 10, 110, ...
        length = 9 - cat
        span = [0] if cat == 0 else [*range(-(1 << cat) + 1, -(1 << (cat - 1)) + 1), *range(1 << (cat - 1), 1 << cat)]
        for d in span:
            extra = d if d >= 0 else d + (1 << cat) - 1
            value = ((code << cat) | extra) << 1  # then the end of block, a 0
            bits[d + 255], back[value] = value, d
        code = (code + 1) << 1
        assert length + cat == 9
    return bits, back


BITS, BACK = _codes()
QUANT = _segment(DQT, bytes([0]) + bytes([8] + [1] * 63))
DC_TABLE = _segment(DHT, bytes([0x00] + [1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
AC_TABLE = _segment(DHT, bytes([0x10, 1] + [0] * 15) + bytes([0]))
SCAN = _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_payload(payload: bytes) -> bytes:
    """Baseline JPEG image(s) whose DC thumbnail is ``payload`` (a positive multiple of 64 bytes)."""
    data = np.frombuffer(payload, np.uint8)
    if not len(data) or len(data) % ROW:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    out = []
    for at in range(0, len(data), ROW * ROWS):
        part = data[at : at + ROW * ROWS].astype(np.int16)
        diff = np.diff(part, prepend=np.int16(128))
        word = BITS[diff + 255].reshape(-1, 4).astype(np.uint64)
        packed = (word[:, 0] << 30) | (word[:, 1] << 20) | (word[:, 2] << 10) | word[:, 3]
        scan = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\x00")
        rows = len(part) // ROW
        frame = _segment(SOF0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0]))
        out += [b"\xff\xd8", QUANT, frame, DC_TABLE, AC_TABLE, SCAN, scan, b"\xff\xd9"]
    return b"".join(out)


class Image:
    """Parsed markers of one baseline image; ``end`` is the offset behind it."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant, self.huff, self.restart, self.scans = {}, {}, 0, []
        self.width = self.height = 0
        i = at + 2
        while True:
            if i + 2 > len(data) or data[i] != 0xFF:
                raise ValueError("no marker where one is due")
            marker = data[i + 1]
            if marker == 0xFF:
                i += 1
                continue
            if marker == EOI:
                self.end = i + 2
                return
            (length,) = struct.unpack_from(">H", data, i + 2)
            body, i = data[i + 4 : i + 2 + length], i + 2 + length
            if marker == DQT:
                while body:
                    wide, size = body[0] >> 4, 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                    body = body[1 + size :]
            elif marker == DHT:
                while body:
                    n = sum(body[1:17])
                    self.huff[body[0]] = (tuple(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("samples of 8 bits only")
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a baseline image")
            elif marker == DRI:
                (self.restart,) = struct.unpack(">H", body[:2])
            elif marker == SOS:
                own = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                stop = i
                while True:  # to the next marker that isn't a stuffed byte or a restart
                    stop = data.find(b"\xff", stop)
                    if stop < 0 or stop + 1 >= len(data):
                        raise ValueError("a scan without end")
                    if data[stop + 1] and not 0xD0 <= data[stop + 1] <= 0xD7:
                        break
                    stop += 2
                self.scans.append((own, data[i:stop]))
                i = stop

    def lookup(self, key: int) -> np.ndarray:
        """For each 16 bits that may follow: symbol and code length of the table, as symbol * 32 + length (0: none)."""
        counts, symbols = self.huff[key]
        out, code, k = np.zeros(1 << 16, np.int32), 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                lo = code << (16 - length)
                out[lo : lo + (1 << (16 - length))] = symbols[k] * 32 + length
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def luminance(self) -> np.ndarray:
        """The DC thumbnail of the first component: rows of values 0..255."""
        first = self.parts[0]
        own, scan = next(s for s in self.scans if any(c[0] == first[0] for c in s[0]))
        blocks = (-(-self.height // 8), -(-self.width // 8))
        plain = len(self.parts) == 1 and not self.restart and self.huff.get(own[0][2] | 16) == ((1, *[0] * 15), b"\x00") and self.huff.get(own[0][1]) == ((*[1] * 9, *[0] * 7), bytes(range(8, -1, -1)))
        n = blocks[0] * blocks[1]
        if plain and n % 4 == 0:
            raw = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)[: n // 4 * 5].reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, 3:] = raw
            word = wide.view(">u8").ravel().astype(np.uint64)
            tens = np.stack([(word >> s) & 1023 for s in (np.uint64(30), np.uint64(20), np.uint64(10), np.uint64(0))], 1).ravel()
            dc = np.cumsum(BACK[tens.astype(np.int64)], dtype=np.int64).reshape(blocks)
        else:
            dc = self._slow(own, scan)[: blocks[0], : blocks[1]]
        return np.clip(np.floor(dc * self.quant[first[3]][0] / 8 + 128.5), 0, 255).astype(np.uint8)

    def _slow(self, own: list, scan: bytes) -> np.ndarray:
        """DC values of the first component, block by block, from any baseline scan."""
        parts = {p[0]: p for p in self.parts}
        hmax, vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        alone = len(own) == 1
        if alone:
            p = parts[own[0][0]]
            across, down = -(-(-(-self.width * p[1] // hmax)) // 8), -(-(-(-self.height * p[2] // vmax)) // 8)
            units = [(own[0], 0, 0)]
            step = (1, 1)
        else:
            across, down = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
            units = [(c, y, x) for c in own for y in range(parts[c[0]][2]) for x in range(parts[c[0]][1])]
            step = (parts[self.parts[0][0]][2], parts[self.parts[0][0]][1])
        tables = {k: self.lookup(k) for c in own for k in (c[1], c[2] | 16)}
        out = np.zeros((down * step[0], across * step[1]), np.int64)
        pieces, at = [], 0
        while True:  # cut at restarts
            nxt = scan.find(b"\xff", at)
            while nxt >= 0 and scan[nxt + 1] == 0:
                nxt = scan.find(b"\xff", nxt + 2)
            pieces.append(scan[at:nxt] if nxt >= 0 else scan[at:])
            if nxt < 0:
                break
            at = nxt + 2
        unit, target = 0, self.parts[0][0]
        for piece in pieces:
            bits = int.from_bytes(piece.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, "big")
            left = (len(piece.replace(b"\xff\x00", b"\xff")) + 8) * 8
            before = dict.fromkeys(parts, 0)
            size = self.restart or across * down

            def take(n: int) -> int:
                nonlocal left
                left -= n
                return (bits >> left) & ((1 << n) - 1)

            def symbol(table: np.ndarray) -> int:
                nonlocal left
                found = int(table[(bits >> (left - 16)) & 0xFFFF])
                if not found:
                    raise ValueError("bits that no code has")
                left -= found & 31
                return found >> 5

            for _ in range(min(size, across * down - unit)):
                for c, y, x in units:
                    cat = symbol(tables[c[1]])
                    v = take(cat) if cat else 0
                    before[c[0]] += v if not cat or v >> (cat - 1) else v - (1 << cat) + 1
                    if c[0] == target:
                        out[(unit // across) * step[0] + y, (unit % across) * step[1] + x] = before[c[0]]
                    k = 1
                    while k < 64:
                        rs = symbol(tables[c[2] | 16])
                        if rs == 0:
                            break
                        k += (rs >> 4) + 1
                        if rs & 15:
                            take(rs & 15)
                unit += 1
        return out


def images(data: bytes) -> list[Image]:
    out, at = [], 0
    while at < len(data):
        out.append(Image(data, at))
        at = out[-1].end
    return out


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: whether, in a 8 x 9 mean reduction of the thumbnail, each value is below its right neighbour."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 10).astype(int)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], thumb.shape[0] - 1), np.maximum(rows[1:], np.minimum(rows[:-1], thumb.shape[0] - 1) + 1)
    c0, c1 = np.minimum(cols[:-1], thumb.shape[1] - 1), np.maximum(cols[1:], np.minimum(cols[:-1], thumb.shape[1] - 1) + 1)
    total = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    mean = total / np.outer(r1 - r0, c1 - c0)
    return int("".join("01"[int(b)] for b in (mean[:, :-1] < mean[:, 1:]).ravel()), 2)


def storer(text: str = "text", media: str = "media") -> C.Step:
    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        out, sizes = [], []
        for value in C.column(batch, text):
            b = value.as_buffer().to_pybytes() if value.is_valid else b""
            sizes.append(len(b))
            out.append(encode_payload(b + bytes(max(ROW, -(-len(b) // ROW) * ROW) - len(b))))
        return [pa.array(sizes, pa.int64()), pa.array(out, pa.binary())]

    return C.Step(fn, {"n_bytes": "bigint", media: "binary"})


ADDED = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "width": "int", "height": "int", "images": "int", "feature": "string"}
ARROW = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}


def reader(media: str = "media") -> C.Step:
    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(ADDED)
        try:
            found = images(data)
            thumbs = [i.luminance() for i in found]
            payload = b"".join(t.tobytes() for t in thumbs)
            wide = max(t.shape[1] for t in thumbs)
            whole = thumbs[0] if len(thumbs) == 1 else np.vstack([np.pad(t, ((0, 0), (0, wide - t.shape[1]))) for t in thumbs])
            width, height = max(i.width for i in found), sum(i.height for i in found)
        except (ValueError, KeyError, IndexError, struct.error, StopIteration):
            return (None,) * len(ADDED)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), width, height, len(found), f"{width}x{height}x{len(found)}:{difference_hash(whole):016x}")

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [one(v.as_buffer().to_pybytes() if v.is_valid else None) for v in C.column(batch, media)]
        return [pa.array([r[k] for r in rows], ARROW[kind]) for k, kind in enumerate(ADDED.values())]

    return C.Step(fn, ADDED, (media,))


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the media column: UTF-8 of the text (null: empty), zero bytes up to a positive multiple of 64, as JPEG. Adds ``n_bytes`` too, the length before that."""
    return C.apply(df, text, storer(text, media))


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the media column (dropped) and adds what ADDED lists. Null or unreadable media: all of them null.

    ``feature``: width, total height and number of images, difference hash of their thumbnails, one below the other. Equal media, equal values.
    """
    return C.apply(df, media, reader(media))
