"""Binary rasters: gridded messages (edition 2), tiled float rasters, and a greyscale image writer. Numpy kernels over binary columns."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def bits_at(data: bytes, width: int, count: int) -> np.ndarray:
    """``count`` unsigned integers of ``width`` bits, high bit first."""
    if width == 0:
        return np.zeros(count, np.int64)
    need = -(-width * count // 8)
    if len(data) < need:
        raise ValueError("truncated")
    b = np.unpackbits(np.frombuffer(data, np.uint8, need))[: width * count].reshape(count, width)
    return b.astype(np.int64) @ (np.int64(1) << np.arange(width - 1, -1, -1, dtype=np.int64))


def signed(raw: int, size: int) -> int:
    """Sign and magnitude."""
    top = 1 << (8 * size - 1)
    return -(raw - top) if raw & top else raw


def _i(b: bytes, at: int, size: int, sign: bool = False) -> int:
    v = int.from_bytes(b[at : at + size], "big")
    return signed(v, size) if sign else v


def messages(data: bytes) -> list[dict]:
    """All messages of a file: reference time, lead (minutes), discipline, category, number, level type and value, Lambert grid, values with NaN where the bitmap says so."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"GRIB":
            raise ValueError("not-grib")
        if data[at + 7] != 2:
            raise ValueError("unsupported-edition")
        end = at + int.from_bytes(data[at + 8 : at + 16], "big")
        if end > len(data) or data[end - 4 : end] != b"7777":
            raise ValueError("truncated")
        msg, pos, bitmap = {"discipline": data[at + 6]}, at + 16, None
        while pos < end - 4:
            size, num = _i(data, pos, 4), data[pos + 4]
            if size < 5 or pos + size > end - 4:
                raise ValueError("malformed-section")
            s, pos = data[pos : pos + size], pos + size
            if num == 1:
                y, mo, d, h, mi, se = struct.unpack(">H5B", s[12:19])
                msg["reference"] = pd.Timestamp(y, mo, d, h, mi, se)
            elif num == 3:
                if _i(s, 12, 2) != 30:
                    raise ValueError("unsupported-grid")
                msg |= {"ni": _i(s, 30, 4), "nj": _i(s, 34, 4), "lat1": _i(s, 38, 4, True) / 1e6, "lon1": _i(s, 42, 4) / 1e6, "lad": _i(s, 47, 4, True) / 1e6, "lov": _i(s, 51, 4) / 1e6, "dx": _i(s, 55, 4) / 1e3, "dy": _i(s, 59, 4) / 1e3, "latin1": _i(s, 65, 4, True) / 1e6, "latin2": _i(s, 69, 4, True) / 1e6, "grid_relative": bool(s[46] & 8)}
                if s[64] != 64:
                    raise ValueError("unsupported-scanning")
            elif num == 4:
                if _i(s, 7, 2) != 0:
                    raise ValueError("unsupported-product")
                unit = {0: 1, 1: 60}.get(s[17])
                if unit is None:
                    raise ValueError("unsupported-time-unit")
                msg |= {"category": s[9], "number": s[10], "lead_minutes": _i(s, 18, 4) * unit, "level_type": s[22], "level": _i(s, 24, 4) / 10 ** signed(s[23], 1)}
            elif num == 5:
                msg |= {"points": _i(s, 5, 4), "template": _i(s, 9, 2), "ref": struct.unpack(">f", s[11:15])[0], "e": _i(s, 15, 2, True), "d": _i(s, 17, 2, True), "bits": s[19], "s5": s}
                if msg["template"] not in (0, 2, 3):
                    raise ValueError("unsupported-packing")
            elif num == 6:
                if s[5] not in (0, 255):
                    raise ValueError("unsupported-bitmap")
                bitmap = np.unpackbits(np.frombuffer(s[6:], np.uint8))[: msg["ni"] * msg["nj"]].astype(bool) if s[5] == 0 else None
            elif num == 7:
                raw = _unpacked(s[5:], msg)
                values = msg["ref"] / 10 ** msg["d"] + raw * (2.0 ** msg["e"] / 10 ** msg["d"])
                if bitmap is not None:
                    full = np.full(len(bitmap), np.nan)
                    full[bitmap] = values
                    values = full
                if len(values) != msg["ni"] * msg["nj"]:
                    raise ValueError("malformed-grid")
                out.append({k: v for k, v in msg.items() if k not in ("s5", "points", "template", "ref", "e", "d", "bits")} | {"values": values})
        at = end
    return out


def _unpacked(data: bytes, m: dict) -> np.ndarray:
    """Integers of a data section: simple packing, or groups with an optional spatial difference of second order."""
    n, s = m["points"], m["s5"]
    if m["template"] == 0:
        return bits_at(data, m["bits"], n)
    groups, width0, width_bits, len0, step, last, len_bits = _i(s, 31, 4), s[35], s[36], _i(s, 37, 4), s[41], _i(s, 42, 4), s[46]
    at, head = 0, []
    if m["template"] == 3:
        if s[47] != 2:
            raise ValueError("unsupported-packing")
        size = s[48]
        head = [_i(data, k * size, size, k == 2) for k in range(3)]
        at = 3 * size

    def take(width: int, count: int) -> np.ndarray:
        nonlocal at
        got = bits_at(data[at:], width, count)
        at += -(-width * count // 8)
        return got

    refs, widths = take(m["bits"], groups), take(width_bits, groups) + width0
    lens = take(len_bits, groups) * step + len0
    lens[-1] = last
    if lens.sum() != n:
        raise ValueError("malformed-section")
    bits, pos, out = np.unpackbits(np.frombuffer(data[at:], np.uint8)), 0, []
    for r, w, k in zip(refs, widths, lens):
        if pos + w * k > len(bits):
            raise ValueError("truncated")
        v = bits[pos : pos + w * k].reshape(k, w).astype(np.int64) @ (np.int64(1) << np.arange(w - 1, -1, -1, dtype=np.int64)) if w else np.zeros(k, np.int64)
        out.append(v + r)
        pos += int(w * k)
    x = np.concatenate(out)
    if head:
        x = x + head[2]
        x[:2] = head[:2]
        # undo differences of differences: the first slope is that of the two heads
        slope = np.concatenate([[head[1] - head[0]], x[2:]]).cumsum()
        x = np.concatenate([[head[0]], head[0] + slope.cumsum()])
    return x


MESSAGE = "path string, message int, discipline int, category int, number int, level_type int, level double, reference timestamp, lead_minutes int, i int, j int, value double"


def read_messages(files: DataFrame) -> DataFrame:
    """Cells of all messages of files (path, content: what Spark's binaryFile gives). A file is a row of a task; voids are null."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for k, m in enumerate(messages(bytes(content))):
                    j, i = np.divmod(np.arange(len(m["values"])), m["ni"])
                    yield pd.DataFrame({"path": path, "message": k, "discipline": m["discipline"], "category": m["category"], "number": m["number"], "level_type": m["level_type"], "level": m["level"], "reference": m["reference"], "lead_minutes": m["lead_minutes"], "i": i.astype("int32"), "j": j.astype("int32"), "value": pd.Series(m["values"]).astype(object).where(~np.isnan(m["values"]), None)})

    return files.select("path", "content").mapInPandas(run, MESSAGE)


def lzw(data: bytes) -> bytes:
    """High bit first, codes of 9 to 12 bits that widen one early."""
    bits, have, at, width = 0, 0, 0, 9
    table: list[bytes] = []
    out, before = [], b""
    while True:
        while have < width:
            if at >= len(data):
                return b"".join(out)
            bits, have, at = (bits << 8 | data[at]) & 0xFFFFFFFF, have + 8, at + 1
        code = bits >> (have - width) & ((1 << width) - 1)
        have -= width
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and before:
            now = before + before[:1]
        else:
            raise ValueError("lzw")
        out.append(now)
        if before:
            table.append(before + now[:1])
        before = now
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


class Raster:
    """A tiled raster of one float32 band: classic or big container, either byte order, overviews; tiles plain, LZW or Deflate, predictors 1 to 3."""

    SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
    CODES = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}

    def __init__(self, data: bytes):
        self.data = data
        self.o = {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.o is None:
            raise ValueError("not-tiff")
        magic = self._n("H", 2)
        self.big = magic == 43
        if magic not in (42, 43):
            raise ValueError("not-tiff")
        at, self.levels, seen = (self._n("Q", 8) if self.big else self._n("I", 4)), [], 0
        while at:
            seen += 1
            if seen > 32:
                raise ValueError("tiff-directory")
            tags, at = self._directory(at)
            if not tags.get(254, (0,))[0] & 4:  # masks aside
                self.levels.append(tags)
        base = self.levels[0]
        if base.get(277, (1,))[0] != 1 or base.get(339, (1,))[0] != 3 or base[258][0] != 32:
            raise ValueError("sample-format")
        if 33550 not in base or 33922 not in base:
            raise ValueError("no-georeference")
        sx, sy = base[33550][:2]
        i, j, _, x, y, _ = base[33922][:6]
        self.transform = (x - i * sx, y + j * sy, sx, -sy)
        keys = base.get(34735, (0, 0, 0, 0))
        own = {keys[4 + 4 * k]: keys[7 + 4 * k] for k in range(keys[3])}
        self.epsg = own.get(3072) or own.get(2048)
        if not self.epsg:
            raise ValueError("crs-unknown")
        text = base.get(42113)
        self.nodata = np.float32(text.rstrip(b"\0 ").decode()) if text else None

    def _n(self, code: str, at: int):
        return struct.unpack_from(self.o + code, self.data, at)[0]

    def _directory(self, at: int) -> tuple[dict, int]:
        n, at, entry, wide = (self._n("Q", at), at + 8, 20, "Q") if self.big else (self._n("H", at), at + 2, 12, "I")
        tags = {}
        for k in range(n):
            e = at + k * entry
            tag, kind, count = self._n("H", e), self._n("H", e + 2), self._n(wide, e + 4)
            if kind not in self.CODES:
                continue
            size, slot = self.SIZES[kind] * count, e + (12 if self.big else 8)
            where = slot if size <= (8 if self.big else 4) else self._n(wide, slot)
            raw = self.data[where : where + size]
            tags[tag] = raw if kind == 2 else struct.unpack(f"{self.o}{count}{self.CODES[kind]}", raw)
        return tags, self._n(wide, at + n * entry)

    def size(self, level: int = 0) -> tuple[int, int]:
        return self.levels[level][257][0], self.levels[level][256][0]

    def tile(self, k: int, level: int = 0) -> np.ndarray | None:
        """None for a tile that isn't there; voids are NaN."""
        t = self.levels[level]
        if 324 not in t:
            raise ValueError("not-tiled")
        h, w = t[323][0], t[322][0]
        at, n = t[324][k], t[325][k]
        if not n:
            return None
        raw, how, guess = self.data[at : at + n], t.get(259, (1,))[0], t.get(317, (1,))[0]
        if how in (8, 32946):
            raw = zlib.decompress(raw)
        elif how == 5:
            raw = lzw(raw)
        elif how != 1:
            raise ValueError("compression")
        if len(raw) < h * w * 4:
            raise ValueError("tile-short")
        if guess == 3:  # differences of bytes, then bytes by plane
            b = np.frombuffer(raw, np.uint8, h * w * 4).reshape(h, w * 4).cumsum(1, dtype=np.uint8)
            z = np.ascontiguousarray(b.reshape(h, 4, w).transpose(0, 2, 1)).view(">f4").reshape(h, w)
        elif guess == 2:
            z = np.frombuffer(raw, self.o + "u4", h * w).reshape(h, w).cumsum(1, dtype=np.uint32).view(np.float32)
        elif guess == 1:
            z = np.frombuffer(raw, self.o + "f4", h * w).reshape(h, w)
        else:
            raise ValueError("predictor")
        z = z.astype(np.float32)
        return np.where(z == self.nodata, np.nan, z) if self.nodata is not None else z

    def pick(self, target: float) -> int:
        """The coarsest level that is still as fine as ``target``."""
        full = self.size()[1]
        ok = [k for k in range(len(self.levels)) if self.transform[2] * full / self.size(k)[1] <= target]
        return max(ok, key=lambda k: full / self.size(k)[1]) if ok else 0

    def window(self, row: int, col: int, height: int, width: int, level: int = 0) -> np.ndarray:
        t = self.levels[level]
        th, tw = t[323][0], t[322][0]
        across = -(-self.size(level)[1] // tw)
        out = np.full((height, width), np.nan, np.float32)
        for i in range(row // th, (row + height - 1) // th + 1):
            for j in range(col // tw, (col + width - 1) // tw + 1):
                z = self.tile(i * across + j, level)
                if z is None:
                    continue
                r0, r1, c0, c1 = max(row, i * th), min(row + height, (i + 1) * th), max(col, j * tw), min(col + width, (j + 1) * tw)
                out[r0 - row : r1 - row, c0 - col : c1 - col] = z[r0 - i * th : r1 - i * th, c0 - j * tw : c1 - j * tw]
        return out


def read_rasters(files: DataFrame, level: int = 0) -> DataFrame:
    """Cells (domain = path, row, col, z) of raster files (path, content), tile by tile; voids are null."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                r = Raster(bytes(content))
                h, w = r.size(level)
                th, tw = r.levels[level][323][0], r.levels[level][322][0]
                for y in range(0, h, th):
                    for x in range(0, w, tw):
                        z = r.window(y, x, min(th, h - y), min(tw, w - x), level)
                        i, j = np.mgrid[y : y + z.shape[0], x : x + z.shape[1]]
                        v = z.ravel().astype(float)
                        yield pd.DataFrame({"domain": path, "row": i.ravel().astype("int32"), "col": j.ravel().astype("int32"), "z": pd.Series(v).astype(object).where(~np.isnan(v), None)})

    return files.select("path", "content").mapInPandas(run, "domain string, row int, col int, z double")


def png(image: np.ndarray) -> bytes:
    """8-bit greyscale; every row has the filter whose differences are smallest."""
    h, w = image.shape
    x = image.astype(np.int16)
    left, up = np.pad(x, ((0, 0), (1, 0)))[:, :-1], np.pad(x, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(x, ((1, 0), (1, 0)))[:-1, :-1]
    p = left + up - corner
    pa_, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))
    tried = np.stack([x, x - left, x - up, x - (left + up) // 2, x - paeth]).astype(np.uint8)
    cost = np.abs(tried.astype(np.int8).astype(np.int32)).sum(2)
    best = cost.argmin(0)
    rows = np.concatenate([best[:, None].astype(np.uint8), tried[best, np.arange(h)]], 1)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def images(cells: DataFrame, value: str = "shade_byte") -> DataFrame:
    """(domain, png) of byte-valued cells; a domain is a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.uint8)
        out[pdf["row"], pdf["col"]] = pdf[value].fillna(0)
        return pd.DataFrame({"domain": [pdf["domain"].iloc[0]], "png": [png(out)]})

    return cells.select("domain", "row", "col", value).groupBy("domain").applyInPandas(run, "domain string, png binary")
