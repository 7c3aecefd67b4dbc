"""Digest columns that the registered queries derive from operators' outputs."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa

from . import columnar as C


def digest(source: str, name: str, kind: str) -> C.Step:
    """Adds ``name``: the sha256 (lower-case hex) or crc32 (unsigned) of a binary column, which goes. Null gives null."""
    make = {"sha256": lambda b: hashlib.sha256(b).hexdigest(), "crc32": zlib.crc32}[kind]

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([make(v.as_buffer()) if v.is_valid else None for v in C.column(batch, source)], pa.string() if kind == "sha256" else pa.int64())]

    return C.Step(fn, {name: "string" if kind == "sha256" else "bigint"}, (source,))
