"""Deterministic ids of file versions, documents and chunks.

With hash_name "blake3" they are the ids that other tools give the same inputs; with "sha256" the same bytes are hashed by
Spark's own function, without Python.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import LoomError
from .blake3 import blake3, digests

HASHES = ("blake3", "sha256")
#: Between the parts of what a chunk id hashes.
UNIT = "1F"


def little_endian(number: Column) -> Column:
    """The 8 bytes of a long, the lowest first, in hex."""
    digits = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))


def hash_hex(raw: Column, hash_name: str) -> Column:
    """The hash of a binary column, in lowercase hex."""
    if hash_name not in HASHES:
        raise LoomError("invalid input", f"unknown hash: {hash_name}")
    return F.sha2(raw, 256) if hash_name == "sha256" else F.lower(F.hex(blake3(raw)))


def text_hash(text: Column, hash_name: str) -> Column:
    return hash_hex(text.cast("binary"), hash_name)


def file_version_id(path: Column, size: Column, mtime: Column, hash_name: str = "blake3") -> Column:
    return hash_hex(F.concat(path.cast("binary"), F.unhex(little_endian(size)), F.unhex(little_endian(mtime))), hash_name)


def uuid_of(digest_hex: Column) -> Column:
    """The first 16 bytes of a hash, shaped as a random UUID: version 4, variant 10."""
    part = lambda a, n: F.substring(digest_hex, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_ids(path: Column, count: Column, strategy: Column, hash_name: str = "blake3") -> Column:
    """The ids of the chunks 0 to count - 1 of a document, as an array; a shuffle-free source of neighbours' ids, too."""
    if hash_name not in HASHES:
        raise LoomError("invalid input", f"unknown hash: {hash_name}")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    if hash_name == "sha256":
        before, after = F.concat(path.cast("binary"), F.unhex(F.lit(UNIT))), F.concat(F.unhex(F.lit(UNIT)), strategy.cast("binary"))
        hashes = F.transform(numbers, lambda i: hash_hex(F.concat(before, F.unhex(little_endian(i)), after), hash_name))
        return F.transform(hashes, uuid_of)

    @F.arrow_udf("array<string>")
    def ids(paths: pa.Array, counts: pa.Array, strategies: pa.Array) -> pa.Array:
        rows = [(p.encode("utf-8", "surrogatepass"), n or 0, s.encode()) if p is not None and s is not None else (b"", 0, b"") for p, n, s in zip(paths.to_pylist(), counts.to_pylist(), strategies.to_pylist(), strict=True)]
        found = iter(digests([p + b"\x1f" + i.to_bytes(8, "little") + b"\x1f" + s for p, n, s in rows for i in range(n)]))
        return pa.array([[_uuid(next(found)) for _ in range(n)] for _, n, _ in rows], pa.list_(pa.string()))

    return ids(path, count, strategy)


def _uuid(digest: bytes) -> str:
    return str(uuid.UUID(bytes=digest[:16], version=4))
