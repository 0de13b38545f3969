"""Stable hashes used for ordering and for keying texts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


def _digests(texts: pa.Array, size: int) -> pa.Array:
    return pa.array(
        [None if t is None else hashlib.blake2b(t.encode(), digest_size=size).hexdigest() for t in texts.to_pylist()],
        pa.string(),
    )


@arrow_udf(StringType())
def _blake8(texts: pa.Array) -> pa.Array:
    return _digests(texts, 8)


@arrow_udf(StringType())
def _blake12(texts: pa.Array) -> pa.Array:
    return _digests(texts, 12)


def stable_hash(*parts, algorithm: str = "blake2b") -> Column:
    """Hex digest of the tab-joined parts; text order equals unsigned integer order.

    ``sha256`` stays in the JVM; ``blake2b`` (8 bytes) runs as an Arrow function.
    """
    joined = F.concat_ws("\t", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    if algorithm == "sha256":
        return F.sha2(joined, 256)
    if algorithm == "blake2b":
        return _blake8(joined)
    raise ValueError(f"unknown hash {algorithm!r}")


def text_key(text: Column, algorithm: str = "blake2b") -> Column:
    """Key of a text in the vector cache (12-byte digest, hex)."""
    return F.sha2(text, 256) if algorithm == "sha256" else _blake12(text)


def hash_slice(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits: ``16 ** digits`` even, order-preserving slices of a digest."""
    return F.substring(digest, 1, digits)


def hash_fraction(digest: Column) -> Column:
    """Position of a digest in [0, 1), monotone in the digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
