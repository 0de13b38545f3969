"""A bit set of keys of fixed size, probed where a large table is read.

Keys are hashed to ``BITS`` places, and the places are gathered into buckets of 32,768 bits each. The set has at most
``BITS`` / 32,768 rows and ``BITS`` / 4 bytes, whatever the number of keys, so it is always broadcast. A row whose bit is not
set has no partner and goes at the scan, before any exchange; a set bit may be another key's, so the exact join still follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 2**25
# A bitmap aggregate covers this many places; a word of the probed form holds 32 of them.
BUCKET = 32_768
WORD = 32


def place(key: Column, bits: int = BITS) -> Column:
    """1-based place of a key, as the bitmap functions count."""
    return F.pmod(F.xxhash64(key), F.lit(bits).cast("long")) + 1


def bit_set(keys: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Rows (bucket, words): the set of non-null keys; each word holds 32 places as a whole number."""
    at = place(F.col(name), bits)
    maps = keys.where(F.col(name).isNotNull()).select(
        F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"),
    ).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bytes"))
    # Four bytes are read as one number, the first byte in front.
    word = lambda i: F.conv(F.hex(F.substring("bytes", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    return maps.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(BUCKET // WORD - 1)), word).alias("words"))


def _probed(df: DataFrame, name: str, members: DataFrame, bits: int, how: str) -> tuple[DataFrame, Column]:
    """``df`` joined with the buckets of ``members``, and whether the bit of its key is set (null without a bucket)."""
    at = place(df[name], bits)
    near = members.select(F.col("bucket").alias("_bucket"), F.col("words").alias("_words"))
    position = F.bitmap_bit_position(at).cast("int")
    # Bits are numbered from the low end of each byte, bytes from the high end of the word.
    shift = (3 - (position / 8).cast("int") % 4) * 8 + position % 8
    found = df.join(F.broadcast(near), F.bitmap_bucket_number(at) == near["_bucket"], how)
    bit = F.call_function("shiftright", F.element_at(near["_words"], (position / WORD).cast("int") + 1), shift)
    return found, bit.bitwiseAND(F.lit(1).cast("long")) == 1


def may_contain(df: DataFrame, name: str, members: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose key may be in ``members``, a set built with the same ``bits``; no row with a key in it is lost."""
    found, is_set = _probed(df, name, members, bits, "inner")
    return found.where(is_set).select(*[df[c] for c in df.columns])


def cannot_contain(df: DataFrame, name: str, members: DataFrame, bits: int = BITS) -> DataFrame:
    """All rows of ``df`` that ``may_contain`` leaves out: their key is not in ``members``."""
    found, is_set = _probed(df, name, members, bits, "left")
    return found.where(~F.coalesce(is_set, F.lit(False))).select(*[df[c] for c in df.columns])
