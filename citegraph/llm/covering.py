"""SimHash near-duplicates by covering locality-sensitive hashing.

1. Each whole text gives a 64-bit fingerprint: the majority of the XXH64 hashes of its four-word shingles, bit by bit.
2. Masks. Bit i of a span of bits gets a number m(i) in 1 .. 2**(radius + 1) - 1, odd ones dealt first. Mask v, for every v of the same
   range, keeps the bits i for which m(i) and v have an odd number of common bits. The numbers of at most ``radius`` differing
   bits span less than the whole space, so some v is orthogonal to all of them: its mask hides every difference, and each
   pair within the radius shares its masked value in that table. The guarantee holds for all pairs, not with a probability.
3. Distinct fingerprints with the same masked value meet in one task, where each is linked to the set it belongs to. A bucket
   above ``BUCKET`` goes on instead: the bits its mask hides get masks of their own, which covers the same pairs again. After
   three levels a mask hides at most 8 of 64 bits, so a bucket cannot hold more than 256 fingerprints, whatever the data.
4. Links go to distributed components, and documents take the smallest id of their fingerprint's component. Fingerprints that
   many documents share are settled by a broadcast whose rows their share bounds; no join has a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, keyed, materialise, table, unkeyed
from .groups import components, merge_labels, whole_groups

SHINGLE = 4
RADIUS = 4
BITS = 64
SEED = 42
BUCKET = 1024
LEVELS = 3
# Share of all documents from which a fingerprint counts as frequent; its inverse bounds the broadcast rows.
FREQUENT = 0.005
_CHUNK = 16_384
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingle_hashes(text: str, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, repeats included, in bounded pieces; a text of fewer words is one shingle."""
    # Without an argument bytes are split at the space and the five controls from tab to carriage return, as the contract wants.
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    width = min(width, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        pieces = zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])
        yield np.array([digest(joined[a:b], SEED) for a, b in pieces], np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number; zero without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (doc_id, fp) of all rows."""
    rows, kind = keyed(docs, id_col, text_col)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": np.array([fingerprint(t, width) for t in frame["text"]], np.int64)})

    return unkeyed(rows.mapInPandas(batches, "doc_id string, fp long"), kind)


def signed(mask: int) -> int:
    return mask - 2**BITS if mask >= 2**(BITS - 1) else mask


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits``: for any choice of at most ``radius`` of them some mask has none of the choice."""
    top = 2**(radius + 1)
    # Odd numbers first: of a span of up to 2**radius bits every mask but one keeps half.
    order = [*range(1, top, 2), *range(2, top, 2)]
    number = {b: order[k % len(order)] for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (number[b] & v).bit_count() % 2) for v in range(1, top)]


def hidden(mask: int) -> list[int]:
    return [b for b in range(BITS) if not mask >> b & 1]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` joined with the masks that cover the bits it hides."""
    return [mask | finer for finer in covering_masks(hidden(mask), radius)]


def buckets(rows: DataFrame) -> DataFrame:
    """Adds ``members`` to rows (mask, fp): how many share mask and masked value. Rows alone in their bucket go."""
    keyed_rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    size = keyed_rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # Spark takes rows behind an explode for as large as those before it, and would broadcast all of them.
    return keyed_rows.join(size.hint("merge"), ["mask", "key"])


def linked(met: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) inside buckets, at most one per fingerprint: the lowest one connected with it there."""
    keys = ["mask", "key"]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            pairs = frame[keys].to_numpy()
            group = np.concatenate([[0], np.cumsum((pairs[1:] != pairs[:-1]).any(1))])
            fp = frame["fp"].to_numpy()
            bits = fp.view(np.uint64)
            label = np.arange(len(fp))
            first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
            # Every member meets the first of its bucket, so a bucket of near copies is one set after one step.
            head = first[group]
            near = np.bitwise_count(bits ^ bits[head]) <= radius
            label[near] = head[near]
            open_ = near.copy()
            open_[first] = False
            # Pairs of a bucket by distance in it; two that are already together need no test.
            for off in range(1, int(np.diff(np.append(first, len(fp))).max())):
                at = np.flatnonzero((group[:-off] == group[off:]) & (label[:-off] != label[off:]))
                if not len(at):
                    if not (group[:-off] == group[off:]).any():
                        break
                    continue
                same = at[np.bitwise_count(bits[at] ^ bits[at + off]) <= radius]
                label = merge_labels(label, same, same + off)
            moved = label != np.arange(len(fp))
            yield pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

    return met.select("mask", "key", "fp").repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(batches, "a long, b long")


def covered_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) that connect every pair of fingerprints within ``radius``."""
    masks = covering_masks(list(range(BITS)), radius)
    met = materialise(buckets(distinct.select(F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"), "fp")))
    links = linked(met.where(F.col("members") <= bucket), radius)
    for _ in range(levels - 1):
        large = met.where(F.col("members") > bucket)
        if large.isEmpty():
            return links.distinct()
        choices = [(signed(m), [signed(f) for f in finer_masks(m, radius)]) for m in masks]
        masks = sorted({f for m in masks for f in finer_masks(m, radius)})
        finer = distinct.sparkSession.createDataFrame(choices, "mask long, finer array<long>")
        # The table of masks has 31 or 961 rows, by construction; a finer bucket is part of one coarse bucket.
        rows = large.join(F.broadcast(finer), "mask").select(F.explode("finer").alias("mask"), "fp").distinct()
        met = materialise(buckets(rows))
        links = links.unionByName(linked(met.where(F.col("members") <= bucket), radius))
    # Masks of the last level hide so few bits that the bits bound their buckets.
    return links.unionByName(linked(met.where(F.col("members") > bucket), radius)).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS,
    bucket: int = BUCKET, frequent: float = FREQUENT,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    ``fingerprint`` is 16 lowercase hexadecimal digits; texts without words, null included, have
    all zeros and link like any other. Fingerprints link at ``radius`` or fewer differing bits;
    ``component_id`` is the smallest doc_id reachable by links, itself included, and null only
    where no reachable row has an id. Rows that repeat are answered one by one, an empty table
    gives no rows, and other columns are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, width))
    per_fp = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = materialise(components(covered_links(per_fp.select("fp"), radius, bucket)))
    member = per_fp.join(joined, per_fp["fp"] == joined["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(member.join(lowest, "root").select("fp", "n", "component_id"))
    total = named.agg(F.sum("n").alias("total"))
    hot = named.join(F.broadcast(total), F.col("n") >= F.col("total") * frequent).select("fp", F.struct("component_id").alias("known"))
    marked = rows.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("known is null").select("doc_id", "fp").join(named.select("fp", "component_id"), "fp")
    answers = marked.where("known is not null").select("doc_id", "fp", "known.component_id").unionByName(rest)
    return answers.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
