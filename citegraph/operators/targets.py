"""Target sets: a seed's own citers, or the citers of its successor on a hash cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from .ranking import cyclic_successor, dense_index


def donors(seed_ids: DataFrame, algorithm: str = "blake2b") -> DataFrame:
    """(seed_id, donor_id); every seed receives the next seed in hash order."""
    hashed = seed_ids.select("seed_id").distinct().withColumn(
        "h", stable_hash("shuffle", F.col("seed_id"), algorithm=algorithm)
    )
    return cyclic_successor(hashed, "seed_id", "h")


def target_citers(pairs: DataFrame, mode: str, algorithm: str = "blake2b") -> DataFrame:
    """Pairs of the mode. ``shuffled`` leaves out donors' citers that also cite the seed."""
    if mode == "own":
        return pairs
    if mode != "shuffled":
        raise ValueError(f"unknown target mode {mode!r}")
    moved = pairs.withColumnRenamed("seed_id", "donor_id").join(donors(pairs, algorithm), "donor_id")
    # A cycle of a single seed has no donor; the check runs with the query, not before it.
    lone = F.raise_error(F.lit("shuffled targets need at least two seeds")).cast("boolean")
    moved = moved.where(F.when(F.col("donor_id") == F.col("seed_id"), lone).otherwise(True))
    own = pairs.select("seed_id", "citer_id")
    return (
        moved.join(own, ["seed_id", "citer_id"], "left_anti")
        .select("seed_id", *[c for c in pairs.columns if c != "seed_id"])
    )


def common_seeds(generations: DataFrame, condition: str = "condition", seed: str = "seed_id") -> DataFrame:
    """Seeds present in every condition.

    Distinct (condition, seed) pairs are counted per seed, so a seed with very many rows
    collapses before the shuffle.
    """
    present = generations.select(condition, seed).distinct()
    total = present.agg(F.count_distinct(condition)).scalar()
    return present.groupBy(seed).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == total).select(seed)


def shard_of(df: DataFrame, order: str, n_shards: int) -> DataFrame:
    """Round-robin shard number by ascending id."""
    return dense_index(df, order).withColumn("shard", F.pmod("row_index", F.lit(n_shards)).cast("int")).drop("n_rows")


def evenly_spread(ids: DataFrame, order: str, wanted: int) -> DataFrame:
    """every (n div wanted)-th id of the ascending order, ``wanted`` of them at most."""
    step = F.greatest(F.floor(F.col("n_rows") / wanted), F.lit(1))
    kept = (F.pmod("row_index", step) == 0) & (F.floor(F.col("row_index") / step) < wanted)
    return dense_index(ids, order).where((F.col("n_rows") <= wanted) | kept).drop("row_index", "n_rows")


def random_other(index: Column, n_rows: Column, *key: Column, seed: int = 0) -> Column:
    """Index of a pseudo-random other row, never the row itself.

    A hash of the pair's key stands in for a sequential generator, so the draw does not
    depend on row order or partitioning.
    """
    draw = F.conv(F.substring(stable_hash(F.lit(seed), *key, algorithm="sha256"), 1, 8), 16, 10).cast("long")
    return F.pmod(index + F.pmod(draw, n_rows - 1) + 1, n_rows)
