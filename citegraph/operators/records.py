"""The benchmark cut and its nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import flat_intents, or_empty
from ..functions.hashing import hash_fraction, stable_hash
from ..params import CutParams
from .pairs import eligible_seeds

CITERS_PER_RECORD = 20_000


def chosen_seeds(eligible: DataFrame, n_seeds: int | None, algorithm: str = "blake2b") -> DataFrame:
    """All eligible seeds, or the first ``n_seeds`` of them in hash order."""
    if n_seeds is None:
        return eligible
    ordered = eligible.withColumn("h", stable_hash("seed", F.col("seed_id"), algorithm=algorithm))
    return ordered.orderBy("h", "seed_id").limit(n_seeds).drop("h")


def cut(pairs: DataFrame, params: CutParams, algorithm: str = "blake2b") -> DataFrame:
    """(seed_id, citer_id, n_citers, h) of the kept pairs.

    ``n_citers`` counts the qualifying citers before any cap; ``h`` orders the citers of
    a seed. Spark cuts each map task to the wanted prefix before the window's shuffle, so
    a capped hot seed never gathers its full citer list.
    """
    seeds = chosen_seeds(eligible_seeds(pairs, params.min_citers), params.n_seeds, algorithm)
    kept = pairs.join(seeds, "seed_id").withColumn(
        "h", stable_hash("citer", F.col("seed_id"), F.col("citer_id"), algorithm=algorithm)
    )
    if params.citers_per_seed is None:
        return kept
    order = Window.partitionBy("seed_id").orderBy("h", "citer_id")
    return (
        kept.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= params.citers_per_seed).drop("rn")
    )


def benchmark_pairs(picked: DataFrame, citers: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per kept pair with the citer payload as a struct."""
    payload = citers.select(
        F.col("corpusid").alias("citer_id"), "acl_id", "title", "abstract", "year", "venue", "citationcount",
        or_empty(F.col("s2fieldsofstudy")).alias("fields"),
    )
    links = edges.select(
        F.col("citedcorpusid").alias("seed_id"), F.col("citingcorpusid").alias("citer_id"),
        F.coalesce("isinfluential", F.lit(False)).alias("isinfluential"),
        flat_intents(F.col("intents")).alias("intents"),
        F.coalesce(F.size("contexts"), F.lit(0)).alias("n_contexts"),
    )
    joined = picked.join(links, ["seed_id", "citer_id"]).join(payload, "citer_id")
    citer = F.struct(
        F.col("citer_id").cast("string").alias("id"), "acl_id", "title", "abstract", "year", "venue",
        "citationcount", "fields", "isinfluential", "intents", "n_contexts",
    )
    return joined.select("seed_id", "citer_id", "n_citers", "h", citer.alias("citer"))


def part_of(per_record: int):
    """Even stretch of the hash order a citer falls into; 0 for seeds that fit one record."""
    n_parts = F.ceil(F.col("n_citers") / per_record)
    return F.floor(hash_fraction(F.col("h")) * n_parts).cast("int")


def benchmark_records(
    pairs: DataFrame, seeds: DataFrame, per_record: int = CITERS_PER_RECORD
) -> DataFrame:
    """Nested records in ascending seed id, citers in hash order.

    A seed with more than ``per_record`` citers is written as several records (``part`` 0,
    1, ...), each holding one even stretch of the hash order, so no group is gathered
    whole. All other seeds have exactly one record.
    """
    parted = pairs.withColumn("part", part_of(per_record))
    nested = parted.groupBy("seed_id", "part").agg(
        F.first("n_citers").alias("n_citers_qualifying"),
        F.array_sort(F.collect_list(F.struct("h", "citer_id", "citer"))).alias("ordered"),
    )
    seed_part = seeds.select(
        F.col("corpusid").alias("seed_id"), "acl_id", F.col("title").alias("seed_title"),
        F.col("abstract").alias("seed_abstract"), or_empty(F.col("authors")).alias("seed_authors"),
        F.col("year").alias("seed_year"), F.col("venue").alias("seed_venue"),
        F.col("citationcount").alias("seed_citationcount"),
        F.col("influentialcitationcount").alias("seed_influentialcitationcount"),
        or_empty(F.col("s2fieldsofstudy")).alias("seed_fields"),
    )
    return (
        seed_part.join(nested, "seed_id").orderBy("seed_id", "part")
        .select(
            F.col("seed_id").cast("string").alias("seed_id"), *seed_part.columns[1:], "n_citers_qualifying",
            F.transform("ordered", lambda x: x["citer"]).alias("citers"), "part",
        )
    )
