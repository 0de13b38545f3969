"""Generation in rounds over the seeds still short of usable texts."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models import Generator, ask, predictions, still_short
from ..params import N_GENERATIONS
from ..session import materialise
from ..sources.layers import exists

SLICE_SEEDS = 1_000


def generate(
    seeds: DataFrame, factory: Callable[[], Generator], condition: str, path: str, n: int = N_GENERATIONS, max_rounds: int = 4,
    slice_seeds: int = SLICE_SEEDS,
) -> DataFrame:
    """Generation records of all seeds; raw replies are appended to ``path`` slice by slice.

    A round asks the seeds with fewer than ``n`` usable texts for what they lack, in slices of
    about ``slice_seeds`` seeds dealt by a hash. Every slice is committed on its own, and rounds are
    counted per seed from its stored replies, so a lost run repeats one slice at most and no seed
    loses a round by it. A seed is done when it has its texts or was asked ``max_rounds`` times.
    """
    spark = seeds.sparkSession
    schema = "seed_id string, raw array<string>, round int"
    for number in range(max_rounds):
        stored = spark.read.schema(schema).parquet(path) if exists(spark, path) else None
        short = still_short(seeds, stored, condition, n)
        if stored is not None:
            # Seeds whose answer of this round is stored already wait for the next one.
            asked = stored.where(F.col("round") >= number).select("seed_id").distinct()
            short = short.join(asked, "seed_id", "left_anti")
        # Written once: the slices below must not see each other's replies.
        short = materialise(short)
        slices = ceil(short.count() / slice_seeds)
        if stored is None:
            slices = max(slices, 1)
        for part in range(slices):
            mine = short.where(F.pmod(F.xxhash64("seed_id"), F.lit(slices)) == part)
            ask(mine, factory, condition).withColumn("round", F.lit(number)).write.mode("append").parquet(path)
    return predictions(spark.read.schema(schema).parquet(path), condition, n)
