"""Bootstrap confidence intervals that resample groups (seeds)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS_PER_HASH = 8
# Units whose weights are held at a time: 4 MB with 1,000 replicates.
UNITS_AT_ONCE = 512
# Keys whose sums a task holds: 16 MB with 1,000 replicates.
KEYS_HELD = 1024
# Bounds of a 32-bit draw at which a Poisson(1) weight grows by one, from its distribution function.
POISSON_BOUNDS = tuple(math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12))


def cells(df: DataFrame, value: str, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum and count of the defined values per resampling unit; combined map-side."""
    defined = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.groupBy(*keys, unit).agg(
        F.coalesce(F.sum(defined), F.lit(0.0)).alias("total"), F.count(defined).cast("double").alias("cnt")
    )


def poisson_weights(units: Sequence[str | None], n_boot: int, seed: int) -> np.ndarray:
    """Weights of a block of units (rows) in all replicates (columns).

    The counter of a draw is (unit, block of eight replicates, seed); its SHA-256 gives the eight 32-bit draws of the block.
    """
    blocks = -(-n_boot // DRAWS_PER_HASH)
    digest = hashlib.sha256
    tails = [f"{block}|{seed}".encode() for block in range(blocks)]
    # A null unit is left out of the counter.
    heads = [b"" if unit is None else f"{unit}|".encode("utf-8", "surrogatepass") for unit in units]
    raw = b"".join([digest(head + tail).digest() for head in heads for tail in tails])
    draws = np.frombuffer(raw, ">u4").reshape(len(heads), blocks * DRAWS_PER_HASH)[:, :n_boot]
    return np.searchsorted(np.array(POISSON_BOUNDS), draws, side="right")


def bootstrap(
    unit_cells: DataFrame, unit: str, keys: Sequence[str] = (), n_boot: int = 1000, seed: int = 0, alpha: float = 0.05,
) -> DataFrame:
    """Mean and percentile interval per key over (total, cnt) cells, one cell per unit.

    In every replicate each unit has an independent Poisson(1) weight, the limit of drawing
    units with replacement. Weights are read off the digits of a hash of unit, replicate and
    seed, eight to a hash, so they depend neither on order nor on partitioning and any SQL
    engine can repeat them. Units are dealt to the tasks by hash, since a small file of them is much work.
    A task draws the weights of a block of units for all replicates
    at once and sends two sums per key and replicate, added over its blocks; a unit that occurs under several keys
    is drawn once.
    """
    keys = list(keys)
    rows = unit_cells if keys else unit_cells.withColumn("all_units", F.lit(0))
    by = keys or ["all_units"]
    # Keys travel through Python as one text, nulls included.
    named = rows.withColumn("_key", F.to_json(F.struct(*by)))
    flat = named.select(
        F.col("_key").alias("key"), F.col(unit).cast("string").alias("unit"),
        F.col("total").cast("double").alias("total"), F.col("cnt").cast("double").alias("cnt"),
    )
    # A named number of tasks, as adaptive execution would join them by their few bytes.
    tasks = int(unit_cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = flat.repartition(tasks, "unit").sortWithinPartitions("unit", "key")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def sent() -> pd.DataFrame:
            return pd.DataFrame({"key": list(held), "t": [h[0] for h in held.values()], "c": [h[1] for h in held.values()]})

        for frame in frames:
            for at in range(0, len(frame), UNITS_AT_ONCE):
                part = frame.iloc[at:at + UNITS_AT_ONCE]
                place, units = pd.factorize(part["unit"], use_na_sentinel=False)
                weights = poisson_weights([u if isinstance(u, str) else None for u in units], n_boot, seed).astype(np.float64)
                code, keys = pd.factorize(part["key"])
                values = part[["total", "cnt"]].to_numpy().T
                for k, key in enumerate(keys):
                    own = np.flatnonzero(code == k)
                    found = values[:, own] @ weights[place[own]]
                    held[key] = held[key] + found if key in held else found
                if len(held) > KEYS_HELD:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    partial = flat.mapInPandas(sums, "key string, t array<double>, c array<double>")
    replicates = partial.select("key", F.posexplode(F.arrays_zip("t", "c"))).groupBy("key", "pos").agg(
        F.sum("col.t").alias("_t"), F.sum("col.c").alias("_c"),
    ).withColumn("_ratio", F.col("_t") / F.greatest("_c", F.lit(1.0)))
    interval = replicates.groupBy(F.col("key").alias("_key")).agg(F.percentile("_ratio", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q"))
    means = named.groupBy("_key", *by).agg(F.sum("total").alias("_t"), F.sum("cnt").alias("_c"))
    known, nan = F.col("_c") > 0, F.lit(float("nan"))
    result = means.join(interval, "_key").select(
        *by, F.when(known, F.col("_t") / F.col("_c")).otherwise(nan).alias("mean"),
        F.when(known, F.col("_q")[0]).otherwise(nan).alias("ci_low"), F.when(known, F.col("_q")[1]).otherwise(nan).alias("ci_high"),
    )
    return result if keys else result.drop("all_units")
