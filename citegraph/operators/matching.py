"""Recall@k over match counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType

from ..functions.numeric import match_count, recall_at_k
from ..params import K_GRID, MATCH_THRESHOLD


@arrow_udf(ArrayType(FloatType()))
def half_precision(probs: pa.Array) -> pa.Array:
    """Round probabilities as a half-precision store would (0.5002 becomes 0.5)."""
    flat = probs.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
    lengths = np.diff(probs.offsets.to_numpy())
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float32()))


def with_matches(
    targets: DataFrame, probs: DataFrame, keys: Sequence[str] = ("condition", "mode", "seed_id", "citer_id"),
    threshold: float = MATCH_THRESHOLD,
) -> DataFrame:
    """Attach ``m``; a (condition, mode) with any unscored pair gets no m at all.

    ``targets`` carries ``n_gen``; a row of probabilities of another length is an error.
    The completeness flag is a grouped minimum joined back on the few (condition, mode)
    pairs, which keeps a unit of any size out of a single window.
    """
    joined = targets.join(probs.select(*keys, "probs"), list(keys), "left")
    stale = F.col("probs").isNotNull() & (F.size("probs") != F.col("n_gen"))
    checked = joined.withColumn(
        "m",
        F.when(stale, F.raise_error(F.lit("match probabilities do not fit the generations")).cast("int"))
        .when(F.col("probs").isNotNull(), match_count(F.col("probs"), threshold)),
    ).drop("probs")
    unit = list(keys)[:2]
    complete = checked.groupBy(*unit).agg(F.bool_and(F.col("m").isNotNull()).alias("complete"))
    return checked.join(complete, unit).withColumn("m", F.when(F.col("complete"), F.col("m"))).drop("complete")


def match_profile(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pairs counted by (m, n_gen). Recall depends on nothing else, so every curve starts here."""
    return scores.where(F.col("m").isNotNull()).groupBy(*group, "m", "n_gen").agg(F.count(F.lit(1)).alias("w"))


def recall_curve(scores: DataFrame, group: Sequence[str], ks: Sequence[int] = K_GRID) -> DataFrame:
    """Mean Recall@k per group for each k."""
    profile = match_profile(scores, group).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    hit = recall_at_k(F.col("m"), F.col("n_gen"), F.col("k"))
    return profile.groupBy(*group, "k").agg((F.sum(hit * F.col("w")) / F.sum("w")).alias("recall"))


def recall_gain(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    """What each k adds over the smallest k of the curve."""
    order = Window.partitionBy(*group).orderBy("k")
    return curve.withColumn("gain", F.col("recall") - F.first("recall").over(order))
