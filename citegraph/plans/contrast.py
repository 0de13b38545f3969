"""Does coverage say something the other set metrics do not?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null, reaches
from ..operators.agreement import decile_of, spearman
from ..params import ALTERNATIVE_METRICS, LOWER_IS_BETTER


def long_metrics(per_seed: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(system, seed_id, coverage, metric, value) rows of a wide per-seed table."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])
    return per_seed.select("system", "seed_id", "coverage", F.explode(cells).alias("c")).select(
        "system", "seed_id", "coverage", "c.metric", "c.value"
    )


def correlations(per_seed: DataFrame, metrics: Sequence[str] = ALTERNATIVE_METRICS) -> DataFrame:
    """A23, analysis A: rank correlation of coverage with each metric, per system and pooled.

    Pooling takes the rows of systems that qualify on their own. Systems and the pool are
    ranked in one pass, the pool being one more system.
    """
    rows = long_metrics(per_seed, metrics).where(
        F.col("value").isNotNull() & ~F.isnan("value") & F.col("coverage").isNotNull() & ~F.isnan("coverage")
    )
    enough = rows.groupBy("system", "metric").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 10).drop("n")
    kept = rows.join(enough, ["system", "metric"])
    both = kept.withColumn("system", F.explode(F.array(F.col("system"), F.lit("pooled"))))
    return spearman(both, "coverage", "value", ["system", "metric"])


def system_table(per_seed: DataFrame, metrics: Sequence[str] = ALTERNATIVE_METRICS) -> DataFrame:
    """A22, analysis B: mean of every metric per system; undefined values are left out."""
    return per_seed.groupBy("system").agg(
        *[F.avg(nan_to_null(F.col(m).cast("double"))).alias(m) for m in ("coverage", *metrics)]
    )


def rankings(table: DataFrame, metrics: Sequence[str] = ALTERNATIVE_METRICS) -> DataFrame:
    """Systems of a model ranked by each metric, best first. ``system`` is 'model/condition'."""
    columns = ("coverage", *metrics)
    signed = [
        F.struct(F.lit(m).alias("metric"), (F.col(m) if m in LOWER_IS_BETTER else -F.col(m)).alias("key"))
        for m in columns
    ]
    rows = table.select(
        "system", F.substring_index("system", "/", 1).alias("model"), F.explode(F.array(*signed)).alias("s")
    ).select("system", "model", "s.metric", "s.key")
    # One row per system and metric: the window is as large as the number of systems.
    order = Window.partitionBy("model", "metric").orderBy(F.col("key").asc_nulls_last(), "system")
    return rows.select("model", "metric", "system", F.row_number().over(order).alias("place"))


def decile_coverage(
    pairs: DataFrame, tau: float, group: Sequence[str] = ("system",), unit: Sequence[str] = ("seed_id", "citer_id"),
) -> DataFrame:
    """A24, analysis C: share of targets reaching ``tau`` by decile of their similarity to the seed.

    ``pairs`` has one row per system and pair with ``seed_sim`` and ``best_cos``. The edges are
    those of the distinct pairs, and a pair without a similarity is a miss.
    """
    binned = decile_of(pairs, "seed_sim", unit=unit)
    return binned.groupBy(*group, "decile").agg(
        F.avg(reaches(F.col("best_cos"), tau).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_pairs")
    )


def tau_from_null(null_best: DataFrame, value: str = "best_cos", percentile: float = 0.95) -> DataFrame:
    """Threshold as a percentile of the similarities of a random pool."""
    from ..operators.ranking import quantiles

    return quantiles(null_best, value, {"tau": percentile}).select("tau")
