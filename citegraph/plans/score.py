"""Scores of generation sets against target sets, by condition, mode and stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import recall_at_k
from ..functions.strata import cutoff_stratum, year_label
from ..operators import matching
from ..operators.resampling import bootstrap
from ..operators.vectors import best_similarity, vendi
from ..params import CONDITIONS, CUTOFF_DATE, K_HEADLINE, N_GENERATIONS


def seed_scores(generations: DataFrame) -> DataFrame:
    """Per (condition, seed): number of generations and Vendi score. Input: condition, seed_id, item_id, vec."""
    return vendi(generations, ["condition", "seed_id"]).withColumnRenamed("n", "n_gen")


def pair_scores(
    targets: DataFrame, generations: DataFrame, dates: DataFrame | None = None, probs: DataFrame | None = None,
) -> DataFrame:
    """Per (condition, mode, seed, citer): n_gen, m and best cosine.

    ``targets`` has (mode, seed_id, citer_id, citer_year, vec); every condition is scored
    against all of them. Conditions and modes become part of the join key, so one pass
    scores them together.
    """
    per_seed = generations.groupBy("condition", "seed_id").agg(F.count(F.lit(1)).cast("int").alias("n_gen"))
    conditions = targets.join(per_seed, "seed_id")
    keyed = lambda df: df.withColumn("seed_id", F.struct("condition", "seed_id"))
    # A citer may be a target of its seed in both modes, so the mode belongs to the item.
    items = keyed(conditions).withColumn("item_id", F.struct("mode", "citer_id")).select(
        "seed_id", "item_id", "citer_year", "n_gen", "vec"
    )
    best = best_similarity(keyed(generations).select("seed_id", "item_id", "vec"), items)
    scores = best.select(
        F.col("seed_id.condition").alias("condition"), F.col("item_id.mode").alias("mode"),
        F.col("seed_id.seed_id").alias("seed_id"), F.col("item_id.citer_id").alias("citer_id"),
        "citer_year", "n_gen", "best_cos",
    )
    if dates is None:
        scores = scores.withColumn("citer_pubdate", F.lit(None).cast("string"))
    else:
        scores = scores.join(dates, "citer_id", "left")
    if probs is None:
        return scores.withColumn("m", F.lit(None).cast("int"))
    return matching.with_matches(scores, probs)


def with_strata(scores: DataFrame, cutoff: str = CUTOFF_DATE) -> DataFrame:
    """One row per stratum a pair belongs to: all, its cutoff side, its citer year."""
    side = cutoff_stratum(F.col("citer_pubdate"), F.col("citer_year"), cutoff)
    year = year_label(F.col("citer_year"))
    strata = F.array_compact(F.array(F.lit("all"), F.concat(side, F.lit("_cutoff")), F.concat(F.lit("year "), year)))
    return scores.select("*", F.explode(strata).alias("stratum"))


KEYS = ["condition", "mode", "stratum"]


def seed_cells(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and seed: pair count and the sums every headline metric is made of."""
    hit = {f"recall@{k}": recall_at_k(F.col("m"), F.col("n_gen"), k) for k in K_HEADLINE}
    return scores.groupBy(*keys, "seed_id").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.struct(F.sum("best_cos").alias("total"), F.count("best_cos").cast("double").alias("cnt")).alias("cosine_coverage"),
        *[
            F.struct(F.sum(F.when(F.col("m").isNotNull(), value)).alias("total"), F.count("m").cast("double").alias("cnt")).alias(name)
            for name, value in hit.items()
        ],
        F.struct(F.sum("m").cast("double").alias("total"), F.count("m").cast("double").alias("cnt")).alias("matches"),
    )


def summarise(scores: DataFrame, keys: list[str] | None = None, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Per key and metric the mean and its interval; seeds are resampled.

    Pairs collapse to one row per seed in a single aggregation; means and intervals of all
    metrics are then computed from those sums.
    """
    keys = keys or KEYS
    metrics = ["cosine_coverage", *[f"recall@{k}" for k in K_HEADLINE]]
    cells = seed_cells(scores, keys)
    long = cells.select(*keys, "seed_id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.coalesce(F.col(f"`{name}`.total"), F.lit(0.0)).alias("total"),
                 F.col(f"`{name}`.cnt").alias("cnt"))
        for name in metrics
    ])).alias("c")).select(*keys, "seed_id", "c.*")
    return bootstrap(long, "seed_id", [*keys, "metric"], n_boot, seed)


def stratum_sizes(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs, seeds and mean matches per citer of each key."""
    keys = keys or KEYS
    matches = F.col("matches")
    return seed_cells(scores, keys).groupBy(*keys).agg(
        F.sum("pairs").alias("n_pairs"), F.count(F.lit(1)).alias("n_seeds"),
        (F.sum(matches["total"]) / F.nullif(F.sum(matches["cnt"]), F.lit(0.0))).alias("mean_matches_per_citer"),
    )


def undated_pairs(scores: DataFrame, cutoff: str = CUTOFF_DATE) -> DataFrame:
    """Pairs that belong to neither cutoff side."""
    side = cutoff_stratum(F.col("citer_pubdate"), F.col("citer_year"), cutoff)
    return scores.groupBy("condition", "mode").agg(F.sum(side.isNull().cast("long")).alias("n_pairs_undated"))


def condition_summary(seeds: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Per condition: seeds, generations per seed, seeds short of 51, Vendi with interval."""
    counts = seeds.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("n_gen").alias("mean_n_gen"),
        F.sum((F.col("n_gen") < N_GENERATIONS).cast("long")).alias("seeds_short"),
    )
    cells = seeds.select("condition", "seed_id", F.col("vendi").alias("total"), F.lit(1.0).alias("cnt"))
    interval = bootstrap(cells, "seed_id", ["condition"], n_boot, seed)
    return counts.join(interval.withColumnRenamed("mean", "vendi"), "condition")


def best_condition(summary: DataFrame, generator: str, metric: str = f"recall@{N_GENERATIONS}") -> DataFrame:
    """The generator's condition with the highest mean of ``metric`` on its own targets."""
    names = [name for name, c in CONDITIONS.items() if c.generator == generator]
    own = summary.where(
        F.col("condition").isin(*names) & (F.col("mode") == "own") & (F.col("stratum") == "all")
        & (F.col("metric") == metric) & ~F.isnan("mean")
    )
    return own.agg(F.max_by("condition", "mean").alias("best_condition"))
