"""Qualifying (seed, citer) pairs and the filters behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import background_only, shares_member
from ..params import CutParams

MAX_THRESHOLD_ROWS = 10_000


def threshold_table(spark, thresholds: dict) -> DataFrame:
    """``{year: (floor, cap)}`` as a table small enough to broadcast."""
    if not thresholds:
        raise ValueError("no thresholds given: pass None for no seed bound")
    rows = [(int(y), int(lo), None if hi is None else int(hi)) for y, (lo, hi) in thresholds.items()]
    table = spark.createDataFrame(rows, "year int, floor long, cap long")
    return F.broadcast(table) if len(rows) <= MAX_THRESHOLD_ROWS else table


def in_band(seeds: DataFrame, thresholds: DataFrame) -> DataFrame:
    """seeds inside their year's band; a year without a row drops the seed."""
    count = F.coalesce("influentialcitationcount", F.lit(0))
    keep = (count >= F.col("floor")) & (F.col("cap").isNull() | (count < F.col("cap")))
    return seeds.join(thresholds, "year").where(keep).drop("floor", "cap")


def usable_abstract(params: CutParams):
    """F02."""
    return F.length("abstract").between(params.abstract_min_chars, params.abstract_max_chars)


def qualifying_seeds(
    seeds: DataFrame, params: CutParams, thresholds: DataFrame | None, only: DataFrame | None = None
) -> DataFrame:
    """F01, F02, F08, F11 on the seed side alone."""
    kept = seeds.where(F.col("year").isNotNull())
    if params.seed_year_min is not None:
        kept = kept.where(F.col("year") >= params.seed_year_min)
    if params.seed_year_max is not None:
        kept = kept.where(F.col("year") <= params.seed_year_max)
    kept = kept.where(usable_abstract(params))
    if thresholds is not None:
        kept = in_band(kept, thresholds)
    if only is not None:
        kept = kept.join(only.select("corpusid"), "corpusid", "left_semi")
    return kept


def qualifying_pairs(
    edges: DataFrame, seeds: DataFrame, citers: DataFrame, params: CutParams,
    thresholds: DataFrame | None = None, only: DataFrame | None = None,
) -> DataFrame:
    """(seed_id, citer_id) pairs that pass every enabled rule.

    Rules on one table run before the joins, so texts and intents never travel. The two
    joins carry no hints: seeds and citers grow with the corpus, and adaptive execution
    broadcasts them, or splits a hot cited paper, by measured size.
    """
    spark = edges.sparkSession
    if thresholds is None and params.seed_infl_thresholds is not None:
        thresholds = threshold_table(spark, params.seed_infl_thresholds)
    links = edges
    if params.influential_only:
        links = links.where(F.coalesce("isinfluential", F.lit(False)))
    if params.drop_background_only:
        links = links.where(~background_only(F.col("intents")))
    links = links.where(F.col("citedcorpusid") != F.col("citingcorpusid")).select(
        F.col("citedcorpusid").alias("seed_id"), F.col("citingcorpusid").alias("citer_id")
    )
    seed_side = qualifying_seeds(seeds, params, thresholds, only).select(
        F.col("corpusid").alias("seed_id"), F.col("year").alias("seed_year"), F.col("authors").alias("seed_authors")
    )
    citer_side = citers.where(
        F.col("abstract").isNotNull() & usable_abstract(params) & F.col("year").isNotNull()
        & (F.coalesce("citationcount", F.lit(0)) >= params.min_citer_citations)
    ).select(
        F.col("corpusid").alias("citer_id"), F.col("year").alias("citer_year"), F.col("authors").alias("citer_authors")
    )
    return (
        links.join(seed_side, "seed_id").join(citer_side, "citer_id")
        .where(F.col("citer_year") >= F.col("seed_year"))
        .where(~shares_member(F.col("citer_authors"), F.col("seed_authors")))
        .select("seed_id", "citer_id")
    )


def seed_counts(pairs: DataFrame) -> DataFrame:
    """A04."""
    return pairs.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_citers"))


def eligible_seeds(pairs: DataFrame, min_citers: int) -> DataFrame:
    """F13."""
    return seed_counts(pairs).where(F.col("n_citers") >= min_citers)


def language_candidates(pairs: DataFrame, citers: DataFrame, min_citers: int) -> DataFrame:
    """Distinct citers of the seeds that reach the floor, with their abstracts.

    Only they need a verdict: dropping pairs can push a seed below the floor, never above.
    """
    wanted = (
        pairs.join(eligible_seeds(pairs, min_citers), "seed_id", "left_semi")
        .select(F.col("citer_id").alias("corpusid")).distinct()
    )
    columns = [c for c in ("corpusid", "abstract", "lang", "detected") if c in citers.columns]
    return citers.select(*columns).join(wanted, "corpusid", "left_semi")


def english_pairs(pairs: DataFrame, citers: DataFrame, min_citers: int, is_english) -> DataFrame:
    """Pairs without the citers judged non-English.

    ``is_english`` maps the abstract column to a boolean column; each distinct citer is
    judged once.
    """
    judged = language_candidates(pairs, citers, min_citers)
    rejected = judged.where(~F.coalesce(is_english(judged), F.lit(False))).select(
        F.col("corpusid").alias("citer_id")
    )
    return pairs.join(rejected, "citer_id", "left_anti").select("seed_id", "citer_id")
