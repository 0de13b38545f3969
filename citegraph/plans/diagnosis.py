"""Duplicate and degree diagnosis of a raw edge layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import flat_intents
from ..operators.ranking import quantiles


def copies_per_pair(raw: DataFrame) -> DataFrame:
    """How many pairs occur once, twice, ...; copies combine map-side."""
    pairs = raw.groupBy("citedcorpusid", "citingcorpusid").agg(F.count(F.lit(1)).alias("copies"))
    return pairs.groupBy("copies").agg(F.count(F.lit(1)).alias("n_pairs"))


def edge_overview(raw: DataFrame) -> DataFrame:
    """Rows, pairs, distinct papers, flags and null shares in two levels of grouping.

    Rows collapse to pairs first; the distinct counts then run over pairs. Each distinct
    count is its own scalar subquery, so no row is expanded once per count.
    """
    pairs = raw.select("citedcorpusid", "citingcorpusid")
    distinct = lambda *c: pairs.select(*c).distinct().agg(F.count(F.lit(1))).scalar()
    flag = lambda cond: F.sum(cond.cast("long"))
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        flag(F.col("citedcorpusid") == F.col("citingcorpusid")).alias("self_rows"),
        flag(F.col("isinfluential")).alias("influential_rows"),
        flag(F.col("contexts").isNotNull()).alias("with_contexts"),
        flag(F.col("intents").isNotNull()).alias("with_intents"),
    ).select(
        "*", distinct("citedcorpusid", "citingcorpusid").alias("distinct_pairs"),
        distinct("citedcorpusid").alias("distinct_cited"), distinct("citingcorpusid").alias("distinct_citing"),
    )


def in_degrees(raw: DataFrame) -> DataFrame:
    """Distinct citers per cited paper; pairs are made distinct before they are counted."""
    return raw.select("citedcorpusid", "citingcorpusid").distinct().groupBy("citedcorpusid").agg(
        F.count(F.lit(1)).alias("in_degree")
    )


def in_degree_quantiles(raw: DataFrame) -> DataFrame:
    probs = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999, "max": 1.0}
    return quantiles(in_degrees(raw), "in_degree", probs).drop("total")


def context_sizes(raw: DataFrame) -> DataFrame:
    return raw.groupBy(F.coalesce(F.size("contexts"), F.lit(0)).alias("n_contexts")).agg(F.count(F.lit(1)).alias("n_rows"))


def intent_label_rows(raw: DataFrame) -> DataFrame:
    """Rows carrying each intent label."""
    return raw.select(F.explode(flat_intents(F.col("intents"))).alias("intent")).groupBy("intent").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def abstracts_by_year(ids: DataFrame, papers: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Identified papers per year and how many of them have an abstract."""
    texts = abstracts.where(F.col("abstract").isNotNull()).select("corpusid", F.lit(1).alias("has"))
    known = ids.select("corpusid").join(papers.select("corpusid", "year"), "corpusid").join(texts, "corpusid", "left")
    return known.groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"), F.count("has").alias("with_abstract"))
