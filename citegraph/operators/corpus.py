"""Corpus builders: seeds, de-duplicated edges, citers, influence thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import check_fractions
from ..schemas import PAPER_COLUMNS
from .bitset import bit_set, may_contain
from .ranking import quantiles


def id_source(papers: DataFrame, side_table: DataFrame | None = None) -> DataFrame:
    """(corpusid, acl_id) from the side table, else from the papers' own id column."""
    if side_table is not None:
        return side_table.select("corpusid", "acl_id")
    if "acl_id" not in papers.columns:
        raise ValueError("the papers table has no acl_id column: pass the id side table")
    return papers.where(F.col("acl_id").isNotNull()).select("corpusid", "acl_id")


def _paper_part(papers: DataFrame) -> DataFrame:
    return papers.select("corpusid", *[c for c in PAPER_COLUMNS if c in papers.columns])


def build_seeds(ids: DataFrame, papers: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Every identified paper that has an abstract."""
    texts = abstracts.where(F.col("abstract").isNotNull())
    joined = ids.join(_paper_part(papers), "corpusid").join(texts, "corpusid")
    return joined.select("corpusid", "acl_id", "abstract", *_paper_part(papers).columns[1:])


def dedup_edges(raw: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """One row per (cited, citing) pair pointing at a seed.

    The influence flag is OR-ed. Contexts and intents are taken independently from the
    copy with the smallest citation id that has them. A broadcast bit set of the seeds drops
    nearly all edges of other papers where the edges are read, so only edges of seeds are
    aggregated and shuffled. Copies are combined map-side and then exchanged by both ids, so a
    pair that makes up most of the rows shrinks before the shuffle and a very cited paper
    spreads over its citers. The seeds themselves are met after that, by an inner join with
    their distinct ids, which removes what shares a bit with a seed.
    """
    edges = raw.where(F.col("citingcorpusid").isNotNull() & F.col("citedcorpusid").isNotNull())
    if seeds is not None:
        edges = may_contain(edges, "citedcorpusid", bit_set(seeds, "corpusid"))

    def first_known(name: str):
        # NULL content last, then NULL ids last; a hash of the content settles equal ids.
        order = F.struct(F.col(name).isNull(), F.col("citationid").isNull(), "citationid", F.xxhash64(name))
        return F.min_by(name, order).alias(name)

    combined = edges.groupBy("citedcorpusid", "citingcorpusid").agg(
        F.bool_or("isinfluential").alias("isinfluential"), first_known("contexts"), first_known("intents")
    )
    if seeds is None:
        return combined
    return combined.join(seeds.select(F.col("corpusid").alias("citedcorpusid")).distinct(), "citedcorpusid")


def build_citers(edges: DataFrame, papers: DataFrame, abstracts: DataFrame, ids: DataFrame) -> DataFrame:
    """Metadata of every distinct citing paper; abstract and id are optional."""
    citing = edges.select(F.col("citingcorpusid").alias("corpusid")).distinct()
    joined = (
        citing.join(_paper_part(papers), "corpusid")
        .join(abstracts, "corpusid", "left")
        .join(ids.select("corpusid", "acl_id"), "corpusid", "left")
    )
    return joined.select("corpusid", "acl_id", "abstract", *_paper_part(papers).columns[1:])


def influence_thresholds(ids: DataFrame, papers: DataFrame, top_frac: float, cap_frac: float) -> DataFrame:
    """Per year the inclusive floor and exclusive cap on influential citations.

    The population is every identified paper with a year. A fraction of 0 switches its
    bound off (floor 0, cap NULL).
    """
    check_fractions(top_frac, cap_frac)
    population = ids.select("corpusid").join(
        papers.where(F.col("year").isNotNull()).select(
            "corpusid", "year", F.coalesce("influentialcitationcount", F.lit(0)).cast("long").alias("icc")
        ),
        "corpusid",
    )
    probs = {}
    if top_frac:
        probs["floor"] = 1 - top_frac
    if cap_frac:
        probs["cap"] = 1 - cap_frac
    if probs:
        found = quantiles(population, "icc", probs, ["year"], "disc")
    else:
        found = population.select("year").distinct()
    floor = F.col("floor") if top_frac else F.lit(0).cast("long")
    cap = F.col("cap") if cap_frac else F.lit(None).cast("long")
    return found.select("year", floor.alias("floor"), cap.alias("cap"))
