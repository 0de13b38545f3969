"""Stages from raw documents to a mixed training set.

Each stage reads what its predecessor kept and is written before the next one starts. A document leaves at the first stage that
rejects it: low quality, exact copy, near copy, benchmark passage. The last stage keeps what the mix takes and adds copies, shard
and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citegraph.llm.common import materialise, table
from citegraph.llm.decontaminate import drop_leaks
from citegraph.llm.exact_dedup import drop_copies
from citegraph.llm.mixing import mixed_rows
from citegraph.llm.near_join import keep_one
from citegraph.llm.quality import keep_good
from citegraph.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(ship(spark), sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(ship(spark), sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages), ("mixing to target weights", mixture),
]

# The classifier cannot be written in SQL; tests compare run() with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
