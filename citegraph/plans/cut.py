"""Corpus build and benchmark cut, end to end, with their files."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, pairs as P, ranking, records
from ..params import CutParams
from ..schemas import EDGES
from ..session import materialise
from ..sources import layers


def write_note(spark: SparkSession, path: str, content: dict) -> None:
    """One small JSON document, through the session so that any file system works."""
    text = json.dumps(content, indent=1, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def build_corpus(
    spark: SparkSession, derived: str, out: str, steps: tuple[str, ...] = ("seeds", "edges", "citers"),
    ids_path: str | None = None, buckets: list[int] | None = None,
) -> dict[str, int]:
    """The three corpus tables; a committed table is left alone.

    Edges keep the bucket of the cited paper, so a run over some buckets can be completed
    by later runs over the others; finished buckets are skipped.
    """
    papers = layers.read_bucketed(spark, "papers", f"{derived}/papers")
    abstracts = layers.read_bucketed(spark, "abstracts", f"{derived}/abstracts")
    side = layers.read_bucketed(spark, "acl_ids", ids_path) if ids_path else None
    ids = corpus.id_source(papers, side)
    rows = {}
    if "seeds" in steps:
        rows["seeds"] = layers.write_once(spark, f"{out}/seeds", lambda: corpus.build_seeds(ids, papers, abstracts))
    if "edges" in steps:
        rows["edges"] = build_edge_buckets(spark, derived, out, buckets)
    if "citers" in steps:
        edges = read_edges(spark, out)
        rows["citers"] = layers.write_once(
            spark, f"{out}/citers", lambda: corpus.build_citers(edges, papers, abstracts, ids), inputs=(f"{out}/edges_done",)
        )
    return rows


def build_edge_buckets(spark: SparkSession, derived: str, out: str, buckets: list[int] | None = None) -> int:
    """A01 by bucket: missing buckets are built in one job; returns the rows of all wanted buckets.

    Buckets finished by earlier runs are recorded under ``edges_done``, which is written
    after the edges: a run cut short in between repeats its buckets and replaces them.
    """
    wanted = list(range(layers.N_BUCKETS)) if buckets is None else buckets
    done_path = f"{out}/edges_done"
    done = set()
    if layers.exists(spark, done_path):
        # At most one row per bucket and run.
        done = {r.bucket for r in spark.read.schema("bucket int").parquet(done_path).distinct().collect()}
    missing = [b for b in wanted if b not in done]
    if missing:
        raw = layers.read_bucketed(spark, "citers", f"{derived}/citers", missing)
        seeds = spark.read.parquet(f"{out}/seeds")
        edges = corpus.dedup_edges(raw, seeds).withColumn("bucket", layers.bucket_of(F.col("citedcorpusid")))
        edges.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "compression", "zstd"
        ).partitionBy("bucket").parquet(f"{out}/edges")
        spark.createDataFrame([(b,) for b in missing], "bucket int").coalesce(1).write.mode("append").parquet(done_path)
    if not wanted or not layers.exists(spark, f"{out}/edges"):
        return 0
    return read_edges(spark, out).where(F.col("bucket").isin(*wanted)).count()


def read_edges(spark: SparkSession, corpus_root: str) -> DataFrame:
    return spark.read.schema(EDGES).parquet(f"{corpus_root}/edges")


def resolved(params: CutParams, thresholds: DataFrame) -> CutParams:
    """Thresholds as parameter values; there is one row per year, which is checked."""
    rows = thresholds.limit(P.MAX_THRESHOLD_ROWS + 1).collect()
    if len(rows) > P.MAX_THRESHOLD_ROWS:
        raise ValueError("more threshold rows than years can exist")
    return replace(params, seed_infl_thresholds={r.year: [r.floor, r.cap] for r in sorted(rows, key=lambda r: r.year)})


def make_benchmark(
    edges: DataFrame, seeds: DataFrame, citers: DataFrame, out: str, params: CutParams, is_english=None,
    algorithm: str = "blake2b", mode: str = "errorifexists",
) -> dict:
    """Write ``out/records``, ``out/ids``, ``out/params`` and ``out/stats``; return the stats.

    Ids and hashes of the kept pairs are materialised once and feed the records, the id
    list and the statistics. Texts are joined only for the records.
    """
    spark = edges.sparkSession
    pairs = materialise(P.qualifying_pairs(edges, seeds, citers, params))
    if params.english_only:
        if is_english is None:
            raise ValueError("an English-only cut needs a language rule, for example language_rule(DETECTORS['langdetect'])")
        pairs = materialise(P.english_pairs(pairs, citers, params.min_citers, is_english))
    picked = materialise(records.cut(pairs, params, algorithm))
    payload = records.benchmark_pairs(picked, citers, edges)
    layers.write_json_lines(records.benchmark_records(payload, seeds), f"{out}/records", mode)
    layers.write_json_lines(id_manifest(picked), f"{out}/ids", mode)
    write_note(spark, f"{out}/params", asdict(params))
    stats = cut_stats(pairs, picked, params)
    write_note(spark, f"{out}/stats", stats)
    return stats


def id_manifest(picked: DataFrame, per_record: int = records.CITERS_PER_RECORD) -> DataFrame:
    """Seed ids with their citer ids in hash order, cut like the records."""
    parted = picked.withColumn("part", records.part_of(per_record))
    return parted.groupBy(F.col("seed_id").cast("string").alias("seed_id"), "part").agg(
        F.array_sort(F.collect_list(F.struct("h", F.col("citer_id").cast("string").alias("id")))).alias("c")
    ).select("seed_id", "part", F.transform("c", lambda c: c["id"]).alias("citers"))


def cut_stats(pairs: DataFrame, picked: DataFrame, params: CutParams) -> dict:
    sizes = P.seed_counts(picked)
    counted = P.seed_counts(pairs).agg(
        F.count(F.lit(1)).alias("n_seeds_any_qualifying"),
        F.coalesce(F.sum((F.col("n_citers") >= params.min_citers).cast("long")), F.lit(0)).alias("n_seeds_eligible"),
    ).first()
    chosen = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_citers"), F.lit(0)).alias("pairs")).first()
    spread = ranking.nearest_rank_summary(sizes, "n_citers").first()
    return {
        **counted.asDict(), "n_seeds": chosen.n, "n_pairs": chosen.pairs,
        "citers_per_seed": spread.asDict() if spread else {}, "params": asdict(params),
    }
