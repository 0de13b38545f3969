"""A copy of the benchmark, or of generations, without result sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_sentences
from ..operators import removal
from ..params import CutParams
from ..session import materialise
from ..sources import layers, results
from .cut import write_note


def strip_benchmark(
    records: DataFrame, labels: DataFrame, out: str, min_citers: int = CutParams().min_citers,
    splitter=split_sentences, mode: str = "errorifexists",
) -> dict:
    """Rewritten records under ``out/records`` and counters under ``out/stats``.

    Each distinct citer is split and audited once. Records keep their order of citers;
    emptied citers go first, then seeds left below the floor.
    """
    citers = results.unique_citers(results.benchmark_rows(records)).select(F.col("id").alias("citer_id"), F.col("abstract").alias("text"))
    stripped = materialise(removal.strip_units(citers, labels, ["citer_id"], splitter))
    rows = records.select("*", F.posexplode("citers").alias("at", "c")).drop("citers").withColumn("citer_id", F.col("c.id"))
    kept, seeds = removal.refloor(rows.select("seed_id", "part", "at", "citer_id"), stripped, min_citers)
    audit = stripped.select("citer_id", F.col("kept"), F.col("text").alias("full"), F.col("audit"))
    joined = kept.join(rows.drop("n_citers_qualifying"), ["seed_id", "part", "at", "citer_id"]).join(audit, "citer_id")
    citer = F.col("c").withField("abstract", F.col("kept")).withField("abstract_full", F.col("full")).withField(
        "sentences", F.col("audit")
    )
    head = [c for c in records.columns if c not in ("citers", "n_citers_qualifying", "seed_id", "part")]
    # A record holds a bounded number of citers, and so does the group here.
    nested = joined.groupBy("seed_id", "part").agg(
        *[F.first(c).alias(c) for c in head], F.first("n_citers").alias("n_citers_qualifying"),
        F.array_sort(F.collect_list(F.struct("at", citer.alias("c")))).alias("cs"),
    ).withColumn("citers", F.transform("cs", lambda c: c["c"])).drop("cs")
    layers.write_json_lines(nested.select("seed_id", *head, "n_citers_qualifying", "citers", "part"), f"{out}/records", mode)
    # One row each.
    stats = removal.removal_counters(stripped).first().asDict() | removal.removal_totals(seeds).first().asDict()
    write_note(records.sparkSession, f"{out}/stats", stats)
    return stats


def strip_generations(
    generations: DataFrame, labels: DataFrame, splitter=split_sentences,
) -> tuple[DataFrame, DataFrame]:
    """E09 for generations: rewritten rows and counters per condition.

    ``generations`` has (condition, seed_id, gen_idx, text). An emptied generation stays as
    '' so that positions keep their meaning; readers leave it out. The second table also
    counts the seeds that lose a generation.
    """
    key = ["condition", "seed_id", "gen_idx"]
    stripped = removal.strip_units(generations, labels, key, splitter)
    lost = stripped.groupBy("condition", "seed_id").agg(
        F.max(((F.col("text") != "") & (F.col("kept") == "")).cast("int")).alias("short")
    ).groupBy("condition").agg(F.count(F.lit(1)).alias("seeds"), F.sum("short").alias("seeds_short_of_original"))
    counters = removal.removal_counters(stripped, ["condition"]).join(lost, "condition")
    return stripped.select(*key, F.col("kept").alias("text")), counters
