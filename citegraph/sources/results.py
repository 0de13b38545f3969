"""Readers of result files: generations, match probabilities, labels, score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..params import CONDITIONS


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Nested benchmark records; blank lines are ignored by the JSON reader."""
    return spark.read.schema(schemas.BENCHMARK).json(path)


def benchmark_rows(records: DataFrame) -> DataFrame:
    """One row per (seed, citer) pair with the citer struct; parts of a seed rejoin here."""
    return records.withColumn("citer", F.explode("citers")).drop("citers", "part")


def unique_citers(rows: DataFrame) -> DataFrame:
    """One record per citer over all seeds."""
    return rows.select("citer.id", "citer.title", "citer.abstract", "citer.year").dropDuplicates(["id"])


def _log(spark: SparkSession, schema, path: str) -> DataFrame:
    """An append-only JSON log with ``seq``, which orders lines over files and within them.

    A line cut short by a crash does not parse and is left out.
    """
    lines = (
        spark.read.schema(schemas.with_corrupt_record(schema)).option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*shard_*.jsonl").json(path)
        .select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"))
    )
    return (
        lines.where(F.col("_corrupt_record").isNull()).withColumn("seq", F.struct("file", "block", "row"))
        .drop("_corrupt_record", "file", "block", "row")
    )


def last_writes(log: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """The latest payload per key. ``max_by`` combines map-side, so copies of one key shrink early."""
    latest = log.groupBy(*key).agg(F.max_by(F.struct(*payload), "seq").alias("p"))
    return latest.select(*key, "p.*")


def read_generations(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """(condition, seed_id, predictions, order) with the last write per seed.

    ``order`` ranks planned conditions before others. Empty predictions are removed unless
    ``keep_empty`` (for relabelling, where positions matter).
    """
    records = last_writes(
        _log(spark, schemas.GENERATION_RECORD, path), ["condition", "seed_id"], ["model", "predictions"]
    )
    names = F.array(*[F.lit(c) for c in CONDITIONS])
    position = F.array_position(names, F.col("condition"))
    records = records.withColumn("order", F.when(position > 0, position - 1).otherwise(len(CONDITIONS)).cast("int"))
    if keep_empty:
        return records
    return records.withColumn("predictions", F.filter("predictions", lambda t: t.isNotNull() & (t != "")))


def generation_rows(records: DataFrame) -> DataFrame:
    """One row per generation: (condition, seed_id, gen_idx, text)."""
    return records.select("condition", "seed_id", F.posexplode("predictions").alias("gen_idx", "text"))


def write_matches(matches: DataFrame, path: str, mode: str = "append") -> None:
    """Match probabilities by (condition, mode); committed partitions are never rewritten."""
    matches.hint("rebalance", "condition", "mode").write.mode(mode).option("compression", "zstd").partitionBy(
        "condition", "mode"
    ).parquet(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Probabilities over a pair's own generations; padding beyond ``n_gen`` is cut."""
    rows = spark.read.schema(schemas.MATCH_ROW).parquet(path)
    return rows.withColumn("probs", F.slice("probs", 1, F.col("n_gen")))


def missing_units(wanted: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(condition, mode) units without stored probabilities."""
    units = wanted.select("condition", "mode").distinct()
    return units if stored is None else units.join(stored.select("condition", "mode").distinct(), ["condition", "mode"], "left_anti")


def read_citer_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels per citer, last write wins."""
    return last_writes(_log(spark, schemas.CITER_LABELS, path), ["citer_id"], ["labels"])


def read_generation_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row per generation with its labels."""
    records = last_writes(_log(spark, schemas.GENERATION_LABELS, path), ["condition", "seed_id"], ["labels"])
    return records.select("condition", "seed_id", F.posexplode("labels").alias("gen_idx", "labels"))


def read_scores(spark: SparkSession, path: str, schema=schemas.PAIR_SCORE) -> DataFrame:
    """Score tables in CSV, plain or gzipped; empty cells are NULL."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)


def publication_dates(citers: DataFrame) -> DataFrame:
    """(citer_id as text, publicationdate) of dated citers."""
    return citers.where(F.col("publicationdate").isNotNull()).select(
        F.col("corpusid").cast("string").alias("citer_id"), F.col("publicationdate").alias("citer_pubdate")
    )


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Markdown review table: index, two labels and the sentence.

    Only four-cell rows with a numeric first cell count; escaped pipes stay in a cell.
    """
    cells = F.transform(F.split("value", r"(?<!\\)\|"), lambda c: F.trim(c))
    inner = F.slice(cells, 2, F.size(cells) - 2)
    rows = spark.read.text(path).where(F.size(F.split("value", r"(?<!\\)\|")) == 6).select(inner.alias("c"))
    bare = lambda c: F.regexp_replace(c, r"^\*+|\*+$", "")
    return rows.where(F.col("c")[0].rlike(r"^\d+$")).select(
        F.col("c")[0].cast("int").alias("sentence"), bare(F.col("c")[1]).alias("second"),
        bare(F.col("c")[2]).alias("reference"), F.replace(F.col("c")[3], F.lit(r"\|"), F.lit("|")).alias("text"),
    )
