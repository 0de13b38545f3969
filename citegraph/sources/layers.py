"""Raw shards, the bucketed Parquet layer and its maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.arrays import non_empty, null_if_empty_list
from ..params import N_BUCKETS


# ---- raw shards

def read_shards(spark: SparkSession, kind: str, path: str, strict: bool = True) -> DataFrame:
    """Gzipped JSON lines with a declared schema.

    Strict reading fails on a malformed line; otherwise such lines are kept aside in
    ``_corrupt_record``. One gzip file is one task: the sinks repartition afterwards.
    """
    schema = RAW_SCHEMAS[kind]
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return (
        spark.read.schema(schemas.with_corrupt_record(schema))
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and malformed lines of a permissive read."""
    bad = F.col("_corrupt_record").isNotNull()
    return df.where(~bad).drop("_corrupt_record"), df.where(bad).select("_corrupt_record")


def paper_rows(raw: DataFrame) -> DataFrame:
    """Flattened paper records; rows without an id are skipped."""
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    fields = F.filter(F.transform("s2fieldsofstudy", lambda f: f["category"]), lambda c: c.isNotNull() & (c != ""))
    journal = F.when(F.ltrim(F.col("journal")).startswith("{"), F.get_json_object("journal", "$.name"))
    return raw.where(F.col("corpusid").isNotNull()).select(
        "corpusid",
        non_empty(F.col("externalids.ACL")).alias("acl_id"),
        non_empty(F.col("externalids.DOI")).alias("doi"),
        non_empty(F.col("externalids.ArXiv")).alias("arxiv"),
        "title",
        null_if_empty_list(names).alias("authors"),
        "year",
        non_empty(F.col("publicationdate")).alias("publicationdate"),
        non_empty(F.col("venue")).alias("venue"),
        non_empty(F.col("publicationvenueid")).alias("publicationvenueid"),
        non_empty(journal).alias("journal_name"),
        "referencecount", "citationcount", "influentialcitationcount", "isopenaccess",
        null_if_empty_list(F.array_sort(F.array_distinct(fields))).alias("s2fieldsofstudy"),
        "publicationtypes",
    )


def abstract_rows(raw: DataFrame) -> DataFrame:
    """S01."""
    return raw.where(F.col("corpusid").isNotNull()).select("corpusid", "abstract")


def edge_rows(raw: DataFrame) -> DataFrame:
    """Edges with a cited paper; a missing citing paper is dropped later, at de-duplication."""
    return raw.where(F.col("citedcorpusid").isNotNull()).select(*schemas.RAW_EDGE.names)


def id_rows(raw: DataFrame) -> DataFrame:
    """Id side table."""
    kept = raw.where(F.col("corpusid").isNotNull() & non_empty(F.col("externalids.ACL")).isNotNull())
    return kept.select(
        "corpusid", F.col("externalids.ACL").alias("acl_id"), F.col("externalids.DOI").alias("doi"),
        F.col("externalids.ArXiv").alias("arxiv"), non_empty(F.col("venue")).alias("venue"), "publicationvenueid",
    )


# Record kind -> raw schema, normaliser, bucket and sort key.
RAW_SCHEMAS = {
    "abstracts": schemas.RAW_ABSTRACT, "papers": schemas.RAW_PAPER, "citers": schemas.RAW_EDGE,
    "acl_ids": schemas.RAW_PAPER,
}
NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "abstracts": abstract_rows, "papers": paper_rows, "citers": edge_rows, "acl_ids": id_rows,
}
SORT_KEY = {"abstracts": "corpusid", "papers": "corpusid", "citers": "citedcorpusid"}
# Breaks ties of the sort key, so that one very frequent key still spreads over files.
SPREAD_KEY = {"abstracts": "abstract", "papers": "title", "citers": "citingcorpusid"}


# ---- buckets

def bucket_of(key: Column, n_buckets: int = N_BUCKETS) -> Column:
    """Non-negative remainder, also for negative keys."""
    return F.pmod(key, F.lit(n_buckets)).cast("int")


def write_bucketed(df: DataFrame, kind: str, path: str, mode: str = "append", n_buckets: int = N_BUCKETS) -> None:
    """Zstd Parquet partitioned by ``bucket``.

    ``rebalance`` shuffles by bucket and lets adaptive execution split buckets that are
    larger than the advisory size, so a bucket holding most rows is written by many tasks.
    """
    if kind not in SORT_KEY:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return
    bucketed = df.withColumn("bucket", bucket_of(F.col(SORT_KEY[kind]), n_buckets))
    bucketed.hint("rebalance", "bucket").write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(path)


def read_bucketed(
    spark: SparkSession, kind: str, path: str, buckets: list[int] | None = None, hide_bucket: bool = True
) -> DataFrame:
    """A layer, or only some of its buckets (partition pruning). ``[]`` reads none."""
    table = {"abstracts": schemas.ABSTRACTS, "papers": schemas.PAPERS, "citers": schemas.EDGES_RAW, "acl_ids": schemas.ACL_IDS}[kind]
    if kind not in SORT_KEY:
        return spark.read.schema(table).parquet(path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table)
    df = spark.read.schema(f"{ddl}, bucket int").parquet(path)
    # Loads kept in sub-folders add a partition column of their own; only the layer's columns count.
    df = df.select(*table.names, "bucket")
    if buckets is not None:
        df = df.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
    return df.drop("bucket") if hide_bucket else df


def with_bucket_filter(df: DataFrame, key: str, value: int, n_buckets: int = N_BUCKETS) -> DataFrame:
    """O1: point lookup that prunes to one bucket; the key alone would not."""
    return df.where((F.col(key) == value) & (F.col("bucket") == bucket_of(F.lit(value), n_buckets)))


def without_file(df: DataFrame, name: str) -> DataFrame:
    """rows of a file scan that do not come from files called ``name``."""
    return df.where(F.col("_metadata.file_name") != name)


def compact(
    spark: SparkSession, kind: str, path: str, out: str, files: int | None = None, skip: str | None = None
) -> int:
    """Rewrite a layer sorted by its key, into a new folder.

    Ranges of (bucket, key, spread key) become files: each bucket is a run of sorted files
    with disjoint key ranges, so row-group statistics prune lookups. A key that fills more
    than one file is cut by the spread key. ``skip`` leaves out a file of an unbucketed layer,
    for example an earlier result kept beside its inputs. Returns the row count.
    """
    if kind in SORT_KEY:
        stored = read_bucketed(spark, kind, path, hide_bucket=False)
        order = ["bucket", SORT_KEY[kind], SPREAD_KEY[kind]]
    else:
        stored, order = read_bucketed(spark, kind, path), ["corpusid"]
        stored = without_file(stored, skip) if skip else stored
    ranged = stored.repartitionByRange(files, *order) if files else stored.repartitionByRange(*order)
    return write_counted(ranged.sortWithinPartitions(*order), out, partition_by="bucket" if kind in SORT_KEY else None)


# ---- generic sinks

def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished or partial output exists, on any file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_counted(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = None) -> int:
    """Committed zstd Parquet; the row count is observed during the write."""
    from pyspark.sql import Observation

    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return seen.get["rows"]


def committed_at(spark: SparkSession, path: str) -> int:
    """When the output at ``path`` was committed, in milliseconds; -1 if it was not."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    system = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(marker).getModificationTime() if system.exists(marker) else -1


def write_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: str | None = None,
    inputs: tuple[str, ...] = (),
) -> int:
    """Build and write unless a committed result exists; the row count either way.

    A result older than one of the ``inputs`` it was made from is built again.
    """
    written = committed_at(spark, path)
    if written >= 0 and all(committed_at(spark, source) <= written for source in inputs):
        return spark.read.parquet(path).count()
    return write_counted(build(), path, "overwrite", partition_by)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with NULL fields present."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """S28."""
    writer = df.write.mode(mode).option("header", "true")
    (writer.option("compression", "gzip") if gzip else writer).csv(path)
