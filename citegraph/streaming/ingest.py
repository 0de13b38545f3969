"""Incremental ingestion: each shard is read once, however often the job is run."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources.layers import NORMALISERS, RAW_SCHEMAS, exists, quarantine, write_bucketed


def load_token(spark: SparkSession, checkpoint: str) -> str:
    """Name of a checkpoint's loads, drawn once and kept in the checkpoint folder.

    Two checkpoints never share a name, so the batch numbers of one cannot meet those of another.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/citegraph-load-name")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, False)
        out.writeUTF(uuid.uuid4().hex)
        out.close()
    source = files.open(path)
    try:
        return source.readUTF()
    finally:
        source.close()


def ingest(
    spark: SparkSession, kind: str, source: str, dest: str, checkpoint: str, max_files: int | None = None,
    bad_lines: str | None = None,
) -> int:
    """New shards of ``source`` into the bucketed layer at ``dest``; returns the rows added.

    The checkpoint keeps the list of finished files. Every micro-batch writes to its own
    sub-folder in overwrite mode, so a batch replayed after a lost driver replaces itself
    instead of adding its rows twice; the folder carries the checkpoint's own name, so no
    other checkpoint can replace it. With ``bad_lines`` malformed lines go to that folder with
    the name of their shard and all good lines go on; without it the first one stops the batch.
    """
    token = load_token(spark, checkpoint)
    schema = RAW_SCHEMAS[kind]
    reader = spark.readStream.option("pathGlobFilter", "*.gz")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if bad_lines is None:
        raw = reader.schema(schema).option("mode", "FAILFAST").json(source)
    else:
        raw = reader.schema(schemas.with_corrupt_record(schema)).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", "_corrupt_record").json(source).withColumn("_shard", F.input_file_name())

    added = []

    def write(batch: DataFrame, batch_id: int) -> None:
        if bad_lines is not None:
            bad = batch.where(F.col("_corrupt_record").isNotNull()).select("_shard", F.col("_corrupt_record").alias("line"))
            bad.write.mode("overwrite").json(f"{bad_lines}/load={token}-{batch_id}")
            batch = quarantine(batch.drop("_shard"))[0]
        seen = Observation()
        counted = NORMALISERS[kind](batch).observe(seen, F.count(F.lit(1)).alias("rows"))
        write_bucketed(counted, kind, f"{dest}/load={token}-{batch_id}", mode="overwrite")
        added.append(seen.get["rows"])

    running = (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return sum(added)


class BrokenShards(RuntimeError):
    """Shards that could not be read; all others are in the layer and the next run tries these again."""

    def __init__(self, reasons: dict[str, str]):
        super().__init__("shards not loaded: " + ", ".join(sorted(reasons)))
        self.reasons = reasons


def _read_all(spark: SparkSession, kind: str, shards: list[str]) -> DataFrame:
    return NORMALISERS[kind](spark.read.schema(RAW_SCHEMAS[kind]).option("mode", "FAILFAST").json(shards))


def broken_among(spark: SparkSession, kind: str, shards: list[str]) -> dict[str, str]:
    """The shards that cannot be read to their end, with the reason, found by halving.

    Whole halves are read by one job each; b broken shards among n take about 2 b log2(n) jobs.
    """
    try:
        _read_all(spark, kind, shards).write.format("noop").mode("overwrite").save()
        return {}
    except Exception as error:  # noqa: BLE001 - whatever a shard breaks with becomes its verdict
        if len(shards) == 1:
            return {shards[0]: str(error)[:1000]}
    half = len(shards) // 2
    return broken_among(spark, kind, shards[:half]) | broken_among(spark, kind, shards[half:])


def shard_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, load, loaded, reason): the newest outcome of every shard."""
    schema = "shard string, load long, attempt long, loaded boolean, reason string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema).drop("attempt")
    newest = spark.read.schema(schema).json(f"{path}/*/*.json").groupBy("shard").agg(
        F.max_by(F.struct("load", "loaded", "reason"), "attempt").alias("v"))
    return newest.select("shard", "v.*")


def ingest_with_verdicts(
    spark: SparkSession, kind: str, source: str, dest: str, checkpoint: str, verdicts: str, max_files: int = 256,
) -> int:
    """Like ``ingest``, but one broken shard holds up no other; returns the rows added.

    The stream carries the names of new shards only, at most ``max_files`` in a micro-batch. A batch
    is written in one job; only if that fails are its broken shards looked for (bad line, truncated
    archive), left out, and recorded under ``verdicts`` with the reason. Shards whose newest verdict
    is a failure are tried again first by the next run. A run that leaves any behind ends with
    ``BrokenShards`` after everything else is committed. Data and verdicts of a load have names of
    their own and replace themselves when the load is repeated.
    """
    token = load_token(spark, checkpoint)
    added, reasons = [], {}

    def load(shards: list[str], name: str, number: int, attempt: int) -> None:
        def write(good: list[str]) -> int:
            seen = Observation()
            rows = _read_all(spark, kind, good).observe(seen, F.count(F.lit(1)).alias("rows"))
            write_bucketed(rows, kind, f"{dest}/load={token}-{name}", mode="overwrite")
            return seen.get["rows"]

        broken: dict[str, str] = {}
        try:
            added.append(write(shards))
        except Exception:  # noqa: BLE001 - the halving below finds out which shards it was
            broken = broken_among(spark, kind, shards)
            good = [shard for shard in shards if shard not in broken]
            if not broken:
                raise
            if good:
                added.append(write(good))
        for shard in shards:
            reasons.pop(shard, None)
        reasons.update(broken)
        outcome = [(shard, number, attempt, shard not in broken, broken.get(shard)) for shard in shards]
        spark.createDataFrame(outcome, "shard string, load long, attempt long, loaded boolean, reason string").coalesce(1).write.mode(
            "overwrite").json(f"{verdicts}/load={token}-{name}")

    known = shard_verdicts(spark, verdicts)
    again = {row.shard: row.loaded for row in known.where(~F.col("loaded") | (F.col("load") < 0)).select("shard", "loaded").collect()}
    last = spark.read.json(f"{verdicts}/*/*.json").agg(F.max("attempt")).first()[0] if exists(spark, verdicts) else None
    attempt = 1 if last is None else last + 1
    for shard in sorted(name for name, loaded in again.items() if not loaded):
        # A folder per shard: however often the repeat is cut short, its rows replace themselves.
        load([shard], "again-" + hashlib.md5(shard.encode()).hexdigest(), -1, attempt)

    def batch_of(batch: DataFrame, batch_id: int) -> None:
        # A batch repeated after a lost driver leaves out what has been tried again on its own.
        shards = sorted(row.path for row in batch.select("path").collect() if row.path not in again)
        if shards:
            load(shards, str(batch_id), batch_id, attempt)

    # The content is never selected, so no bytes of the shards are read here.
    file_schema = "path string, modificationTime timestamp, length long, content binary"
    names = spark.readStream.format("binaryFile").schema(file_schema).option("pathGlobFilter", "*.gz").option("maxFilesPerTrigger", max_files).load(source)
    names.select("path").writeStream.foreachBatch(batch_of).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    if reasons:
        raise BrokenShards(reasons)
    return sum(added)


def append_new(units: DataFrame, key: list[str], path: str, build, partition_by: str | None = None, slices: int = 1) -> None:
    """Run ``build`` on the units not stored at ``path`` yet and append the result.

    Units are dealt to ``slices`` by a hash of their key and committed slice by slice. A
    committed append is the finished marker, so a run cut short loses the current slice only.
    """
    spark = units.sparkSession
    for number in range(slices):
        todo = units.where(F.pmod(F.xxhash64(*key), F.lit(slices)) == number)
        if exists(spark, path):
            done = spark.read.parquet(path).select(*[F.col(k) for k in key]).distinct()
            todo = todo.join(done, key, "left_anti")
        writer = build(todo).write.mode("append").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
