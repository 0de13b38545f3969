"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "citegraph", **conf) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CITEGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Functions of the package are pickled by name, so workers must be able to import it.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="citegraph-ship-"), "citegraph")
        archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        _shipped[app] = archive
    return spark


def _shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="citegraph-checkpoint-")
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back from there.

    Used where several branches consume one expensive result. A Parquet table survives lost
    executors like a checkpoint does, and its readers prune columns and know its size. The
    folder is the one the cluster names in ``spark.checkpoint.dir``; a local session without
    it gets its own, a cluster without it is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        context.setCheckpointDir(_shared_folder(spark))
        folder = context.getCheckpointDir()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
