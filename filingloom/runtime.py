"""Session helpers: durable intermediate tables and scan parallelism."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    """Local session used by the tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("filingloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def durable_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's shared checkpoint folder.

    Only a local session may fall back to a scratch folder; on a cluster a
    machine-local folder would be lost together with its executor.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if root:
        if root.startswith("file:") and not context.master.startswith("local"):
            warnings.warn(
                f"{CHECKPOINT_KEY} is {root}: it must be mounted on every machine of the cluster",
                stacklevel=2,
            )
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="filingloom-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    context.setCheckpointDir(scratch)
    return scratch


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a table is read several times or where an iterative job must
    forget its history. The copy survives the loss of executors, keeps column
    pruning, and gives later joins real sizes to plan with.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{durable_root(spark)}/filingloom/{app}/{name}-{uuid.uuid4().hex}"
    # what was shuffled for the table goes as soon as it is stored
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._durable_path = path
    return stored


def stored_path(table: DataFrame) -> str:
    """Where a stored table lies, for tasks that read it whole."""
    return table._durable_path


def stored_batches(path: str) -> Iterator[pa.RecordBatch]:
    """The rows of a stored table, read inside a task: only for tables with a fixed bound."""
    files, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return dataset.dataset(folder, filesystem=files, format="parquet").to_batches()


def release(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing will read any more."""
    for table in tables:
        path = getattr(table, "_durable_path", None)
        if path:
            _delete(table.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all stored tables of this application: call it when the results are written."""
    app = spark.sparkContext.applicationId
    _delete(spark, f"{durable_root(spark)}/filingloom/{app}")


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """Broadcast hint for a table whose row count was checked; else unchanged.

    The check reads at most ``limit + 1`` rows, so hand over a stored or literal table.
    """
    if df.limit(limit + 1).count() > limit:
        return df
    return F.broadcast(df)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the scan yields fewer splits than cores.

    One big row group is one task. Inputs with enough splits pass unchanged, so
    large tables never pay for this shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
