"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PARTITIONS_KEY = "spark.sql.shuffle.partitions"
#: A stream's stores of state per core, at most.
STORES_PER_CORE = 16
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 2 << 20
_STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: RocksDB for streaming state, with megabytes of memory for all stores of an executor together.
_STATE_ON_DISK = {
    _STATE_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in this process, as in tests, a
    temporary folder takes its place: elsewhere a machine-local path would lose
    its files together with the executor.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_KEY, None
    )
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="folioflow-")
    return _OWN_FOLDERS[app]


#: Folders made for sessions that name none, and the paths handed out below any, by application.
_OWN_FOLDERS: dict[str, str] = {}
_PATHS: dict[str, list[str]] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, *more: str) -> None:
    """Delete the working files of this session, and ``more``. Call it when the results that read them are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [*_PATHS.pop(spark.sparkContext.applicationId, []), *more]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage where later steps read a frame several times. The copy is
    columnar, so every reader still takes only the columns it needs, and it
    outlives lost executors.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    held = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each write inside when it is done; else they stay until the driver happens to collect its garbage."""
    with _settings(spark, {_CLEANUP_KEY: "true"}):
        yield


@contextmanager
def few_stores(spark: SparkSession) -> Iterator[None]:
    """Streams started inside deal their state over a number of stores that the cores bound, not the data.

    All stores stay open in their executors; each costs some megabytes and a part of a second a batch, however little it holds.
    """
    most = STORES_PER_CORE * spark.sparkContext.defaultParallelism
    with _settings(spark, {_PARTITIONS_KEY: str(min(most, int(spark.conf.get(_PARTITIONS_KEY))))}):
        yield


def lean_copy(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``materialize``, where copies are large beside the disk: packed with zstd, its shuffle files gone; and its path, for ``discard``."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a copy that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _PATHS[spark.sparkContext.applicationId].remove(path)


def bound_batches(spark: SparkSession) -> None:
    """Keep what one Python worker gets at a time small: a text takes many times its size there, in objects and results.

    A session that sets its own bound keeps it. Rows are never cut, only dealt over more batches.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


def state_on_disk(spark: SparkSession) -> None:
    """Keep the state of streams on the executors' disks: by default each version of all of it lies in their heaps.

    A session that chose a provider keeps it, and its settings, as a checkpoint keeps the provider it was begun with.
    """
    if spark.conf.get(_STATE_PROVIDER, None) is None:
        for name, value in _STATE_ON_DISK.items():
            if spark.conf.get(name, None) is None:
                spark.conf.set(name, value)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_folioflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="folioflow-package-"), "folioflow")
    context.addPyFile(shutil.make_archive(target, "zip", root, "folioflow"))
    context._folioflow_shipped = True
