"""Session helpers: sensible builder settings and fault-tolerant materialisation."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that suit these jobs on any cluster. Partition counts are left to AQE,
# which coalesces a generous initial number down to advisory-sized partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def builder(app_name: str = "trackspark", **extra: str) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        b = b.config(key, value)
    return b


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


_kept: ContextVar[list | None] = ContextVar("kept", default=None)


@contextmanager
def releasing() -> Iterator[None]:
    """Drop what is materialised inside the block when it ends.

    For work that runs again and again in one session, such as micro-batches, and for
    intermediates that are much larger than their result.
    """
    token = _kept.set([])
    try:
        yield
    finally:
        for release in _kept.get() or []:
            release()
        _kept.reset(token)


@contextmanager
def keeping() -> Iterator[None]:
    """Exempt what is materialised inside the block from an enclosing :func:`releasing`."""
    token = _kept.set(None)
    try:
        yield
    finally:
        _kept.reset(token)


def _on_release(action) -> None:
    if _kept.get() is not None:
        _kept.get().append(action)


def _persisted(df: DataFrame) -> DataFrame:
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _on_release(kept.unpersist)
    return kept


def materialise(df: DataFrame) -> DataFrame:
    """Keep ``df`` so that several consumers do not recompute it.

    With a shared checkpoint folder the rows are written there and survive lost
    executors without recomputation; otherwise they are persisted with their
    lineage, so lost blocks are recomputed. Callers only pass deterministic plans,
    which makes both routes give the same rows. Spark removes checkpoints that are no
    longer referenced (``cleanCheckpoints`` in ``SETTINGS``). What was shuffled for a checkpoint
    is removed as soon as it is written, since nothing reads it again.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        return _persisted(df)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    with _shuffles_removed(spark):
        return df.checkpoint(eager=True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of the queries run inside the block when each ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise_table(df: DataFrame) -> DataFrame:
    """Like :func:`materialise`, for wide rows whose consumers read different columns: the
    checkpoint is a Parquet table, so each reads only its own."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        return _persisted(df)
    path = f"{folder}/trackspark-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)

    def remove() -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    _on_release(remove)
    return spark.read.schema(df.schema).parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Spread the rows of a scan with fewer splits than cores before costly map work.

    Large tables have enough splits and are left alone. Only for plans without a shuffle:
    counting the partitions of others would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application.

    Same effect as submitting with ``--py-files``; needed where the package is neither
    installed on the workers nor in their start folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(), "trackspark"), "zip", os.path.dirname(here), os.path.basename(here)
    )
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
