"""Shared-folder tables and the small text helpers that several operators use."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackspark.session import ship_package

#: The characters `[\x20\x09-\x0D]`, which separate words. ``bytes.split()`` splits at the same ones.
SPACES = " \t\n\x0b\f\r"

_written: list[tuple[weakref.ref, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where nothing is set (tests on one machine) a temporary folder is set instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Results are lazy and read these tables later, so the tables stay until the driver ends, or until :func:`drop_table`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of :func:`write_table` that nothing reads any more: no result that isn't written yet may depend on them."""
    for t in tables:
        delete_path(t.sparkSession, t.written_at)


def written() -> list[str]:
    """Paths of everything written to the shared folder so far, in order."""
    return [path for _, path in _written]


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        delete_path(spark, path)


@atexit.register
def _remove() -> None:
    for session, path in _written:
        spark = session()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # the session may have ended before the driver, or another table's folder may be gone
            continue


def give_back() -> None:
    """Return to the system what Arrow and the C library have kept of freed memory."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """A task body that leaves no memory behind in its worker, which goes on to serve other stages. ``forget`` empties the
    worker's caches: a function of a module, so that it finds the worker's and not a copy."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return task


def stretches(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows whose texts (the column of that number) have about ``most`` bytes together, or that are one row:
    so much is made Python objects at a time, however much comes in a batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = done = 0
    while begin < len(ends):
        stop = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(begin, stop - begin)
        begin, done = stop, int(ends[stop - 1])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % n


def held_out(doc_id: Column | str, n: int, r: int) -> Column:
    """Whether the remainder is ``r``; false for a null id."""
    return F.coalesce(remainder(doc_id, n) == r, F.lit(False))


def crc_remainder(doc_id: int | None, n: int) -> int:
    """:func:`remainder` inside a task; -1 for a null id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n
