"""Reading listed files piece by piece at byte positions, so that a long file is many tasks' work.

Tasks open files themselves, through Arrow's file systems. That reaches paths that workers see under the same name (``file:``, as Spark's own
readers need it too) and stores that Arrow knows. Anything else is read by Spark, whole files at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackspark.sources.wav import Layout, Read, layout

#: Schemes that tasks open themselves unless told otherwise.
OPENED = ("file",)
LAYOUT_FIELDS = "floating boolean, width int, channels int, rate int, offset bigint, frames bigint"
LAYOUT_COLUMNS = [f.split(" ")[0] for f in LAYOUT_FIELDS.split(", ")]
LISTED = "file_path string, file_name string, file_extension string, file_size_mb double, path string, length bigint"


def scheme(spark: SparkSession, directory: str) -> str:
    """The scheme a path belongs to, with the session's default file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getScheme()


@contextmanager
def opened(path: str) -> Iterator[Read]:
    """``read(offset, size)`` of a listed file."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        system, name = arrow_fs.LocalFileSystem(), path.removeprefix("file:")
        name = "/" + name.lstrip("/")
    else:
        system, name = arrow_fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}{quote(path.split(parts.netloc, 1)[1])}")
    with system.open_input_file(name) as f:
        yield lambda offset, size: f.read_at(size, offset)


def probed(files: DataFrame, sr: int) -> DataFrame:
    """Adds ``error`` and the layout of listed files; of each file only its header is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors, found = [], []
            for path, size, extension in zip(b["path"].to_pylist(), b["length"].to_pylist(), b["file_extension"].to_pylist()):
                try:
                    with opened(path) as read:
                        found.append(layout(read, size, extension, sr))
                    errors.append(None)
                except Exception as e:  # any fault of this file stays with this file
                    found.append(None)
                    errors.append(str(e) or type(e).__name__)
            columns = [pa.array([None if f is None else getattr(f, c) for f in found]) for c in LAYOUT_COLUMNS]
            kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(errors, pa.string()), *[c.cast(k) for c, k in zip(columns, kinds)]], names=[*b.schema.names, "error", *LAYOUT_COLUMNS]
            )

    return files.mapInArrow(run, f"{LISTED}, error string, {LAYOUT_FIELDS}")


def layout_of(row: dict) -> Layout:
    return Layout(*[row[c] for c in LAYOUT_COLUMNS])


def length_at(sr: int) -> Column:
    """Samples of a probed file at the rate ``sr``."""
    return F.expr(f"(frames * {sr}L + rate - 1) div rate")


def with_pieces(files: DataFrame, sr: int, piece: int) -> DataFrame:
    """Probed files, a row per piece: samples ``start .. stop-1`` at the rate ``sr``. The last piece ends past the signal; it owns
    the frame at the end. ``piece`` is a multiple of the frames' hops."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor(length_at(sr) / piece).cast("bigint"))
    return (
        files.where("error is null")
        .withColumn("at", F.explode(starts))
        .withColumns({"start": F.col("at") * piece, "stop": (F.col("at") + 1) * piece})
        .drop("at", "error")
    )

