"""Scanning folders of audio files."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackspark.functions.paths import base_name, local_path, size_mib, suffix
from trackspark.schema import AUDIO_SUFFIXES
from trackspark.session import materialise


def name_filter(suffixes: Sequence[str] = AUDIO_SUFFIXES) -> str:
    return "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"


def scan_files(
    spark: SparkSession, directory: str, suffixes: Sequence[str] = AUDIO_SUFFIXES
) -> DataFrame:
    """Supported files below ``directory`` with their bytes (read only if selected).

    Suffixes are matched case-sensitively, as a file system lookup would. Spark skips
    names that start with ``.`` or ``_`` and files without any bytes; :func:`walk_files` doesn't.
    """
    try:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", name_filter(suffixes))
            .load(directory)
        )
    except AnalysisException as e:
        raise ValueError(f"No such folder: {directory}") from e


def walk_files(spark: SparkSession, directory: str, suffixes: Sequence[str] = AUDIO_SUFFIXES) -> DataFrame:
    """``path, modificationTime, length`` of the supported files below a ``file:`` folder that the workers see too.

    Unlike :func:`scan_files` it lists names that start with ``.`` or ``_`` and files without any bytes. Folders are listed by tasks, one
    level after the other; linked folders aren't followed. A folder that can't be read has no files.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.getFileStatus(where).isDirectory():
        raise ValueError(f"No such folder: {directory}")
    endings = tuple(suffixes)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column("path").to_pylist():
                rows: list[tuple] = []
                try:
                    with os.scandir(folder.removeprefix("file:")) as entries:
                        for e in entries:
                            try:
                                if e.is_dir(follow_symlinks=False):
                                    rows.append((f"{folder.rstrip('/')}/{e.name}", None, None, True))
                                elif e.name.endswith(endings) and e.is_file():
                                    s = e.stat()
                                    rows.append((f"{folder.rstrip('/')}/{e.name}", datetime.fromtimestamp(s.st_mtime, timezone.utc), s.st_size, False))
                            except OSError:  # gone meanwhile
                                continue
                except OSError:
                    pass
                columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
                kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "modificationTime", "length", "is_folder"])

    level = spark.createDataFrame([(system.makeQualified(where).toString(),)], "path string")
    files = None
    while True:
        found = materialise(level.mapInArrow(listed, "path string, modificationTime timestamp, length bigint, is_folder boolean"))
        here = found.where("not is_folder").drop("is_folder")
        files = here if files is None else files.unionByName(here)
        folders = found.where("is_folder").select("path")
        n = folders.count()
        if n == 0:
            return files
        level = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))


def file_attributes(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """``file_path, file_name, file_extension, file_size_mb`` of listed files."""
    p = local_path(path)
    return files.select(
        p.alias("file_path"),
        base_name(p).alias("file_name"),
        suffix(p).alias("file_extension"),
        size_mib(length).alias("file_size_mb"),
    )


def audio_catalog(
    spark: SparkSession, directory: str, suffixes: Sequence[str] = AUDIO_SUFFIXES
) -> DataFrame:
    """Attributes of all supported files, sorted by path; file contents are not read."""
    files = scan_files(spark, directory, suffixes).select("path", "length")
    return file_attributes(files).orderBy("file_path")


def full_catalog(spark: SparkSession, directory: str, suffixes: Sequence[str] = AUDIO_SUFFIXES) -> DataFrame:
    """:func:`audio_catalog` with hidden and empty files."""
    return file_attributes(walk_files(spark, directory, suffixes)).orderBy("file_path")
