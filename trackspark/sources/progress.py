"""Finished parts of a long batch run, kept until the run is complete."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


class ProgressLog:
    """Parts of a run's result in a folder beside its output, one Parquet table each.

    A part counts once Spark has committed all of it (its ``_SUCCESS`` file is there); what a killed run left unfinished is ignored and
    removed. Parts belong to runs with the same ``settings``; others don't see them.
    """

    def __init__(self, spark: SparkSession, output: str, settings: str):
        self.spark = spark
        self.folder = f"{output.rstrip('/')}.progress/{hashlib.md5(settings.encode()).hexdigest()}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """Committed parts. Their number is that of the parts of one run."""
        where = self._path(self.folder)
        if not self._fs.exists(where):
            return []
        found = []
        for status in self._fs.listStatus(where):
            at = status.getPath()
            if self._fs.exists(self._path(at, "_SUCCESS")):
                found.append(at.toString())
            else:
                self._fs.delete(at, True)
        return sorted(found)

    def finished(self) -> DataFrame | None:
        """Rows of all committed parts; None without any. Nothing is read before the rows are asked for."""
        found = self.parts()
        return self.spark.read.parquet(*found) if found else None

    def commit(self, rows: DataFrame) -> None:
        rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder}/part-{uuid.uuid4().hex}")

    def clear(self) -> None:
        self._fs.delete(self._path(self.folder), True)
        above = self._path(self.folder).getParent()
        if self._fs.exists(above) and not self._fs.listStatus(above):
            self._fs.delete(above, False)
