"""Reading and writing feature tables as CSV, JSON or Parquet."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trackspark.schema import FEATURE_SCHEMA

log = logging.getLogger(__name__)
_KNOWN = {f.name: f.dataType for f in FEATURE_SCHEMA}


def table_format(path: str, format: str = "auto") -> str:
    """``json`` and ``parquet`` by suffix, anything else is CSV."""
    if format != "auto":
        if format not in ("csv", "json", "parquet"):
            raise ValueError(f"unknown format: {format}")
        return format
    for known in ("json", "parquet"):
        if path.rstrip("/").endswith(f".{known}"):
            return known
    return "csv"


def _csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Types by header name; only columns outside the known layout are inferred."""
    names = spark.read.option("header", True).csv(path).columns
    known = {n: _KNOWN[n.lower()] for n in names if n.lower() in _KNOWN}
    inferred: dict[str, T.DataType] = {}
    if len(known) < len(names):
        guess = spark.read.options(header=True, inferSchema=True).csv(path).schema
        inferred = {f.name: f.dataType for f in guess}
    return T.StructType(
        [T.StructField(n, known.get(n) or inferred.get(n, T.StringType())) for n in names]
    )


def _is_single_file(spark: SparkSession, path: str) -> bool:
    listed = spark.read.format("binaryFile").load(path).select("path").head()
    return listed is not None and listed.path.rstrip("/").endswith(path.rstrip("/").lstrip("."))


def load_features(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    """A feature table. Missing: FileNotFoundError. Unreadable: ValueError.

    JSON is one array when ``path`` is a single file and JSON lines when it is a
    directory written by Spark. Known columns get their declared type, so that an empty
    column stays numeric.
    """
    kind = table_format(path, format)
    try:
        if kind == "parquet":
            df = spark.read.parquet(path)
        elif kind == "json":
            single = _is_single_file(spark, path)
            reader = spark.read.option("multiLine", single).option("mode", "FAILFAST")
            fields = reader.json(path).schema
            schema = T.StructType(
                [T.StructField(f.name, _KNOWN.get(f.name.lower(), f.dataType)) for f in fields]
            )
            df = reader.schema(schema).json(path)
        else:
            df = (
                spark.read.schema(_csv_schema(spark, path))
                .options(header=True, mode="FAILFAST", quote='"', escape='"', multiLine=False)
                .csv(path)
            )
        df.head(1)  # surfaces an unreadable file here rather than in a later job
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no feature table at {path}") from e
        raise ValueError(f"the feature table {path} cannot be read: {e}") from e
    except PySparkException as e:
        raise ValueError(f"the feature table {path} cannot be read: {e}") from e
    except Exception as e:
        if "FAILED_READ_FILE" in str(e) or "Malformed" in str(e) or "MALFORMED" in str(e):
            raise ValueError(f"the feature table {path} cannot be read: {e}") from e
        raise


def save_features(
    df: DataFrame, path: str, format: str = "auto", mode: str = "overwrite"
) -> bool:
    """Write a feature table; parents are created. An empty table is not written.

    The result is a directory of part files (JSON: one object per line).
    """
    if df.isEmpty():
        log.warning("nothing to write: the table is empty")
        return False
    kind = table_format(path, format)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.format(kind).save(path)
    return True


def append_features(df: DataFrame, path: str, format: str = "auto") -> None:
    """Add rows to an existing table, column by column name.

    The table's own column order stays; columns that ``df`` lacks are null in its rows. Where the table lacks a column of ``df``, or is a single
    file, the whole table is written anew beside the old one and takes its place only when it is complete.
    """
    spark = df.sparkSession
    existing = load_features(spark, path, format)
    kind = table_format(path, format)
    own = {c.lower(): c for c in existing.columns}
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError(f"several columns of one name: {', '.join(df.columns)}")
    named = df.select(*[F.col(f"`{c}`").alias(own.get(c.lower(), c)) for c in df.columns])
    added = [c for c in named.columns if c not in existing.columns]
    if added or _is_single_file(spark, path):
        whole = existing.unionByName(named, allowMissingColumns=True)
        _replaced(spark, path, lambda where: save_features(whole, where, kind))
        return
    rows = named.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in existing.schema])
    save_features(rows, path, kind, mode="append")


def _replaced(spark: SparkSession, path: str, write: Callable[[str], object]) -> None:
    """Write a table beside the one at ``path``, then put it in its place. At every moment one of both is whole."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    write(fresh)
    fs.rename(Path(path), Path(old))
    fs.rename(Path(fresh), Path(path))
    fs.delete(Path(old), True)


def export_similar(similar: DataFrame, path: str) -> None:
    """Write a similarity result (a few rows) as one CSV part, best first."""
    similar.coalesce(1).sortWithinPartitions(F.desc("similarity_score")).write.mode(
        "overwrite"
    ).options(header=True, quote='"', escape='"').csv(path)
