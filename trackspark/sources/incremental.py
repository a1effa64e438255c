"""Working on new files only, and keeping count of what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pending(catalog: DataFrame, existing: DataFrame | None, key: str = "file_path") -> DataFrame:
    """Catalogue rows whose key is not in ``existing``."""
    if existing is None:
        return catalog
    return catalog.join(existing.select(key), key, "left_anti")


def merged(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Existing rows followed by new ones."""
    return new if existing is None else existing.unionByName(new, allowMissingColumns=True)


def ingest_counts(status: DataFrame, is_error, is_known) -> DataFrame:
    """One row ``new, skipped, errors`` from boolean conditions on the rows."""
    return status.agg(
        F.count_if(~is_known & ~is_error).alias("new"),
        F.count_if(is_known).alias("skipped"),
        F.count_if(~is_known & is_error).alias("errors"),
    )
