"""Similarity report as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackspark.functions.formats import band, duration_text, head, percent_text
from trackspark.functions.names import parsed_name

COLUMNS = ("rank", "title", "artist", "duration", "similarity", "band")


def result_rows(similar: DataFrame) -> DataFrame:
    """Ranked rows of ``file_path, duration, similarity_score, rank`` for display.

    Rows without a path are left out and keep their number.
    """
    shown = similar.where(F.coalesce(F.col("file_path") != "", F.lit(False))).withColumn(
        "_name", parsed_name("file_path")
    )
    seconds = F.col("duration").cast("double")
    return shown.withColumns(
        {
            "title": head("_name.title", 50),
            "artist": head("_name.artist", 30),
            "duration": duration_text(F.when(F.isnan(seconds), 0.0).otherwise(F.coalesce(seconds, F.lit(0.0)))),
            "similarity": percent_text("similarity_score"),
            "band": band("similarity_score"),
        }
    ).drop("_name")


def query_rows(queries: DataFrame, resolved_duration: str = "duration") -> DataFrame:
    """The asked-for songs: rank 0, 100 %, and 0 seconds where they were not found."""
    found = F.col("file_path").isNotNull()
    return (
        queries.withColumn("_name", parsed_name("song_path"))
        .withColumns(
            {
                "rank": F.lit(0),
                "title": F.col("_name.title"),
                "artist": F.col("_name.artist"),
                "duration": duration_text(F.when(found, F.col(resolved_duration)).otherwise(F.lit(0.0))),
                "similarity": F.lit("100%"),
                "band": F.lit("query"),
            }
        )
        .drop("_name")
    )


def similarity_report(queries: DataFrame, similar: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Query rows and their result rows: ``query_id`` and the report columns."""
    shown = [query_id, *COLUMNS]
    return query_rows(queries).select(*shown).unionByName(result_rows(similar).select(*shown))
