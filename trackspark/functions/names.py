"""Artist and title from file names, and defaults for missing tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackspark import schema as S
from trackspark.functions.paths import base_name, col, stem, strip

# i: ignore case; U: Unicode white space and digits; d: only \n ends a line.
_FLAGS = "(?iUd)"


def _or_default(pattern: str, group: int, name: Column, default: Column) -> Column:
    found = F.regexp_extract(name, _FLAGS + pattern, group)
    return F.when(found == "", default).otherwise(strip(found))


def parsed_name(path: Column | str, track_numbers: bool = False) -> Column:
    """Struct ``filename, title, artist, duration, similarity[, track_num]``.

    A leading number counts as the artist, as it does in existing reports;
    ``track_numbers=True`` reads ``01 - Artist - Title`` as a numbered track instead.
    """
    path = col(path)
    name = stem(path)
    artist = _or_default(S.NAME_PATTERN, 1, name, F.lit(S.UNKNOWN_ARTIST))
    title = _or_default(S.NAME_PATTERN, 2, name, name)
    number = F.lit(None).cast("string")
    if track_numbers:
        numbered = name.rlike(_FLAGS + "^" + S.NUMBERED_NAME_PATTERN)
        anchored = "^" + S.NUMBERED_NAME_PATTERN
        artist = F.when(
            numbered, _or_default(anchored, 2, name, F.lit(S.UNKNOWN_ARTIST))
        ).otherwise(artist)
        title = F.when(numbered, _or_default(anchored, 3, name, name)).otherwise(title)
        number = F.when(numbered, F.regexp_extract(name, _FLAGS + anchored, 1))
    fields = [
        base_name(path).alias("filename"),
        title.alias("title"),
        artist.alias("artist"),
        F.lit("--:--").alias("duration"),
        F.lit(0.0).alias("similarity"),
    ]
    if track_numbers:
        fields.append(number.alias("track_num"))
    return F.struct(*fields)


def with_tags(catalog: DataFrame, tags: DataFrame, path: str = "file_path") -> DataFrame:
    """Left-join a tag table and fill absent tags.

    A missing title falls back to the base name. A tag row is looked up by path, so a
    path unknown to ``tags`` is a file whose tags could not be read: every field then
    is the ``Unknown`` text.
    """
    t = tags.select(
        path,
        F.col("title").alias("_title"),
        F.col("artist").alias("_artist"),
        F.col("album").alias("_album"),
        F.lit(True).alias("_tagged"),
    )
    return (
        catalog.join(t, path, "left")
        .withColumn(
            "title",
            F.when(F.col("_tagged"), F.coalesce("_title", base_name(path))).otherwise(
                F.lit(S.UNKNOWN_TITLE)
            ),
        )
        .withColumn("artist", F.coalesce("_artist", F.lit(S.UNKNOWN_ARTIST)))
        .withColumn("album", F.coalesce("_album", F.lit(S.UNKNOWN_ALBUM)))
        .drop("_title", "_artist", "_album", "_tagged")
    )
