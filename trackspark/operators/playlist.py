"""Successor and predecessor in circular playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from trackspark.operators import ordered
from trackspark.operators.skew import HOT_ROWS


def playlist_cycle(
    playlist: DataFrame,
    key: str = "playlist_id",
    pos: str = "pos",
    song: str = "song",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``next_song`` and ``previous_song``; the ends of a playlist are joined."""
    slices = ordered.find_slices(playlist, key, [pos], hot_rows)
    sliced = slices.apply(playlist.withColumn("_song", F.struct(F.col(song).alias("s"))))
    carries = []
    if slices.cuts is not None:
        ends = (
            sliced.where(ordered.HOT)
            .groupBy(key, ordered.SLICE)
            .agg(F.min_by("_song", pos).alias("_head"), F.max_by("_song", pos).alias("_end"))
        )
        by_slice = Window.partitionBy(key).orderBy(ordered.SLICE)
        whole = by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = ends.select(
            key,
            ordered.SLICE,
            F.coalesce(F.lag("_end").over(by_slice), F.last("_end").over(whole)).alias("_song"),
            F.lit(0).alias(ordered.SEQ),
        )
        after = ends.select(
            key,
            ordered.SLICE,
            F.coalesce(F.lead("_head").over(by_slice), F.first("_head").over(whole)).alias("_song"),
            F.lit(2).alias(ordered.SEQ),
        )
        carries = [before, after]
    w = ordered.window(key, [pos])
    group = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = (
        ordered.with_carry(sliced, *carries)
        .withColumn("_next", F.coalesce(F.lead("_song").over(w), F.first("_song").over(group)))
        .withColumn("_prev", F.coalesce(F.lag("_song").over(w), F.last("_song").over(group)))
        .withColumn("next_song", F.col("_next.s"))
        .withColumn("previous_song", F.col("_prev.s"))
    )
    return ordered.real_rows(linked, "_song", "_next", "_prev")


def first_steps(
    playlist: DataFrame, key: str = "playlist_id", pos: str = "pos", song: str = "song"
) -> DataFrame:
    """Per playlist, where the buttons lead before anything was played.

    The start index is -1, so "next" goes to the first entry and "previous" to the last
    but one (to the only entry of a one-song playlist).
    """
    top2 = (
        ordered.last_n_per_key(playlist.select(key, pos, song), key, [pos], 2)
        .groupBy(key)
        .agg(F.min_by(song, pos).alias("previous_song"))
    )
    first = playlist.groupBy(key).agg(F.min_by(song, pos).alias("next_song"))
    return first.join(top2, key)
