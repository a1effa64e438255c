"""Bounded play history and walking back through it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trackspark.operators import ordered
from trackspark.operators.skew import HOT_ROWS
from trackspark.schema import HISTORY_SIZE

ORDER = ("ts", "event_id")


def recent_plays(
    plays: DataFrame,
    size: int = HISTORY_SIZE,
    user: str = "user_id",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The last ``size`` plays of every user, repeats kept."""
    return ordered.last_n_per_key(plays, user, order, size)


def recent_songs(
    plays: DataFrame,
    size: int = HISTORY_SIZE,
    user: str = "user_id",
    song: str = "song",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """One row per user: ``history`` (at most ``size`` songs, oldest first) and ``seed``.

    ``seed`` is the latest play, from which the next queue is built.
    """
    latest = recent_plays(plays.select(user, song, *order), size, user, order)
    entry = F.struct(*order, F.col(song).alias("_song"))
    return latest.groupBy(user).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["_song"]).alias("history")
    ).withColumn("seed", F.element_at("history", -1))


def history_at_each_play(
    plays: DataFrame,
    size: int = HISTORY_SIZE,
    user: str = "user_id",
    song: str = "song",
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
    slices: ordered.Slices | None = None,
) -> DataFrame:
    """Every play with ``history``: the last ``size`` songs up to and including it."""
    slices = slices or ordered.find_slices(plays, user, order, hot_rows)
    rows = ordered.with_preceding(plays, slices, [song], size - 1)
    w = ordered.window(user, order).rowsBetween(-(size - 1), 0)
    # collect_list skips nulls, so an unknown song travels inside a struct.
    songs = F.collect_list(F.struct(F.col(song).alias("s"))).over(w)
    return ordered.real_rows(rows.withColumn("history", F.transform(songs, lambda e: e["s"])))


def previous_track(
    plays: DataFrame,
    steps: int = 1,
    user: str = "user_id",
    song: str = "song",
    order: Sequence[str] = ORDER,
    out: str = "previous",
    hot_rows: int = HOT_ROWS,
    slices: ordered.Slices | None = None,
) -> DataFrame:
    """Every play with the song that ``steps`` presses of "previous" would reach."""
    slices = slices or ordered.find_slices(plays, user, order, hot_rows)
    rows = ordered.with_preceding(plays, slices, [song], steps)
    return ordered.real_rows(
        rows.withColumn(out, F.lag(song, steps).over(ordered.window(user, order)))
    )
