"""Song-end detection from player samples, playback modes and auto-advances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trackspark.operators import ordered
from trackspark.operators.skew import HOT_ROWS
from trackspark.schema import REFRESH_EVERY

ORDER = ("ts", "event_id")


def song_ends(
    status: DataFrame,
    device: str = "device_id",
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Samples at which a song ended by itself.

    ``status`` has ``is_busy, is_playing, song``. After a busy sample, the first idle
    sample of the same song settles it: an end if the player still means to play, a
    pause otherwise. Idle samples of another song settle nothing.
    """
    busy = F.coalesce(F.col("is_busy"), F.lit(False))
    run = F.when(busy, F.struct(*order, F.col("song").alias("_playing_song")))
    samples = status.select(device, *order, "is_busy", "is_playing", "song")
    seen = ordered.last_known(
        samples, ordered.find_slices(samples, device, order, hot_rows), run, "_run"
    )
    settled = seen.where(
        ~busy & F.col("_run").isNotNull() & F.col("song").eqNullSafe(F.col("_run._playing_song"))
    )
    # Runs are many even for a busy device, and min_by combines before the shuffle.
    first = settled.groupBy(device, F.struct(*[F.col(f"_run.{o}") for o in order]).alias("_id")).agg(
        F.min_by(F.struct(*order, "is_playing", "song"), F.struct(*order)).alias("_s")
    )
    return first.where("_s.is_playing").select(
        device, *[F.col(f"_s.{o}").alias(o) for o in order], F.col("_s.song").alias("song")
    )


def playback_modes(
    toggles: DataFrame,
    user: str = "user_id",
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every toggle (``kind`` is ``auto`` or ``loop``) with the ``mode`` it leaves.

    Both switches start off and exclude each other, so after the r-th toggle in a row
    of one kind that kind is on for odd r, and nothing is on for even r.
    """
    auto, loop = F.col("kind") == "auto", F.col("kind") == "loop"
    slices = ordered.find_slices(toggles, user, order, hot_rows)
    t = slices.between_scans(ordered.count_since(toggles, slices, auto, loop, "_auto"))
    t = ordered.count_since(t, slices, loop, auto, "_loop")
    r = F.when(auto, F.col("_auto")).otherwise(F.col("_loop"))
    return t.withColumn("mode", F.when(r % 2 == 1, F.col("kind")).otherwise("none")).drop(
        "_auto", "_loop"
    )


def mode_at(
    ends: DataFrame,
    modes: DataFrame,
    user: str = "user_id",
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As-of join: each song end with the mode in force and the resulting ``action``."""
    both = ends.withColumn("_mode", F.lit(None).cast("string")).withColumn("_end", F.lit(True)).unionByName(
        modes.select(user, *order, F.col("mode").alias("_mode"), F.lit(False).alias("_end")),
        allowMissingColumns=True,
    )
    slices = ordered.find_slices(both, user, order, hot_rows)
    known = ordered.last_known(both, slices, F.col("_mode"), "mode")
    mode = F.coalesce("mode", F.lit("none"))
    return (
        known.where("_end")
        .drop("_mode", "_end")
        .withColumn("mode", mode)
        .withColumn(
            "action",
            F.when(F.col("mode") == "loop", "replay").when(F.col("mode") == "auto", "next_in_queue").otherwise("stop"),
        )
    )


def auto_advances(
    plays: DataFrame,
    is_auto: str = "is_auto",
    refresh_every: int = REFRESH_EVERY,
    user: str = "user_id",
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
    slices: ordered.Slices | None = None,
) -> DataFrame:
    """Number the auto-advances since the last manual start and lay out the queue epochs.

    ``advance`` is 0 for a manual start. A queue serves ``refresh_every`` advances:
    ``epoch`` counts the queues, ``slot`` the position asked of the current one, and
    ``refresh`` marks the advances that rebuild it from the song just played.
    """
    auto = F.col(is_auto)
    slices = slices or ordered.find_slices(plays, user, order, hot_rows)
    numbered = ordered.count_since(plays, slices, auto, ~auto, "advance")
    a = F.col("advance")
    return (
        numbered.withColumn("epoch", F.floor(a / refresh_every))
        .withColumn("slot", (a % refresh_every))
        .withColumn("refresh", (a > 0) & (a % refresh_every == 0))
    )
