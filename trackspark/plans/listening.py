"""Play log + library -> next-song queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackspark.operators import history, knn, ordered, playback, queue
from trackspark.operators.skew import HOT_ROWS
from trackspark.session import materialise, materialise_table
from trackspark.schema import (
    HISTORY_SIZE,
    OVERFETCH,
    QUEUE_REQUEST,
    QUEUE_SIZE,
    REFRESH_EVERY,
)


def neighbours_of_seeds(
    seeds: DataFrame, library: DataFrame, index: knn.NeighbourIndex, k: int, id_col: str = "id"
) -> DataFrame:
    """Neighbours of the distinct ``seed`` values of a table, each searched once."""
    wanted = seeds.select(F.col("seed").alias(id_col)).distinct()
    return knn.knn_join(index, library.join(wanted, id_col, "left_semi"), k, id_col=id_col)


def user_queues(
    plays: DataFrame,
    library: DataFrame,
    request: int = QUEUE_REQUEST,
    size: int = QUEUE_SIZE,
    overfetch: int = OVERFETCH,
    history_size: int = HISTORY_SIZE,
    index: knn.NeighbourIndex | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per user, the queue that follows the latest play: ``user_id, seed, history, queue``.

    ``plays``: ``user_id, ts, event_id, song``; ``library``: ``id, vector``.
    """
    k = request * overfetch
    listeners = materialise(history.recent_songs(plays, history_size))  # one row per user
    index = index or knn.build_index(library, k)
    near = neighbours_of_seeds(listeners, library, index, k)
    return queue.queues(listeners, near, request, size, "user_id", hot_rows)


def auto_played(
    plays: DataFrame,
    library: DataFrame,
    request: int = QUEUE_REQUEST,
    size: int = QUEUE_SIZE,
    overfetch: int = OVERFETCH,
    history_size: int = HISTORY_SIZE,
    refresh_every: int = REFRESH_EVERY,
    index: knn.NeighbourIndex | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What the queue rules play at every auto-advance of a log.

    ``plays`` has ``is_auto`` and the ``song`` that was current when the advance came
    (for a manual start: the song started). A queue is built at a manual start or a
    refresh from that row's song and the history up to it, and serves the advances of
    its epoch. Returns the auto-advances with ``next_id`` (null without a queue).
    """
    k = request * overfetch
    order = history.ORDER
    slices = ordered.find_slices(plays, "user_id", order, hot_rows)
    keep = slices.between_scans
    logged = keep(history.history_at_each_play(plays, history_size, slices=slices))
    numbered = keep(playback.auto_advances(logged, refresh_every=refresh_every, slices=slices))
    # A queue is known by the row that built it.
    starts = F.col("slot") == 0
    numbered = materialise_table(
        ordered.last_known(numbered, slices, F.when(starts, F.col("event_id")), "built_at").withColumn(
            "history", F.when(starts, F.col("history"))
        )
    )
    builders = numbered.where(starts).select(
        "user_id", *order, "is_auto", F.col("song").alias("seed"), "history"
    )
    index = index or knn.build_index(library, k)
    near = materialise_table(neighbours_of_seeds(builders, library, index, k))  # what the search shuffles goes before the log is shuffled
    built = queue.queues(builders, near, request, size, "event_id", hot_rows).drop("history", "seed")
    # An empty queue is not rebuilt before the next manual start, nor is there a queue
    # before the first one.
    empty, manual = F.coalesce(F.size("queue"), F.lit(0)) <= 0, ~F.col("is_auto")
    built = keep(ordered.last_known(built, slices, F.when(manual, ~empty), "_began"))
    built = ordered.count_since(built, slices, empty, manual, "_gaps")
    usable = F.coalesce("_began", F.lit(False)) & (F.col("_gaps") == 0)
    built = built.where(usable).select(F.col("event_id").alias("built_at"), "queue")
    advances = numbered.where("is_auto").drop("history")
    return queue.next_from_queue(advances.join(built, "built_at", "left"))
