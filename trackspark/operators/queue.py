"""Next-song queues from a seed, a history and the seed's neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackspark.operators.skew import HOT_ROWS, hot_join
from trackspark.schema import QUEUE_REQUEST, QUEUE_SIZE


def neighbour_lists(neighbours: DataFrame, seed: str = "query_id") -> DataFrame:
    """One row per seed: its ranked neighbours as an array of ``(id, score)``.

    The array is as short as the neighbour request, a constant.
    """
    entry = F.struct("rank", "id", "score")
    return neighbours.groupBy(F.col(seed).alias("seed")).agg(
        F.transform(
            F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["id"].alias("id"), e["score"].alias("score"))
        ).alias("_near")
    )


def pick_queue(
    near: Column,
    history: Column,
    seed: Column,
    request: int = QUEUE_REQUEST,
    size: int = QUEUE_SIZE,
) -> Column:
    """Drop recently played songs, keep ``request``, drop the seed, keep ``size``."""
    fresh = F.filter(near, lambda e: ~F.coalesce(F.array_contains(history, e["id"]), F.lit(False)))
    asked = F.slice(fresh, 1, request)
    return F.slice(F.filter(asked, lambda e: e["id"] != seed), 1, size)


def queues(
    seeds: DataFrame,
    neighbours: DataFrame,
    request: int = QUEUE_REQUEST,
    size: int = QUEUE_SIZE,
    spread_by: str = "user_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``seeds`` (``seed, history`` and any keys) with ``queue``, an array of ``(id, score)``.

    Neighbours are found once per distinct seed, and a seed shared by very many users
    is spread over salts when joined back. Everything after that join is row-local.
    """
    joined = hot_join(seeds, neighbour_lists(neighbours), "seed", F.col(spread_by), "left", hot_rows)
    return joined.withColumn(
        "queue", pick_queue(F.col("_near"), F.col("history"), F.col("seed"), request, size)
    ).drop("_near")


def queue_rows(queued: DataFrame, *keys: str) -> DataFrame:
    """Queue arrays as rows ``(*keys, pos, id, score)``; ``pos`` starts at 0."""
    return queued.select(*keys, F.posexplode("queue").alias("pos", "_e")).select(
        *keys, "pos", F.col("_e.id").alias("id"), F.col("_e.score").alias("score")
    )


def next_from_queue(advances: DataFrame, queue: str = "queue", slot: str = "slot") -> DataFrame:
    """Add ``next_id``: the entry an advance plays, wrapping around at the queue's end.

    Null where the queue is empty or absent.
    """
    n = F.size(queue)
    at = F.pmod(F.col(slot), n) + 1
    return advances.withColumn(
        "next_id", F.when(n > 0, F.try_element_at(F.col(queue), F.when(n > 0, at).cast("int"))["id"])
    )
