"""Queues kept up to date from a stream of plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trackspark.operators import knn, queue
from trackspark.plans.listening import neighbours_of_seeds
from trackspark.schema import OVERFETCH, QUEUE_REQUEST, QUEUE_SIZE
from trackspark.session import materialise, releasing
from trackspark.streaming.history import stream_history


def start_queues(
    plays: DataFrame,
    library: DataFrame,
    output: str,
    checkpoint: str,
    request: int = QUEUE_REQUEST,
    size: int = QUEUE_SIZE,
    overfetch: int = OVERFETCH,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Rebuild the queue of every user with new plays, once per micro-batch.

    ``library``: ``id string, vector``; it is indexed once, before the stream starts.
    A batch overwrites its own folder, so a repeated batch leaves no duplicates.
    """
    k = request * overfetch
    index = knn.build_index(library, k)

    def save(batch: DataFrame, batch_id: int) -> None:
        with releasing():
            listeners = materialise(batch.select("user_id", "seed", "history"))
            near = neighbours_of_seeds(listeners, library, index, k)
            queue.queues(listeners, near, request, size).select("user_id", "seed", "queue").write.mode(
                "overwrite"
            ).parquet(f"{output}/batch_id={batch_id}")

    return (
        stream_history(plays)
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_queues(spark: SparkSession, output: str) -> DataFrame:
    """The newest queue of every user."""
    return (
        spark.read.parquet(output)
        .groupBy("user_id")
        .agg(F.max_by(F.struct("seed", "queue"), "batch_id").alias("_q"))
        .select("user_id", "_q.seed", "_q.queue")
    )
