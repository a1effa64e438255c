"""Play history as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackspark.schema import HISTORY_SIZE

OUTPUT = "user_id bigint, history array<string>, seed string, previous string"
_STATE = "ts array<bigint>, event_id array<bigint>, song array<string>"


def _latest(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    return pdf.sort_values(["ts_us", "event_id"], kind="stable").groupby("user_id", sort=False, dropna=False).tail(size)


def stream_history(
    plays: DataFrame, size: int = HISTORY_SIZE, idle_timeout_ms: int | None = None
) -> DataFrame:
    """Per user with new plays, the bounded history after them (update mode).

    Late plays are merged by ``(ts, event_id)`` before the cut, so the result does not
    depend on how the log was split into micro-batches. Each task first keeps only the
    ``size`` latest plays per user of what it read, so a hot user sends little to the
    state. ``idle_timeout_ms`` forgets users without plays for that long.
    """
    rows = plays.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("song").cast("string").alias("song"),
    )

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _latest(pdf, size)

    def update(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = pd.DataFrame({"ts_us": [], "event_id": [], "song": []}).astype(
            {"ts_us": "int64", "event_id": "int64", "song": "object"}
        )
        if state.exists:
            ts, ids, songs = state.get
            kept = pd.DataFrame({"ts_us": list(ts), "event_id": list(ids), "song": list(songs)})
        for pdf in chunks:  # a key may come in several chunks; never hold more than one
            kept = pd.concat([kept, pdf[["ts_us", "event_id", "song"]]]).sort_values(
                ["ts_us", "event_id"], kind="stable"
            )[-size:]
        songs = [None if pd.isna(s) else s for s in kept["song"]]
        state.update((kept["ts_us"].astype(int).tolist(), kept["event_id"].astype(int).tolist(), songs))
        if idle_timeout_ms is not None:
            state.setTimeoutDuration(idle_timeout_ms)
        yield pd.DataFrame(
            {
                "user_id": [key[0]],
                "history": [songs],
                "seed": [songs[-1]],
                "previous": [songs[-2] if len(songs) > 1 else None],
            }
        )

    timeout = (
        GroupStateTimeout.NoTimeout if idle_timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )
    return (
        rows.mapInPandas(combine, rows.schema)
        .groupBy("user_id")
        .applyInPandasWithState(update, OUTPUT, _STATE, "update", timeout)
    )
