"""Song-end detection as keyed streaming state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trackspark.streaming.in_order import in_order

LATENESS = "1 minute"
FORGET_AFTER_MS = 24 * 3600 * 1000

_CARRY = "armed boolean, last_song string"


def _ends(carry: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """The samples at which songs ended; the carry says whether a busy sample still waits to be settled, and its song."""
    armed, last = carry or (False, None)
    numbers: dict = {}
    songs = np.array([numbers.setdefault(s, len(numbers)) for s in [last, *rows["song"]]])
    busy = np.concatenate([[armed], rows["is_busy"].to_numpy(dtype=bool)])
    playing = np.concatenate([[False], rows["is_playing"].to_numpy(dtype=bool)])
    at = np.maximum.accumulate(np.where(busy, np.arange(len(busy)), -1))  # the busy sample before each one
    settles = np.flatnonzero(~busy & (at >= 0) & (songs == songs[at]))
    _, first = np.unique(at[settles], return_index=True)
    first = settles[first]  # the first sample that settles each run
    ended = first[playing[first]] - 1
    open_run = at[-1] >= 0 and not (len(first) and at[first[-1]] == at[-1])
    names = [last, *rows["song"]]
    out = pd.DataFrame({"ts_us": rows["ts_us"].to_numpy()[ended], "event_id": rows["event_id"].to_numpy()[ended], "song": [names[i + 1] for i in ended]})
    return (bool(open_run), names[at[-1]] if open_run else None), out


def stream_song_ends(status: DataFrame, lateness: str = LATENESS, forget_after_ms: int = FORGET_AFTER_MS) -> DataFrame:
    """Ended songs per device (append mode), equal to :func:`~trackspark.operators.playback.song_ends` of the whole log.

    Samples may arrive late and in any order: each is judged when the watermark, ``lateness`` behind the newest sample, has
    passed it. Devices that send nothing for ``forget_after_ms`` are forgotten.
    """
    rows = status.select(
        F.col("device_id").cast("bigint").alias("device_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.coalesce("is_busy", F.lit(False)).alias("is_busy"),
        F.coalesce("is_playing", F.lit(False)).alias("is_playing"),
        "song",
    )
    payload = {"is_busy": "boolean", "is_playing": "boolean", "song": "string"}
    ended = in_order(rows, "device_id", payload, _ends, _CARRY, "device_id bigint, ts_us bigint, event_id bigint, song string", lateness, forget_after_ms)
    return ended.select("device_id", F.timestamp_micros("ts_us").alias("ts"), "event_id", "song")
