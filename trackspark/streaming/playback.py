"""Auto-advances and playback modes as keyed streaming state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trackspark.schema import REFRESH_EVERY
from trackspark.streaming.in_order import in_order
from trackspark.streaming.song_end import FORGET_AFTER_MS, LATENESS


def _advances(carry: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Numbers auto-advances since the last manual start; the carry is the last number."""
    auto = rows["is_auto"].to_numpy(dtype=bool)
    total = np.cumsum(auto) + (carry[0] if carry else 0)
    advance = total - np.maximum.accumulate(np.where(auto, 0, total))
    return (int(advance[-1]),), pd.DataFrame({"ts_us": rows["ts_us"], "event_id": rows["event_id"], "song": rows["song"], "is_auto": auto, "advance": advance})


def stream_auto_advances(plays: DataFrame, refresh_every: int = REFRESH_EVERY, lateness: str = LATENESS, forget_after_ms: int = FORGET_AFTER_MS) -> DataFrame:
    """Every play with ``advance, epoch, slot, refresh``, equal to :func:`~trackspark.operators.playback.auto_advances` of the whole log.

    A listener who is forgotten after ``forget_after_ms`` of silence starts anew.
    """
    rows = plays.select(
        F.col("user_id").cast("bigint").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.coalesce("is_auto", F.lit(False)).alias("is_auto"), "song"
    )
    out = "user_id bigint, ts_us bigint, event_id bigint, song string, is_auto boolean, advance bigint"
    numbered = in_order(rows, "user_id", {"is_auto": "boolean", "song": "string"}, _advances, "advance bigint", out, lateness, forget_after_ms)
    a = F.col("advance")
    return numbered.select(
        "user_id", F.timestamp_micros("ts_us").alias("ts"), "event_id", "song", "is_auto", "advance",
        F.floor(a / refresh_every).alias("epoch"), (a % refresh_every).alias("slot"), ((a > 0) & (a % refresh_every == 0)).alias("refresh"),
    )


def _modes(carry: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """The mode at every song end (``kind`` null). The carry is the last toggle's kind and whether it is on."""
    last, on = carry or (None, False)
    kinds = [last, *rows["kind"]]
    code = np.array([{"auto": 1, "loop": 2}.get(k, 0) for k in kinds])
    toggle = code > 0
    seen = np.flatnonzero(toggle)
    state = np.zeros(len(kinds), dtype=bool)
    if len(seen):
        own = code[seen]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        nth = np.arange(len(seen)) - np.repeat(begins, np.diff(np.append(begins, len(seen))))  # within a stretch of one kind
        if toggle[0] and not on:  # the carried toggle left its kind off
            nth[: begins[1] if len(begins) > 1 else len(nth)] += 1
        state[seen] = nth % 2 == 0
    at = np.maximum.accumulate(np.where(toggle, np.arange(len(kinds)), -1))
    active = np.array([kinds[i] if i >= 0 and state[i] else "none" for i in at], dtype=object)
    ends = ~toggle[1:]
    out = pd.DataFrame({"ts_us": rows["ts_us"][ends], "event_id": rows["event_id"][ends], "mode": active[1:][ends]})
    return (kinds[at[-1]] if at[-1] >= 0 else None, bool(at[-1] >= 0 and state[at[-1]])), out


def stream_modes_at_ends(ends: DataFrame, toggles: DataFrame, lateness: str = LATENESS, forget_after_ms: int = FORGET_AFTER_MS) -> DataFrame:
    """Every song end with ``mode`` and ``action``, equal to :func:`~trackspark.operators.playback.mode_at` of the whole log.

    ``ends`` and ``toggles`` (with ``kind``: ``auto`` or ``loop``) are streams of ``user_id, ts, event_id``.
    """
    names = [F.col("user_id").cast("bigint").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id")]
    both = ends.select(*names, F.lit(None).cast("string").alias("kind")).unionByName(toggles.where(F.col("kind").isin("auto", "loop")).select(*names, "kind"))
    out = "user_id bigint, ts_us bigint, event_id bigint, mode string"
    found = in_order(both, "user_id", {"kind": "string"}, _modes, "kind string, is_on boolean", out, lateness, forget_after_ms)
    action = F.when(F.col("mode") == "loop", "replay").when(F.col("mode") == "auto", "next_in_queue").otherwise("stop")
    return found.select("user_id", F.timestamp_micros("ts_us").alias("ts"), "event_id", "mode", action.alias("action"))
