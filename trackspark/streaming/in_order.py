"""Keyed streams worked through in event-time order, whatever order rows arrive in.

Rows wait in their key's state until the watermark has passed them; then they go, sorted by time and tie-break, through a step function with
a small state of its own. A timer wakes a key whose rows have become due without new ones arriving, and another forgets keys that
have been silent for long. The result doesn't depend on how a log was split into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ``step(carry, rows)`` returns the next carry and the output rows; ``carry`` is None for a new key.
Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame | None]]


def in_order(
    rows: DataFrame,
    key: str,
    payload: dict[str, str],
    step: Step,
    carry: str,
    out: str,
    lateness: str,
    forget_after_ms: int,
    ts: str = "ts",
    tie: str = "event_id",
) -> DataFrame:
    """Append-mode stream of what ``step`` returns, with the schema ``out``.

    ``payload`` names the columns that ``step`` sees besides ``ts_us`` and ``tie``, and their types; ``carry`` is the schema of its
    state. Rows later than ``lateness`` behind the newest event of all keys are dropped, as the watermark demands. A key's rows of one
    micro-batch and its waiting rows are sorted together, so bound the batch.
    """
    named = rows.withWatermark(ts, lateness).select(
        key, ts, F.unix_micros(ts).alias("ts_us"), F.col(tie).cast("bigint").alias(tie), *[F.col(c).cast(t).alias(c) for c, t in payload.items()]
    )
    columns = ["ts_us", tie, *payload]
    width = len(T.StructType.fromDDL(carry).fields)
    waiting = ", ".join([f"w_{c} array<{t}>" for c, t in zip(columns, ["bigint", "bigint", *payload.values()])])
    schema = f"{carry}, started boolean, newest bigint, {waiting}"

    def update(group, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held, newest, parts = None, 0, []
        if state.exists:
            values = state.get
            held = tuple(values[:width]) if values[width] else None
            newest = values[width + 1]
            parts.append(pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(columns, values[width + 2 :])}))
        if not state.hasTimedOut:
            for pdf in chunks:
                parts.append(pdf[columns].astype(object).where(pdf[columns].notna(), None))
        pending = pd.concat(parts, ignore_index=True)
        pending["ts_us"] = pending["ts_us"].astype("int64")
        pending[tie] = pending[tie].astype("int64")
        if len(pending):
            newest = max(newest, int(pending["ts_us"].max()))
        due = pending["ts_us"] <= watermark * 1000
        ready, rest = pending[due], pending[~due]
        made = None
        if len(ready):
            held, made = step(held, ready.sort_values(["ts_us", tie], kind="stable").reset_index(drop=True))
        if len(rest) == 0 and watermark >= newest // 1000 + forget_after_ms:
            state.remove()
        else:
            lists = [rest[c].tolist() for c in columns]
            state.update((*(held if held is not None else (None,) * width), held is not None, newest, *lists))
            wake = -(-int(rest["ts_us"].min()) // 1000) if len(rest) else newest // 1000 + forget_after_ms
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        if made is not None and len(made):
            made.insert(0, key, group[0])
            yield made

    return named.groupBy(key).applyInPandasWithState(update, out, schema, "append", GroupStateTimeout.EventTimeTimeout)
