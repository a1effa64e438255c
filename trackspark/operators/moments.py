"""Counts, means and squared deviations that can be merged, so that only a few numbers leave a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: A set of moments is three columns: ``<name>_n`` and, as packed doubles, ``<name>_mean`` and ``<name>_m2``.
Moments = tuple[int, np.ndarray, np.ndarray]


def of(values: np.ndarray) -> Moments:
    """Moments of the rows of a matrix."""
    n = len(values)
    mean = values.mean(axis=0) if n else np.zeros(values.shape[1])
    return n, mean, ((values - mean) ** 2).sum(axis=0)


def merged(parts: Sequence[Moments]) -> Moments:
    """Moments of all rows that ``parts`` were made of."""
    n = np.array([p[0] for p in parts], dtype=np.float64)
    total = n.sum()
    if total == 0:
        return 0, np.zeros_like(parts[0][1]), np.zeros_like(parts[0][2])
    means, m2 = np.stack([p[1] for p in parts]), np.stack([p[2] for p in parts])
    mean = n @ means / total
    return int(total), mean, m2.sum(axis=0) + n @ (means - mean) ** 2


def deviations(m: Moments) -> np.ndarray:
    """Population standard deviations."""
    return np.sqrt(m[2] / m[0]) if m[0] else np.full_like(m[2], np.nan)


def fields(names: Sequence[str]) -> list[T.StructField]:
    out = []
    for n in names:
        out += [T.StructField(f"{n}_n", T.LongType()), T.StructField(f"{n}_mean", T.BinaryType()), T.StructField(f"{n}_m2", T.BinaryType())]
    return out


def packed(m: Moments) -> tuple[int, bytes, bytes]:
    return m[0], np.asarray(m[1], "<f8").tobytes(), np.asarray(m[2], "<f8").tobytes()


def unpacked(n: int, mean: bytes, m2: bytes) -> Moments:
    return n, np.frombuffer(mean, "<f8"), np.frombuffer(m2, "<f8")


def merge_by(partials: DataFrame, key: str, widths: dict[str, int], names: dict[str, Sequence[str]]) -> DataFrame:
    """One row per key: ``<column>_mean`` and ``<column>_std`` for the columns ``names[set]`` of each set of moments.

    Rows of a key meet by shuffle and sort, and a task folds them as they stream by: memory doesn't grow with a key's rows.
    Sums run in the order of ``start`` within a key, so the result is the same every time. A key without frames has null values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, None

        def out(keys: list, sets: dict[str, tuple]) -> pa.RecordBatch:
            cols, labels = [pa.array(keys, kind)], [key]
            for s, columns in names.items():
                n, mean, m2 = sets[s]
                empty = n == 0
                std = np.sqrt(m2 / np.where(empty, 1, n)[:, None])
                for i, c in enumerate(columns):
                    cols += [pa.array(mean[:, i], mask=empty), pa.array(std[:, i], mask=empty)]
                    labels += [f"{c}_mean", f"{c}_std"]
            return pa.RecordBatch.from_arrays(cols, names=labels)

        for b in batches:
            if b.num_rows == 0:
                continue
            kind, keys = b.schema.field(key).type, b[key].to_pylist()
            sets = {}
            for s, w in widths.items():
                mean, m2 = (np.frombuffer(b"".join(b[f"{s}_{c}"].to_pylist()), "<f8").reshape(-1, w) for c in ("mean", "m2"))
                sets[s] = (b[f"{s}_n"].to_numpy(zero_copy_only=False).astype(np.float64), mean, m2)
            if held is not None:
                keys = [held_key, *keys]
                sets = {s: tuple(np.concatenate([h, v]) for h, v in zip(held[s], sets[s])) for s in sets}
            starts = np.array([i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            folded = {}
            for s, (n, mean, m2) in sets.items():
                total = np.add.reduceat(n, starts)
                centre = np.add.reduceat(n[:, None] * mean, starts) / np.where(total == 0, 1, total)[:, None]
                folded[s] = (total, centre, np.add.reduceat(m2 + n[:, None] * (mean - centre[group]) ** 2, starts))
            done = len(starts) - 1
            if done:
                yield out([keys[i] for i in starts[:-1]], {s: tuple(v[:done] for v in f) for s, f in folded.items()})
            held_key, held = keys[-1], {s: tuple(v[done:] for v in f) for s, f in folded.items()}
        if held is not None:
            yield out([held_key], held)

    columns = [f"{c}_{x}" for s in names.values() for c in s for x in ("mean", "std")]
    schema = T.StructType([partials.schema[key], *[T.StructField(c, T.DoubleType()) for c in columns]])
    wanted = [f"{s}_{x}" for s in widths for x in ("n", "mean", "m2")]
    rows = partials.select(key, "start", *wanted).repartition(key).sortWithinPartitions(key, "start")
    return rows.mapInArrow(run, schema)
