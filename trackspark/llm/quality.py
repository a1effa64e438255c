"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel. Every partition sums its part of the normal equations, one
system per fold; the sums are small and are added up in Spark. Out-of-fold scores of the
training rows give the isotonic calibration.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackspark.llm.shared import write_table

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "space": b" \t\n\x0b\f\r",
    "end": b".!?",
    "comma": b",;:",
    "pipe": b"|",
    "bang": b"!",
    "markup": b"#$%&*@=<>{}[]\\^_~/+",
    "quote": b"\"'()`-",
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
STATISTICS = (
    "log_words", "word_length", "word_length_sd", "long_words", "distinct", "distinct_bigrams", "repeats", "top_word",
    "lines", "line_words", "same_lines", "alpha", *_CLASSES, "capital_words", "shouted", "plain_words",
)


def statistics(text: str | None) -> list[float]:
    """Shares and means of one whole text, all about 0 to 1; null counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = len(data)
    lengths = np.fromiter(map(len, words), dtype=float, count=n)
    lower = data.lower().split()
    seen = Counter(lower)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(lower, lower[1:]))) if n > 1 else 1
    return [
        np.log1p(n) / 10, min(lengths.mean() / 10, 3.0), min(lengths.std() / 10, 3.0), float((lengths > 20).mean()),
        len(seen) / n, pairs / max(1, n - 1), sum(a == b for a, b in zip(lower, lower[1:])) / n, max(seen.values()) / n,
        min(len(lines) / n, 1.0), min(n / len(lines) / 100, 3.0), 1 - len(set(lines)) / len(lines),
        counts[_ALPHA].sum() / size, *[counts[t].sum() / size for t in _TABLES.values()],
        sum(w[:1].isupper() for w in words) / n, sum(len(w) > 1 and w.isupper() for w in words) / n, sum(w.isalpha() for w in words) / n,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [list(map(float, statistics(t))) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, x`` of every row, as a table: the texts are read once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return write_table(rows.mapInArrow(_statistics, f"id {kind}, x array<double>"), "statistics")


@dataclass
class Model:
    """Scaling, random features, ridge weights and calibration."""

    mean: np.ndarray
    sd: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        rff = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(z), 1)), rff])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), float(self.levels[0]))
        return np.interp(self.features(x) @ self.weights, self.knots, self.levels)


def isotonic(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators over rows sorted by score: centres and levels of the blocks."""
    blocks: list[list[float]] = []
    for s, m, w in zip(score, mean, weight, strict=True):
        blocks.append([s * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(
    stats: DataFrame,
    labelled: DataFrame,
    n_features: int = 256,
    ridge: float = 1e-3,
    width: float = 1.0,
    folds: int = 5,
    bins: int = 2000,
    rows_per_sum: int = 50_000,
    seed: int = 7,
) -> Model:
    """Fit on all rows of ``labelled`` (``id, label`` with label 0 or 1; other labels and null ids are left out).

    What reaches the driver is of fixed size: means, one system of ``n_features + 1`` equations per
    fold, and ``bins`` sums of out-of-fold scores. With no label, or labels of one kind, every score
    is the training share of label 1 (0.5 for none).
    """
    labelled = labelled.where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").cast("double").alias("y"))
    rows = write_table(stats.join(labelled, "id").select("id", "x", "y", (F.xxhash64("id") % 1000003).alias("h")), "labelled")
    d = len(STATISTICS)
    parts = [f(F.col("x")[i]) for i in range(d) for f in (F.mean, F.stddev_pop)]
    got = rows.agg(F.count("*"), F.sum("y"), *parts).first()
    n, positive = got[0], got[1] or 0.0
    none = np.empty(0)
    if not n or not 0 < positive < n:
        return Model(none, none, none, none, none, none, np.array([positive / n if n else 0.5]))
    mean, sd = np.array(got[2::2], dtype=float), np.array(got[3::2], dtype=float)
    sd[sd < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    waves = rng.normal(0, width / np.sqrt(d), (d, n_features))
    model = Model(mean, sd, waves, rng.uniform(0, 2 * np.pi, n_features), none, none, none)
    size = n_features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size + 1))
        for b in batches:
            x = np.array(b["x"].to_pylist(), dtype=float).reshape(-1, d)
            y, fold = b["y"].to_numpy(), np.abs(b["h"].to_numpy()) % folds
            z = np.hstack([model.features(x), y[:, None]])
            for k in range(folds):
                own = z[fold == k]
                total[k] += own[:, :-1].T @ own
        yield pa.RecordBatch.from_pydict(
            {"fold": np.repeat(np.arange(folds), size), "row": np.tile(np.arange(size), folds), "v": pa.array(list(total.reshape(-1, size + 1)), pa.list_(pa.float64()))}
        )

    def add(keys, table):
        v = np.array(table["v"].to_pylist()).sum(axis=0)
        return pa.table({"fold": [keys[0].as_py()], "row": [keys[1].as_py()], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    schema = "fold long, row long, v array<double>"
    spread = rows.select("x", "y", "h").coalesce(max(1, n // rows_per_sum))
    system = np.zeros((folds, size, size + 1))
    for r in spread.mapInArrow(sums, schema).groupBy("fold", "row").applyInArrow(add, schema).toLocalIterator():
        system[r.fold, r.row] = r.v
    whole = system.sum(axis=0)

    def solve(a: np.ndarray) -> np.ndarray:
        penalty = ridge * max(a[0, 0], 1.0) * np.eye(size) / n_features
        penalty[0, 0] = 1e-9
        return np.linalg.solve(a[:, :-1] + penalty, a[:, -1])

    model.weights = solve(whole)
    held = np.array([solve(whole - system[k]) for k in range(folds)])
    low, high = -0.5, 1.5

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b["x"].to_pylist(), dtype=float).reshape(-1, d)
            fold = np.abs(b["h"].to_numpy()) % folds
            s = np.clip((model.features(x) * held[fold]).sum(axis=1), low, high)
            at = np.minimum(((s - low) / (high - low) * bins).astype(np.int64), bins - 1)
            yield pa.RecordBatch.from_pydict({"bin": at, "s": s, "y": b["y"].to_numpy()})

    table = spread.mapInArrow(binned, "bin long, s double, y double").groupBy("bin")
    found = table.agg(F.mean("s").alias("s"), F.mean("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(*np.array([(r.s, r.y, r.n) for r in found], dtype=float).T)
    return model


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col, score`` of every row of :func:`with_statistics`; empty and null texts have all statistics 0."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b["x"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(shared.value.score(x))], names=[id_col, "score"])

    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(run, f"`{id_col}` {kind}, score double")


def quality(docs: DataFrame, labelled: DataFrame, training: Column, id_col="doc_id", text_col="text", threshold: float = 0.7, **settings) -> DataFrame:
    """Scores of all rows of ``docs`` (``id_col, score, predicted``), learnt from the rows of
    ``labelled`` (``id_col, label``) for which ``training`` holds.

    Repeated rows keep their number and a repeated label counts once, as the larger one. Null ids are scored but never learnt from.
    Columns other than id and text are never read. An empty table gives no rows.
    """
    stats = with_statistics(docs, id_col, text_col)
    train = labelled.where(training).select(F.col(id_col).alias("id"), "label")
    scored = score(stats, fit(stats, train, **settings), id_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
