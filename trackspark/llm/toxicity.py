"""Toxicity: non-negative positive-unlabelled learning over hashed words.

A linear classifier is trained in numpy from confirmed toxic texts and texts taken as
unlabelled, by stochastic gradients of the class-prior-corrected risk
``prior * R+(1) + max(0, Ru(0) - prior * R+(0))``. Batches are large, since in small ones
chance takes the corrected part below zero; where it falls there, its gradient is turned
round, as in the non-negative estimator. A logistic curve fitted to the training labels calibrates the outputs. Several shards of the training rows are fitted in
parallel and their weights averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

BITS = 18
EDGES = ".,;:!?\"'()[]{}|#$%&*-_=+<>/\\~`"
STARTS = (3, 4, 5, 6)
CACHED_WORDS = 200_000


def _bucket(feature: str) -> int:
    return xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) >> (64 - BITS)


class _Buckets(dict):
    """Hash buckets of a word without punctuation at its ends, and of its first letters, so that inflected forms
    share features."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHED_WORDS:
            self.clear()
        core = word.strip(EDGES)
        v = (_bucket(core), *[_bucket(f"{core[:n]}-") for n in STARTS if len(core) > n]) if core else ()
        self[word] = v
        return v


_buckets = _Buckets()


def word_buckets(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a whole text's lower-cased words."""
    found: set[int] = set()
    for word in set((text or "").lower().split()):
        found.update(_buckets[word])
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [word_buckets(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["shard"], pa.array(rows, pa.list_(pa.int32()))], names=["id", "label", "shard", "x"])


def telling_buckets(flat_p: np.ndarray, n_p: int, flat_u: np.ndarray, n_u: int, prior: float, least: float, sure: float) -> np.ndarray:
    """Which buckets are more frequent in positive texts by ``least`` standard errors, and make a text toxic with
    an estimated probability, ``prior * P(bucket | positive) / P(bucket | unlabelled)``, of at least ``sure``."""
    in_p, in_u = np.bincount(flat_p, minlength=1 << BITS), np.bincount(flat_u, minlength=1 << BITS)
    share = in_u / n_u
    far = in_p - n_p * share >= least * np.sqrt(n_p * share * (1 - share) + 0.5)
    return far & (prior * in_p / n_p >= sure * in_u / n_u)


def train_nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, least: float, sure: float, epochs: int, batch: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights by bucket, and the bias, of one shard; only :func:`telling_buckets` get a weight."""
    weights = np.zeros(1 << BITS)
    p, u = np.flatnonzero(positive), np.arange(len(rows))  # all texts stand for the mixture, so that the prior holds in it
    flat = lambda ids: np.concatenate([np.empty(0, np.int64), *[rows[i] for i in ids]]).astype(np.int64)
    used = telling_buckets(flat(p), max(1, len(p)), flat(u), max(1, len(u)), prior, least, sure)
    where = np.cumsum(used) - 1
    kept = [where[r[used[r]]] for r in rows]
    size = int(used.sum())
    bias0 = float(np.log(prior / (1 - prior)))
    if not len(p) or not len(u) or not size:
        return weights, bias0
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(size + 1), bias0
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    def outputs(ids):
        own = [kept[i] for i in ids]
        lengths = np.array([len(x) for x in own])
        cols = np.concatenate(own)
        doc = np.repeat(np.arange(len(ids)), lengths)
        return cols, doc, np.bincount(doc, w[:-1][cols], len(ids)) + w[-1] + bias

    batches = max(1, (len(p) + len(u)) // batch)
    for _ in range(epochs):
        for bp, bu in zip(np.array_split(rng.permutation(p), batches), np.array_split(rng.permutation(u), batches), strict=True):
            cp, dp, gp = outputs(bp)
            cu, du, gu = outputs(bu)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            # Derivatives of the logistic loss by the outputs, for either part of the risk.
            first = -prior * sigmoid(-gp) / len(bp)
            second_p, second_u = -prior * sigmoid(gp) / len(bp), sigmoid(gu) / len(bu)
            if negative >= 0:
                on_p, on_u = first + second_p, second_u
            else:
                on_p, on_u = -second_p, -second_u
            grad = np.bincount(cp, on_p[dp], size + 1) + np.bincount(cu, on_u[du], size + 1)
            grad[-1] = on_p.sum() + on_u.sum()
            grad[:-1] += decay * w[:-1]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    weights[used] = w[:-1]
    return weights, float(w[-1] + bias)


def train_shard(rows: list[np.ndarray], labels: np.ndarray, *settings) -> tuple[np.ndarray, float]:
    """:func:`train_nnpu`, with outputs calibrated on the labelled rows (label -1: none)."""
    w, bias = train_nnpu(rows, labels == 1, *settings)
    known = np.flatnonzero(labels >= 0)
    a, b = calibration(np.array([w[rows[i]].sum() + bias for i in known]), labels[known].astype(float))
    return a * w, a * bias + b


def calibration(g: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset of the logistic curve from outputs to labels, by Newton steps with a slight pull to (1, 0)."""
    t = np.array([1.0, 0.0])
    x = np.column_stack([g, np.ones(len(g))])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (q - y) + 0.5 * (t - [1.0, 0.0])
        t = t - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2), grad)
    return (float(t[0]), float(t[1])) if np.isfinite(t).all() and t[0] > 0 else (1.0, 0.0)


def fit(
    docs: DataFrame,
    labelled: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 48_000,
    shard_rows: int = 12_000,
    least: float = 4.0,
    sure: float = 0.7,
    epochs: int = 100,
    batch: int = 6_000,
    rate: float = 0.1,
    decay: float = 1e-4,
    seed: int = 3,
) -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from at most about ``max_rows`` training rows.

    The class prior is the share of label 1 among all training labels. Rows for fitting are the training rows, by hash
    of the id where there are more than ``max_rows``; a row is positive if its label is 1, and all rows, their labels ignored, are the unlabelled mixture. Without
    labels, or with one kind only, the weights are zero and every score is the prior (0.5 for none).
    """
    labels = labelled.where(training).select(F.col(id_col).alias("id"), "label").where(F.col("label").isin(0, 1))
    labels = labels.where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    n, share_of_ones = labels.agg(F.count("*"), F.mean(F.col("label").cast("double"))).first()
    zero = np.zeros(1 << BITS)
    if not n:
        return zero, 0.0
    prior = float(np.clip(share_of_ones, 1e-4, 1 - 1e-4))
    if not 0 < share_of_ones < 1:
        return zero, float(np.log(prior / (1 - prior)))
    rows = docs.where(training).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    n_rows = rows.select("id").count()
    if n_rows > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_rows / n_rows * (1 << 30)))
    shards = max(1, round(min(n_rows, max_rows) / shard_rows))
    picked = rows.join(labels, "id", "left").select(
        "id", "text", F.coalesce("label", F.lit(-1)).cast("int").alias("label"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).alias("shard")
    )
    hashed = picked.mapInArrow(_hashed, "id long, label int, shard long, x array<int>")

    def train(keys, table):
        table = table.sort_by("id")
        lists = table["x"].combine_chunks()
        x = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        w, bias = train_shard(x, table["label"].to_numpy(), prior, least, sure, epochs, batch, rate, decay, seed + keys[0].as_py())
        return pa.table({"n": [len(x)], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": [bias]})

    models = hashed.groupBy("shard").applyInArrow(train, "n long, w binary, bias double").collect()
    n = float(sum(r.n for r in models)) or 1.0
    weights = sum((np.frombuffer(r.w, dtype=np.float32).astype(float) * (r.n / n) for r in models), zero)
    return weights, sum(r.bias * r.n for r in models) / n


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col, score`` of every row: the probability of label 1, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = [shared.value[word_buckets(t)].sum(dtype=float) + bias for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(1 / (1 + np.exp(-np.clip(g, -60, 60))), pa.float64())], names=[id_col, "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labelled: DataFrame, training: Column, id_col="doc_id", text_col="text", threshold: float = 0.7, **settings) -> DataFrame:
    """``id_col, score, predicted`` of every row of ``docs``, learnt from rows for which ``training``, a condition on the id, holds.

    ``labelled`` has ``id_col, label``. Null and empty texts get the bias' score. Repeated rows keep their number; a repeated label counts
    once, as the larger one; null ids are scored but never learnt from. Columns other than id and text
    are never read. An empty table gives no rows.
    """
    weights, bias = fit(docs, labelled, training, id_col, text_col, **settings)
    scored = score(docs, weights, bias, id_col, text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
