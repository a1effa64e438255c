"""Stretches of a text that repeat with a fixed period, found by block convolution.

A run of period ``q`` and at least four periods holds, for the power of two ``B`` with ``B <= q < 2B``, two neighbouring blocks of
the grid of ``B`` words that both occur again ``q`` words further on. At each such scale every block meets the ``2B`` words that
follow it: the sum of squared differences at each distance comes from one exact convolution (:mod:`~trackspark.llm.ntt`), and is
zero where the block occurs. Distances that two neighbouring blocks share are seeds; a chain of them is extended word by word
to the maximal run. Work is in proportion to ``n * log(n)^2``, also for texts of one repeated word: seeds inside a run of a smaller
period are multiples of that period (Fine and Wilf) and are dropped, the others are repetitions of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackspark.llm.ntt import PRIME, double_correlation, lessen, redc

#: Words that are worked on together, and words whose transforms are in memory together. A longer text is alone.
BATCH_WORDS = 1 << 19
SLAB_WORDS = 1 << 17
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class _Numbers(dict):
    """Numbers of words in order of appearance, from 1."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def occurrences(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``(distance, block)`` where a block of ``scale`` numbers occurs again ``scale <= distance < 2 * scale`` further on.

    ``x`` holds whole blocks, the last two of which only follow others. Sums are compared modulo a prime: a sum that
    isn't zero but a multiple of it gives a pair too many, never one too few.
    """
    count = len(x) // scale - 2
    slab = max(1, SLAB_WORDS // scale)
    found = []
    for a in range(0, count, slab):
        b = min(a + slab, count)
        part = x[a * scale : (b + 2) * scale]
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(redc(part * part))])
        squares = redc(total[scale:] - total[:-scale])  # of the stretch that starts at each place
        own = squares[: (b - a) * scale : scale]
        later = squares[scale : (b - a + 1) * scale].reshape(b - a, scale).T
        products = double_correlation(np.ascontiguousarray(part.reshape(-1, scale).T))
        rest = products + np.uint64(4 * PRIME)
        rest -= later
        rest -= own
        lessen(rest.reshape(-1))
        d, j = np.nonzero((rest == 0) | (rest == PRIME) | (rest == 2 * PRIME))
        found.append((d + scale, j + a))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _chains(distance: np.ndarray, block: np.ndarray, scale: int, reach: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(distance, first block, last block)`` of neighbouring blocks with one distance, outside runs of smaller periods."""
    order = np.lexsort((block, distance))
    d, j = distance[order], block[order]
    pair = (d[1:] == d[:-1]) & (j[1:] == j[:-1] + 1)
    d, j = d[:-1][pair], j[:-1][pair]
    new = reach[j * scale] < (j + 1) * scale + d
    d, j = d[new], j[new]
    if len(d) == 0:
        return
    starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (j[1:] != j[:-1] + 1)]))
    ends = np.concatenate([starts[1:], [len(d)]]) - 1
    yield from zip(d[starts].tolist(), j[starts].tolist(), (j[ends] + 1).tolist())


def find_runs(x: np.ndarray, lengths: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` in ``x``, the numbers (from 1) of texts one after another, longest text first."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    runs: list[tuple[int, int, int]] = []
    scale = 1
    while True:
        n = int(lengths[lengths >= max(least, times * scale)].sum())
        if n == 0:
            return runs
        if 2 * scale > 1 << 26:
            raise ValueError("a text of more than 2^27 words")
        whole = np.zeros((-(-n // scale) + 2) * scale, dtype=np.uint64)
        whole[:n] = x[:n]
        reach = np.zeros(len(whole), dtype=np.int64)
        if runs:
            known = np.array(runs)
            known = known[known[:, 0] < n]
            np.maximum.at(reach, known[:, 0], known[:, 0] + known[:, 1])
        reach = np.maximum.accumulate(reach)
        made = []
        for q, first, last in _chains(*occurrences(whole, scale), scale, reach):
            low, high = max(0, (first - 1) * scale), min((last + 2) * scale, n - q)
            if high - low < (times - 1) * q:
                continue
            same = (x[low:high] == x[low + q : high + q]) & (text[low:high] == text[low + q : high + q])
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
            for s, t in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if t - s >= (times - 1) * q and t - s + q >= least:
                    made.append((low + s, t - s + q, q))
        runs += made
        scale *= 2


def _answers(rows: list[tuple[object, list[bytes], np.ndarray]], least: int, times: int):
    """``(id, words, starts, lengths, periods, kept words)`` of texts, whose words come with their numbers."""
    rows.sort(key=lambda r: -len(r[2]))
    lengths = np.array([len(r[2]) for r in rows], dtype=np.int64)
    x = np.concatenate([r[2] for r in rows])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    runs = np.array(find_runs(x, lengths, least, times), dtype=np.int64).reshape(-1, 3)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    of = np.searchsorted(begins, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(rows) + 1))
    for k, (doc_id, words, _) in enumerate(rows):
        mine = runs[cuts[k] : cuts[k + 1]]
        starts = mine[:, 0] - begins[k]
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(gone, starts + mine[:, 2], 1)
        np.add.at(gone, starts + mine[:, 1], -1)
        if len(mine):
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
        yield doc_id, int(lengths[k]), starts, mine[:, 1], mine[:, 2], words


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 6,
    times: int = 4,
    rewrite: Callable[[object, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """``doc_id, n_words, runs, kept_text`` of each row.

    A run is a maximal stretch of words whose smallest period ``q`` it holds at least ``times`` times (three or more), of ``least``
    words or more. ``runs`` are ``start, length, period`` by start, then period; ``kept_text`` is the text, joined by single spaces,
    without the words that any run contains after its first period. ``rewrite(id, n)`` may give the positions of the original words that
    make up the text to look at.

    Every row is judged alone: repeated rows and ids each get their row, a null id stays null. A null, empty or blank text has no
    words, no run and an empty kept text. All runs are returned, so there are no ties. A very long text is one
    task's work, in memory of some 40 bytes a word besides the text; texts of more than 2^27 words are refused. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, size = [], _Numbers(), 0

        def out() -> pa.RecordBatch:
            found = list(_answers(held, least, times))
            offsets = np.concatenate([[0], np.cumsum([len(f[2]) for f in found])]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in (2, 3, 4)], fields=list(kind.value_type))
            texts = pa.array([b" ".join(f[5]) for f in found], pa.binary()).cast(pa.string())
            cols = [pa.array([f[0] for f in found], id_type), pa.array([f[1] for f in found], pa.int64()), pa.ListArray.from_arrays(offsets, flat, type=kind), texts]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "kept_text"])

        for b in batches:
            id_type = b.schema.field("doc_id").type
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.large_binary())):
                words = (t.as_py() or b"").split()
                at = rewrite(i, len(words)) if rewrite is not None else None
                if at is not None:
                    words = [words[k] for k in at.tolist()]
                held.append((i, words, np.fromiter(map(numbers.__getitem__, words), dtype=np.uint64, count=len(words))))
                size += len(words) + 1
                if size >= BATCH_WORDS:
                    yield out()
                    held, numbers, size = [], _Numbers(), 0
        if held:
            yield out()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, kept_text string")


def strongest(runs) -> F.Column:
    """Of an array of runs, the one with the greatest exact length / period; ties: smallest start, then period. Null without runs."""
    first = F.get(runs, F.lit(0))

    def better(best, r):
        gain = r["length"] * best["period"] - best["length"] * r["period"]
        return F.when(gain > 0, r).otherwise(best)  # runs come by start, then period

    return F.aggregate(runs, first, better)
