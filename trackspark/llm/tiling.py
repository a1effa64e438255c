"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared runs of ``seed`` words. Each pair that shares
one is tiled: the longest match of words not yet covered on either side is marked, again and again,
down to ``least`` words, where matches are found by running Karp-Rabin digests. A
document is contaminated by an item when tiles cover enough of the item, in
whatever order its passages appear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackspark.llm import blocks as B
from trackspark.llm.shared import giving_back, stretches

EDGES = ".,;:!?\"'()[]{}|#$%&*-_=+<>/\\~`"


class _Normal(dict):
    """Digest of a lower-cased word without punctuation at its ends; 0 where nothing is left."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        core = word.strip(EDGES)
        v = self[word] = B.xxh3_64_intdigest(core.encode("utf-8", "surrogatepass")) | 1 if core else 0
        return v


_normal = _Normal()


def forget_words() -> None:
    _normal.clear()


def tokens(text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    found = np.fromiter(map(_normal.__getitem__, words), dtype=np.uint64, count=len(words))
    return found[found != 0]


def _longest(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All longest common runs of uncovered words, at least ``least`` long: (start in a, start in b, length)."""

    def at(length: int):
        run_a, run_b = B.runs(a, length), B.runs(b, length)
        full = lambda free: np.convolve(free, np.ones(length, dtype=np.int64), "valid") == length
        ia, ib = np.flatnonzero(full(free_a)), np.flatnonzero(full(free_b))
        by = np.argsort(run_b[ib], kind="stable")
        keys = run_b[ib][by]
        lo, hi = np.searchsorted(keys, run_a[ia], "left"), np.searchsorted(keys, run_a[ia], "right")
        return ia[hi > lo], lo[hi > lo], hi[hi > lo], ib[by]

    low, high = least - 1, min(len(a), len(b))
    while low < high:  # a run of some length holds runs of every smaller one
        mid = (low + high + 1) // 2
        if len(at(mid)[0]):
            low = mid
        else:
            high = mid - 1
    if low < least:
        return []
    ia, lo, hi, order = at(low)
    return [(int(i), int(j), low) for i, x, y in zip(ia, lo, hi) for j in order[x:y]]


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: non-overlapping (start in a, start in b, length), longest first."""
    free_a, free_b = np.ones(len(a), dtype=np.int64), np.ones(len(b), dtype=np.int64)
    tiles: list[tuple[int, int, int]] = []
    while matches := _longest(a, b, free_a, free_b, least):
        for i, j, n in matches:
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                if not np.array_equal(a[i : i + n], b[j : j + n]):  # different words with one digest are no match
                    free_a[i] = 0
                    continue
                free_a[i : i + n] = 0
                free_b[j : j + n] = 0
                tiles.append((i, j, n))
    return tiles


def _near(doc: np.ndarray, seeds: np.ndarray, seed: int, reach: int) -> np.ndarray:
    """The document's words within ``reach`` of a shared seed; all else can't be part of a tile that holds a seed.

    Stretches are set apart by a token of their own, so no tile spans a cut.
    """
    found = np.flatnonzero(np.isin(B.runs(doc, seed), seeds))
    if not len(found):
        return doc[:0]
    change = np.bincount(np.maximum(found - reach, 0), minlength=len(doc) + 1) - np.bincount(np.minimum(found + seed + reach, len(doc)), minlength=len(doc) + 1)
    near = np.cumsum(change)[: len(doc)] > 0
    begins = np.flatnonzero(near & ~np.concatenate(([False], near[:-1])))
    out = np.where(near, doc, 0)
    keep = near.copy()
    keep[begins[begins > 0] - 1] = True  # zero: no token has it, and the benchmark's is another
    return out[keep]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, seed: int = 6, least: int = 6, coverage: float = 0.5, min_words: int = 12,
    id_col="doc_id", text_col="text", item_col="item_id", item_text="text", items_at_once: int = 20_000,
) -> DataFrame:
    """``id_col, item_id, item_words, covered_words, coverage, tiles`` of every document and item where tiles cover at least ``coverage``
    of the item's words and at least ``min_words`` of them (or all of a shorter item's).

    Words are compared in lower case and without punctuation at their ends. ``seed`` must not exceed ``least``, so every tile
    holds a seed. Null and empty texts and items, and items shorter than ``least``, match nothing. Repeated rows give repeated
    results; null ids are kept. Other columns are ignored. An empty table gives no rows.

    The benchmark is worked through in slices of ``items_at_once`` items, each small enough to travel to the tasks, against all
    documents: a stated query set, in blocks. A document is read once per slice and never shuffled.
    """
    if seed > least:
        raise ValueError("seed must not exceed least")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    slices = max(1, -(-items.count() // items_at_once))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((rows, "id"), (items, "item")))
    out = None
    for s in range(slices):
        own = [(r.item, tokens(r.text)) for r in items.where(F.pmod(F.xxhash64("text", "item"), F.lit(slices)) == s).toLocalIterator()]
        own = [(i, t) for i, t in own if len(t) >= least]
        runs = [np.unique(B.runs(t, seed)) for _, t in own]
        flat = np.concatenate([np.empty(0, np.uint64), *runs])
        of = np.repeat(np.arange(len(own)), [len(r) for r in runs])
        by = np.argsort(flat, kind="stable")
        shared = spark.sparkContext.broadcast((own, flat[by], of[by]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, keys, of = shared.value
            for b in (some for whole in batches for some in stretches(whole, 1)):
                cols: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    doc = tokens(text)
                    seeds = np.unique(B.runs(doc, seed))
                    lo, hi = np.searchsorted(keys, seeds, "left"), np.searchsorted(keys, seeds, "right")
                    hit = hi > lo
                    met = sorted({int(i) for x, y in zip(lo[hit], hi[hit]) for i in of[x:y]})
                    for i in met:
                        item, words = own[i]
                        tiles = tile(_near(doc, B.runs(words, seed), seed, len(words)), words, least)
                        covered = sum(n for _, _, n in tiles)
                        if covered >= coverage * len(words) and covered >= min(min_words, len(words)):
                            for c, v in zip(cols, (doc_id, item, len(words), covered, covered / len(words), len(tiles)), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (b.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)],
                    names=[id_col, "item_id", "item_words", "covered_words", "coverage", "tiles"],
                )

        found = rows.mapInArrow(giving_back(run, forget_words), f"`{id_col}` {kind}, item_id {item_kind}, item_words long, covered_words long, coverage double, tiles long")
        out = found if out is None else out.unionByName(found)
    return out
