"""Language identification with rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of a language's training texts. A
document's own list, made of its whole text, is compared with every profile by the out-of-place distance:
the sum over the document's n-grams of how far their ranks differ, or the
profile's length where the profile lacks one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackspark.llm.shared import giving_back, stretches, write_table

UNDETERMINED = "und"
MAX_LANGUAGES = 2000


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text: lower-cased letters, every other run one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    c = np.concatenate(([1], np.where(letter, points, 1), [1]))  # 1 stands for a gap
    c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
    two = c[:-1] << 21 | c[1:]
    return np.concatenate((c[c != 1], two, two[:-1] << 21 | c[2:]))


def top_grams(text: str | None, k: int) -> np.ndarray:
    """A text's ``k`` most frequent n-grams, most frequent first, then by code."""
    codes, n = np.unique(grams(text or ""), return_counts=True)
    if len(codes) > k:
        kth = -np.partition(-n, k - 1)[k - 1]
        few = n >= kth
        codes, n = codes[few], n[few]
    return codes[np.lexsort((codes, -n))[:k]]


def _count(lang_col: str, text_col: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def merge():
            for parts in held.values():
                u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                parts[:] = [(u, np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64))]

        def flush():
            merge()
            for lang, [(u, total)] in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(u), pa.string()), "code": u, "n": total})
            held.clear()

        fresh = 0
        for b in (some for whole in batches for some in stretches(whole, whole.schema.get_field_index(text_col))):
            for lang, text in zip(b[lang_col].to_pylist(), b[text_col].to_pylist(), strict=True):
                part = np.unique(grams(text or ""), return_counts=True)
                held.setdefault(lang, []).append(part)
                fresh += len(part[0])
                if fresh > 1_000_000:
                    merge()
                    fresh = 0
                    if sum(len(p[0]) for parts in held.values() for p in parts) > 1_000_000:
                        yield from flush()
        yield from flush()

    return count


class Profiles:
    """Profiles as one sorted list of n-grams and a table of their ranks, one row a language."""

    def __init__(self, ranked: dict[str, list[int]], k: int):
        self.k = k
        self.langs = sorted(ranked)
        self.codes = np.unique(np.array([c for v in ranked.values() for c in v], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, np.array(ranked[lang], dtype=np.int64))] = np.arange(len(ranked[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to every language, as a share of the largest possible one."""
        at = np.searchsorted(self.codes, own)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == own, at, len(self.codes)) if len(self.codes) else at
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, self.k, np.minimum(np.abs(ranks - np.arange(len(own))), self.k))
        return apart.sum(axis=1) / (self.k * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top_grams(text, self.k)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        d = self.distances(own)
        best = int(d.argmin())  # of equal ones the first name
        return self.langs[best], float(1 - d[best])


def fit(docs: DataFrame, training: Column, text_col="text", lang_col="lang", k: int = 300) -> Profiles:
    """Profiles of all training rows with a language. Counts cover every row and whole texts.

    Only ``k`` n-grams a language reach the driver. More than ``MAX_LANGUAGES`` labels are an error,
    since profiles travel to every task.
    """
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counts = rows.mapInArrow(giving_back(_count("lang", "text")), "lang string, code long, n long")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kept = write_table(top, "profiles")
    if (n := kept.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages, at most {MAX_LANGUAGES}")
    ranked: dict[str, list[int]] = {}
    for r in kept.orderBy("lang", "rank").collect():
        ranked.setdefault(r.lang, []).append(r.code)
    return Profiles(ranked, k)


def predict(docs: DataFrame, profiles: Profiles, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col, lang_pred, score`` per row: one minus the distance to the nearest profile.

    Null texts, texts without a letter, and all texts where nothing was learnt are ``und`` with score 0.
    Equal distances go to the first language name. Rows are independent: repeated rows and
    null ids stay; other columns are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (some for whole in batches for some in stretches(whole, 1)):
            found = [shared.value.predict(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(giving_back(run), f"`{id_col}` {kind}, lang_pred string, score double")


def determined(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language :func:`predict` finds. Where nothing was learnt, so that it
    finds none, the rows whose text has a letter."""
    shared, names = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = shared.value, names.index(text_col)
        for b in (some for whole in batches for some in stretches(whole, at)):
            keep = [known.predict(t)[0] != UNDETERMINED if known.langs else len(top_grams(t, known.k)) > 0 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)
