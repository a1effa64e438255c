"""Secrets in texts: fixed patterns, and long tokens that look random by a battery of tests.

Every run of 16 or more token characters is a candidate. Its encoding is the smallest alphabet that holds it. Three tests ask whether
its symbols may be random in that alphabet: chi-squared uniformity, the runs about the alphabet's middle, and serial correlation.
A candidate that passes all three is then held against ordinary text: chi-squared against the symbol frequencies that all short words of the
corpus have. These last p-values, weighted by the bits a token of its length and alphabet can carry, go through Benjamini and
Hochberg's step-up over all candidates of the corpus, those that failed the battery included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackspark.llm.shared import write_table

# The base patterns and the least lengths, of group 2 or of the whole match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

LEAST = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets in ascending size; a token has the first that holds all its symbols.
ALPHABETS = (
    _DIGITS,
    _DIGITS + _LOWER[:6],
    _DIGITS + _UPPER[:6],
    _LOWER,
    _UPPER,
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _LOWER + _UPPER,
    _DIGITS + _LOWER + _UPPER,
    _DIGITS + _LOWER + _UPPER + "+/",
    _DIGITS + _LOWER + _UPPER + "-_",
    _DIGITS + _LOWER + _UPPER + "+/-_",
)
_SIZES = np.array([len(a) for a in ALPHABETS])
_VALUE = np.full((len(ALPHABETS), 256), -1, dtype=np.int64)
for _i, _a in enumerate(ALPHABETS):
    _VALUE[_i, np.frombuffer(_a.encode(), dtype=np.uint8)] = np.arange(len(_a))
_IN = ((_VALUE >= 0) * (1 << np.arange(len(ALPHABETS)))[:, None]).sum(axis=0)  # by symbol: alphabets that hold it
_MIXED = 1 << ALPHABETS.index(_DIGITS + _LOWER + _UPPER)

#: A random token fails the battery once in a hundred.
BATTERY_Z = 2.94
FULL_BITS = 128
#: The share of symbols that ordinary text is allowed to draw evenly.
NOISE = 0.1
_BINS = 100  # a score's bins per unit of the natural logarithm
_TOP = 200 * _BINS


@dataclass(frozen=True)
class Battery:
    """What the tests say of some tokens: number of the alphabet, z-values of the three tests, logarithm of the p-value
    against ordinary text, and weight."""

    alphabet: np.ndarray
    uniform: np.ndarray
    runs: np.ndarray
    serial: np.ndarray
    log_p: np.ndarray
    weight: np.ndarray

    @property
    def passed(self) -> np.ndarray:
        return (np.abs(self.uniform) <= BATTERY_Z) & (np.abs(self.runs) <= BATTERY_Z) & (np.abs(self.serial) <= BATTERY_Z)


def battery(tokens: list[bytes], frequency: np.ndarray) -> Battery:
    """The tests over tokens, given how often ordinary text has each of the 256 byte values.

    ``-`` and ``_`` between symbols of an alphabet with a single case are separators and don't count, nor does ``=`` at the end.
    """
    bare = [t.rstrip(b"=") for t in tokens]
    plain = [t.replace(b"-", b"").replace(b"_", b"") for t in bare]
    held = _held(plain)
    one_case = (held & (_MIXED - 1)) != 0
    whole = [p if o and p else b for p, b, o in zip(plain, bare, one_case.tolist())]
    held = _held(whole)
    alphabet = np.argmax(held[:, None] >> np.arange(len(ALPHABETS)) & 1, axis=1)
    size = _SIZES[alphabet].astype(np.float64)
    n = np.array([len(t) for t in whole])
    token = np.repeat(np.arange(len(whole)), n)
    value = _VALUE[alphabet[token], np.frombuffer(b"".join(whole), dtype=np.uint8)]
    length, wide = n.astype(np.float64), int(_SIZES.max())
    counts = np.bincount(token * wide + value, minlength=len(whole) * wide).reshape(-1, wide).astype(np.float64)

    squares = (counts**2).sum(axis=1)
    chi = squares * size / length - length
    uniform = (chi - (size - 1)) / np.sqrt(2 * (size - 1) * (length - 1) / length)

    inner = token[1:] == token[:-1]
    pairs = token[1:][inner]
    half = size // 2
    upper = value >= half[token]
    share = 2 * half * (size - half) / size**2
    turns = np.bincount(pairs, weights=(upper[1:] != upper[:-1])[inner], minlength=len(whole))
    runs = (turns - (length - 1) * share) / np.sqrt((length - 1) * share * (1 - share))

    centred = value - (np.bincount(token, weights=value, minlength=len(whole)) / length)[token]
    spread = np.bincount(token, weights=centred**2, minlength=len(whole))
    products = np.bincount(pairs, weights=(centred[1:] * centred[:-1])[inner], minlength=len(whole))
    serial = np.sqrt(length) * (np.divide(products, spread, out=np.ones_like(products), where=spread > 0) + 1 / length)

    expected = np.zeros((len(ALPHABETS), wide))
    for i, a in enumerate(ALPHABETS):
        f = frequency[np.frombuffer(a.encode(), dtype=np.uint8)] + 1.0
        expected[i, : len(a)] = (1 - NOISE) * f / f.sum() + NOISE / len(a)  # keeps the variance within the square of the mean
    q = expected[alphabet]
    inverse = np.divide(1.0, q, out=np.zeros_like(q), where=q > 0)
    against = (counts**2 * inverse).sum(axis=1) / length - length
    mean = size - 1
    variance = 2 * mean + (inverse.sum(axis=1) - size**2 - 2 * size + 2) / length
    shape = mean**2 / variance  # a gamma distribution of the same mean and variance, by Wilson and Hilferty's cube root
    z = (np.cbrt(np.maximum(against, 0) / mean) - (1 - 1 / (9 * shape))) * 3 * np.sqrt(shape)
    log_p = np.where(z > 0, np.log(0.5) - z * z / 2, 0.0)  # an upper bound of the normal tail
    weight = np.minimum(length * np.log2(size) / FULL_BITS, 1.0)
    return Battery(alphabet, uniform, runs, serial, log_p, weight)


def _held(tokens: list[bytes]) -> np.ndarray:
    """Bits of the alphabets that hold all of a token's symbols."""
    n = np.array([len(t) for t in tokens])
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    bits = np.append(_IN[np.frombuffer(b"".join(tokens), dtype=np.uint8)], -1)  # all alphabets, for an empty end
    return np.where(n > 0, np.bitwise_and.reduceat(bits, at), 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, number of the kind, end)`` of the fixed patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """Start and text of long tokens that touch no base span."""
    found = [(m.start(), m.group()) for m in CANDIDATE.finditer(text)]
    if found and base:
        reach, k, free = 0, 0, []
        for start, token in found:
            while k < len(base) and base[k][0] < start + len(token):
                reach = max(reach, base[k][2])
                k += 1
            if reach <= start:
                free.append((start, token))
        return free
    return found


_SPANS = pa.list_(pa.int64())
_FOUND = pa.schema(
    [("starts", _SPANS), ("kinds", _SPANS), ("ends", _SPANS), ("token_starts", _SPANS), ("tokens", pa.list_(pa.binary())), ("counts", _SPANS)]
)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and candidates by row; and from each task, in a row of its own, how often ordinary text has each byte."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(256, dtype=np.int64), None
        for b in batches:
            kind, ids, cols = b.schema.field("doc_id").type, b["doc_id"], [[] for _ in _FOUND]
            for t in b["text"]:
                text = t.as_py() or ""
                base = base_spans(text)
                tokens = candidates(text, base)
                counts += np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
                for made, v in zip(cols, ([s for s, _, _ in base], [k for _, k, _ in base], [e for _, _, e in base], [s for s, _ in tokens], [x.encode() for _, x in tokens], None)):
                    made.append(v)
                long = "".join([text[s:e] for s, _, e in base] + [x for _, x in tokens])
                if long:
                    counts -= np.bincount(np.frombuffer(long.encode(), dtype=np.uint8), minlength=256)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(cols, _FOUND)]], names=["doc_id", *_FOUND.names])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, f.type) for f in list(_FOUND)[:-1]], pa.array([counts.tolist()], _SPANS)], names=["doc_id", *_FOUND.names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = "starts array<bigint>, kinds array<bigint>, ends array<bigint>, token_starts array<bigint>, tokens array<binary>, counts array<bigint>"
    return write_table(rows.mapInArrow(run, f"doc_id {kind}, {spans}"), "candidates")


def _scored(found: DataFrame, frequency: np.ndarray) -> DataFrame:
    """Adds ``scores``, one per candidate: bins of ln(weight / p), -1 for what the battery takes for structured; and ``weights``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["tokens"]
            tokens = lists.flatten().to_pylist()
            if tokens:
                t = battery(tokens, frequency)
                weight = np.maximum(np.rint(t.weight * 1000), 1).astype(np.int64)
                score = np.clip(np.floor(_BINS * (np.log(weight / 1000) - t.log_p)), 0, _TOP).astype(np.int64)
                score[~t.passed] = -1
            else:
                score = weight = np.zeros(0, dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists.to_pylist()])]).astype(np.int32)
            made = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (score, weight)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "scores", "weights"])

    kept = found.where("counts is null").drop("counts")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return write_table(kept.mapInArrow(run, kind + ", scores array<bigint>, weights array<bigint>"), "scores")


def _threshold(scored: DataFrame, level: float) -> int:
    """The least score that is discovered: step-up over the counts of all candidates' scores."""
    each = scored.select(F.explode(F.arrays_zip("scores", "weights")).alias("c")).select("c.scores", "c.weights")
    rows = each.groupBy("scores").agg(F.count("*").alias("n"), F.sum("weights").alias("weight")).collect()  # 20,002 at most
    m = sum(r.n for r in rows)
    mean = sum(r.weight for r in rows) / 1000 / m if m else 1.0
    best, above = _TOP + 1, 0
    for r in sorted((r for r in rows if r.scores >= 0), key=lambda r: -r.scores):
        above += r.n
        if m * mean * np.exp(-r.scores / _BINS) <= level * above:
            best = r.scores
    return int(best)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = 0.001) -> DataFrame:
    """``doc_id, spans`` of each row; ``spans`` are ``kind, start, end`` in code points by start, then kind.

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns, leftmost and non-overlapping each by itself; ``random`` are long tokens
    beside them, of which a share of ``level`` at most is expected to be ordinary text. Equal tokens get equal answers.

    Every row is judged alone against the corpus: repeated rows and ids each get their row, a null id stays null. Null and empty texts have
    no spans; a table without candidates has no random ones. A very long text is one task's work. Other columns aren't read.
    """
    found = _scan(docs, id_col, text_col)
    total = found.where("counts is not null").select(F.posexplode("counts").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n"))
    frequency = np.zeros(256)
    for r in total.collect():
        frequency[r.byte] = r.n
    scored = _scored(found, frequency)
    least = _threshold(scored, level)
    base = F.transform(F.arrays_zip("starts", "kinds", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["kinds"].alias("order"), s["ends"].alias("end")))
    zipped = F.arrays_zip("token_starts", "tokens", "scores")
    random = F.transform(
        F.filter(zipped, lambda s: s["scores"] >= least),
        lambda s: F.struct(
            s["token_starts"].alias("start"), F.lit(3).cast("bigint").alias("order"), (s["token_starts"] + F.octet_length(s["tokens"])).alias("end")
        ),
    )
    named = F.transform(
        F.array_sort(F.concat(base, random)),
        lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), (s["order"] + 1).cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return scored.select("doc_id", named.alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
