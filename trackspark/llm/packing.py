"""Mixture-controlled packing of token sequences by deficit round-robin.

Documents are tokenised once and gathered into packs of consecutive rows, written as a
table. Inside a pack every source is a queue. For each window a source's deficit grows by
its target share of the window's tokens; the source with the largest deficit is served a piece, until
the window is full. Deficits go on from window to window, and from pack to pack: what a
pack starts with follows from the tokens of all packs before it, so packs are filled
in parallel. Windows are full but for a pack's last tokens, which are cut into
sequences whose lengths are powers of two. So there is no padding at all.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from trackspark.llm.shared import give_back, giving_back, stretches, write_table

WINDOW = 1024
CACHED_CHUNKS = 600_000
ENCODED_AT_ONCE = 8_192
MARKS = ".,;:!?|*&%$#@()[]{}<>+-=/^_~\"\\"

PACKS = "pack long, doc_ids array<long>, sources array<string>, lengths array<long>, ids binary, n_tokens long"
PIECES = (
    "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer's pattern always splits before a single space that a non-space follows or
    another kind of white space follows, so a text without two spaces in a row is the
    sequence of its pieces at spaces, and each distinct piece is encoded once. It also splits between
    a letter and marks or a line feed. So pieces are put together from words, which are units of the pattern and go
    straight to the tokenizer's model, and what ends them; only other pieces go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_letters = byte_letters()
        self.shown_space = chr(self.byte_letters[ord(" ")])
        self.known: dict[str, bytes] = {}  # of a piece, with the space before it
        self.marks: dict[str, bytes] = {}
        self.feed = next(self._encode(["\n"]))

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), ENCODED_AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + ENCODED_AT_ONCE], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _letters(self, core: str, space: str) -> bytes:
        """Ids of letters. Those of ASCII stand for themselves in the byte-level alphabet."""
        letters = core if core.isascii() else core.encode().decode("latin-1").translate(self.byte_letters)
        if space:
            letters = self.shown_space + letters
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _simple(self, part: str, space: str) -> bytes | None:
        """Ids of letters and the marks after them; None for anything else."""
        core = part.rstrip(MARKS)
        if not core.isalpha():
            return None
        ids = self.known.get(core) if space else None
        if ids is None:
            ids = self._letters(core, space)
            if space:
                self.known[core] = ids  # the same letters come with other marks too
        if len(core) == len(part):
            return ids
        marks = part[len(core) :]
        if marks not in self.marks:
            self.marks[marks] = next(self._encode([marks]))
        return ids + self.marks[marks]

    def _learn(self, new: set[str]) -> None:
        other = []
        for p in new:
            # A single line feed between two other characters is a unit too.
            left, feed, right = p.partition("\n")
            ids = self._simple(left, " ")
            if ids is not None and feed:
                after = self._simple(right, "")
                ids = None if after is None else ids + self.feed + after
            if ids is None:
                other.append(p)
            else:
                self.known[p] = ids
        self.known.update(zip(other, self._encode([" " + p for p in other]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For special tokens' strings (``<|``) or runs of spaces the whole text is encoded at once."""
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
            self.marks.clear()
        whole = [t for t in texts if "  " in t or "<|" in t]
        pieces = [None if "  " in t or "<|" in t else t.split(" ") for t in texts]
        firsts = [ps[0] for ps in pieces if ps is not None]
        rest = [ps[1:] for ps in pieces if ps is not None]
        self._learn(set().union(*rest).difference(self.known))
        slow, first, more = self._encode(whole), self._encode(firsts), iter(rest)
        get = self.known.__getitem__
        return [next(slow) if ps is None else next(first) + b"".join(map(get, next(more))) for ps in pieces]


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _packs(path: str, end: int, pack_tokens: int, in_turn: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, sources, tokens, size = [], [], [], 0

        def out():
            nonlocal made, size
            lengths = [len(t) // 4 for t in tokens]
            packed = np.frombuffer(b"".join(tokens), dtype="<u4")
            b = pa.RecordBatch.from_pydict(
                {
                    "pack": [part << 32 | made], "doc_ids": [list(ids)], "sources": [list(sources)], "lengths": [lengths],
                    # two bytes an id where they fit: half the disk and shuffle
                    "ids": [b"\2" + packed.astype("<u2").tobytes() if not len(packed) or packed.max() < 1 << 16 else b"\4" + packed.tobytes()],
                    "n_tokens": [sum(lengths)],
                },
                schema=pa.schema([("pack", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("n_tokens", pa.int64())]),
            )
            made += 1
            ids.clear(), sources.clear(), tokens.clear()
            size = 0
            return b

        last = np.array([end], dtype="<u4").tobytes()
        for b in batches:
            for some in stretches(b, b.schema.get_field_index("text"), in_turn):
                texts = [t or "" for t in some["text"].to_pylist()]
                for doc_id, source, t in zip(some["doc_id"].to_pylist(), some["source"].to_pylist(), encoder(path).encode(texts), strict=True):
                    ids.append(doc_id), sources.append(source), tokens.append(t + last)
                    size += len(t) // 4 + 1
                    if size >= pack_tokens:
                        yield out()
                        give_back()
        if ids:
            yield out()

    return run


def plan_pack(sources: list, lengths: list[int], owed: dict, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Deficit round-robin over one pack: ``(document, start, length, sequence, offset)``.

    ``owed`` has each source's share and what it is owed in tokens when the pack begins. Every window adds its share to
    each source's deficit; the source with the largest deficit is served next (of equal ones the first
    name; a missing source comes last). A piece ends with its document or its window, so a source may be served
    more than it is owed, which its deficit carries on.
    """
    shares = {s: o[0] for s, o in owed.items()}
    deficits = {s: o[1] for s, o in owed.items()}
    queues: dict = {}
    for i, s in enumerate(sources):
        queues.setdefault(s, deque()).append(i)
    names = sorted(queues, key=lambda s: (s is None, s or ""))
    left = sum(lengths)
    out, sequence, at = [], 0, dict.fromkeys(range(len(lengths)), 0)
    while left:
        room = size = window if left >= window else 1 << (left.bit_length() - 1)
        for s in names:
            deficits[s] += shares[s] * size
        offset = 0
        while room:
            s = max(names, key=deficits.__getitem__)
            i = queues[s][0]
            take = min(room, lengths[i] - at[i])
            if take:
                out.append((i, at[i], take, sequence, offset))
            at[i] += take
            offset += take
            room -= take
            deficits[s] -= take
            if at[i] == lengths[i]:
                queues[s].popleft()
                if not queues[s]:
                    names.remove(s)
        left -= size
        sequence += 1
    return out


def _fill(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one pack at a time, however many come together
                row = b.slice(i, 1).to_pylist()[0]
                width = row["ids"][0]
                ids = np.frombuffer(row["ids"], dtype=f"<u{width}", offset=1)
                starts = np.concatenate(([0], np.cumsum(row["lengths"])))
                owed = {d["source"]: (d["share"], d["owed"]) for d in row["owed"]}
                pieces = plan_pack(row["sources"], row["lengths"], owed, window)
                lengths = np.bincount([p[3] for p in pieces], [p[2] for p in pieces]).astype(int).tolist() if pieces else []
                cols = {n: [] for n in ("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")}
                for d, start, length, sequence, offset in pieces:
                    own = ids[starts[d] + start : starts[d] + start + length]
                    for name, value in zip(cols, (row["doc_ids"][d], row["sources"][d], start, length, zlib.crc32(own.astype("<u4").tobytes()), row["lengths"][d], row["first"] + sequence, offset, lengths[sequence]), strict=True):
                        cols[name].append(value)
                kinds = {n: pa.string() if n == "source" else pa.int64() for n in cols}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) for n, v in cols.items()], names=list(cols))

    return run


def _before(rows: DataFrame, by: str, values: list[str], group: int = 4096) -> DataFrame:
    """Sums of ``values`` over all packs before each pack that has the same ``by``.

    In two levels: inside chunks of a task's packs, and over the chunks' totals.
    """
    chunk = F.col("pack") - F.col("pack") % group
    rows = rows.withColumn("chunk", chunk)
    inside = Window.partitionBy(by, "chunk").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "chunk").agg(*[F.sum(v).alias(v) for v in values])
    zero = F.lit(0)
    sums = sums.select(F.col(by).alias("b"), F.col("chunk").alias("c"), *[F.coalesce(F.sum(v).over(across), zero).alias(f"{v}_c") for v in values])
    rows = rows.select(by, "chunk", "pack", *[F.coalesce(F.sum(v).over(inside), zero).alias(f"{v}_i") for v in values])
    joined = rows.join(sums, F.col(by).eqNullSafe(F.col("b")) & (F.col("chunk") == F.col("c")))
    return joined.select(by, "pack", *[(F.col(f"{v}_i") + F.col(f"{v}_c")).alias(f"{v}_before") for v in values])


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    target: dict[str | None, float] | None = None,
    window: int = WINDOW,
    pack_tokens: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: :data:`PIECES`.

    Every document's ids followed by ``end_id`` are placed exactly once. ``target`` gives each source's share of tokens
    in the windows; without it a source's share of all tokens. Sources beyond
    ``target`` have share 0 and are packed when nothing else is left in their pack. Null and empty texts are the end id
    alone; a null source is a source of its own; null ids and repeated rows are packed
    like others. Other columns are ignored. An empty table gives no rows.

    A pack is a bounded number of tokens (or one document), whatever its sources, so a
    source with a third of all rows makes no task larger. Nothing is collected.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    packs = write_table(rows.mapInArrow(giving_back(_packs(tokenizer_path, end_id, pack_tokens)), PACKS), "packs")
    per_source = (
        packs.select("pack", F.explode(F.arrays_zip("sources", "lengths")).alias("d"))
        .groupBy("pack", F.col("d.sources").alias("source"))
        .agg(F.sum("d.lengths").alias("tokens"))
    )
    per_source = write_table(per_source, "pack_sources")
    if target is None:
        weights = per_source.groupBy("source").agg(F.sum("tokens").cast("double").alias("weight"))
    else:
        weights = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in target.items()], "source string, weight double")
    whole = weights.agg(F.sum("weight").alias("whole"))
    shares = weights.join(F.broadcast(whole)).select(F.col("source").alias("s"), (F.col("weight") / F.col("whole")).alias("share"))

    tail = F.col("n_tokens") % window
    made = (F.floor(F.col("n_tokens") / window) + F.bit_count(tail)).cast("bigint")
    sequences = packs.select("pack", "n_tokens", made.alias("sequences"), F.lit("").alias("all"))
    before = _before(sequences, "all", ["n_tokens", "sequences"]).drop("all")
    owed = (
        _before(per_source, "source", ["tokens"])
        .join(before.select("pack", "n_tokens_before"), "pack")
        .join(shares, F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("share", F.coalesce("share", F.lit(0.0)))
        .withColumn("owed", F.col("share") * F.col("n_tokens_before") - F.col("tokens_before"))
        .groupBy("pack")
        .agg(F.collect_list(F.struct("source", "share", "owed")).alias("owed"))
    )
    ready = packs.join(before.select("pack", F.col("sequences_before").alias("first")), "pack").join(owed, "pack")
    return ready.select("doc_ids", "sources", "lengths", "ids", "first", "owed").mapInArrow(giving_back(_fill(window)), PIECES)
