"""Documents in blocks, and lookups of what blocks have in common.

A block is one row: consecutive documents of bounded size, compressed, written to the shared folder once. A task
can then work on a block again and again and always finds the same documents in the same order.

:func:`exchange` answers what a block must know about all other blocks. Every block sends
its distinct keys, packed by shard of the key; a shard sees each key once per block
however often it occurs there, so a key that a third of all rows share weighs no more than one entry a
block; and the answers come back packed, aligned with what the block sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from trackspark.llm.shared import give_back, giving_back, stretches, write_table

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 20
SCHEMA = "block long, size long, ids array<long>, texts binary"
SENT = "block long, shard long, n long, keys binary, extra binary"
ANSWER = "block long, shard long, answer binary, total long"


def pack_texts(texts: list[bytes]) -> bytes:
    lengths = np.array([len(t) for t in texts], dtype="<u4")
    return zstandard.ZstdCompressor(level=1).compress(lengths.tobytes() + b"".join(texts))


def unpack_texts(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = (4 * n + np.cumsum(np.frombuffer(raw, dtype="<u4", count=n), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends)]


def write_blocks(docs: DataFrame, id_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES, look=None, look_schema: str = "") -> DataFrame:
    """The table of blocks: a text longer than ``block_bytes`` is a block of its own; null counts as empty.

    ``look(ids, texts)`` may add columns (``look_schema``) that are found while the texts are at hand.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    extra = [c.split(" ")[0] for c in look_schema.split(", ") if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def out():
            nonlocal made, size
            cols = {"block": pa.array([part << 32 | made]), "size": pa.array([size]), "ids": pa.array([ids], pa.list_(pa.int64())), "texts": pa.array([pack_texts(texts)], pa.binary())}
            if look is not None:
                cols |= dict(zip(extra, [pa.array([v], pa.binary()) for v in look(ids, texts)], strict=True))
            made += 1
            ids.clear(), texts.clear()
            size = 0
            return pa.RecordBatch.from_pydict(cols)

        for b in batches:
            for some in stretches(b, 1):
                for i, t in zip(some["id"].to_pylist(), some["text"].cast(pa.binary()).to_pylist(), strict=True):
                    if ids and (size + len(t or b"") > block_bytes or len(ids) == BLOCK_ROWS):
                        yield out()
                        give_back()
                    ids.append(i)
                    texts.append(t or b"")
                    size += len(texts[-1])
        if ids:
            yield out()

    return write_table(rows.mapInArrow(giving_back(run, forget_words), SCHEMA + (", " + look_schema if look_schema else "")), "blocks")


def row_key(block: int, position: int) -> int:
    """A number of its own for each row of a table, whatever its id is."""
    return block >> 32 << 42 | (block & 0x1FFFFF) << 21 | position


def shards_for(blocks: DataFrame) -> int:
    return max(1, blocks.select("block").count())


def each_block(table: DataFrame, schema: str, work: Callable) -> DataFrame:
    """Rows ``work(row)`` yields (dictionaries of columns, lists or arrays) for each block's row."""
    columns = [tuple(c.split(" ")) for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                for made in work(row):
                    yield pa.RecordBatch.from_arrays([pa.array(made[n], kinds[k]) for n, k in columns], names=[n for n, _ in columns])
                row = made = None
                give_back()

    return table.mapInArrow(giving_back(run, forget_words), schema)


class Shards:
    """Order of keys by shard. A key's shard is fixed by its upper half; several arrays can follow it."""

    def __init__(self, keys: np.ndarray, shards: int):
        shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        self.order = np.argsort(keys, kind="stable")  # shards ascend with the keys
        self.ends = np.searchsorted(shard[self.order], np.arange(shards + 1, dtype=np.uint64))
        self.keys = keys

    def sent(self, block: int, extra: np.ndarray | None = None) -> Iterator[dict]:
        """Rows of :data:`SENT`: keys ascend within a shard; ``extra`` has one item per key."""
        keys, more = self.keys[self.order], None if extra is None else extra[self.order]
        cols: dict[str, list] = {n: [] for n in ("block", "shard", "n", "keys", "extra")}
        for s, (a, b) in enumerate(zip(self.ends, self.ends[1:])):
            if a < b:
                for name, v in zip(cols, (block, s, int(b - a), keys[a:b].tobytes(), b"" if more is None else more[a:b].tobytes()), strict=True):
                    cols[name].append(v)
        yield cols

    def answered(self, answers: list | None, kind) -> np.ndarray:
        """Answers of :func:`exchange` for this block, in the order of ``keys``."""
        out = np.zeros(len(self.keys), dtype=kind)
        for r in answers or []:
            a, b = self.ends[r["shard"]], self.ends[r["shard"] + 1]
            out[self.order[a:b]] = np.frombuffer(r["answer"], dtype=kind)
        return out


def exchange(sent: DataFrame, answer: Callable[[np.ndarray, np.ndarray, bytes], np.ndarray]) -> DataFrame:
    """``block, answers``: per shard, ``answer(keys, blocks, extra)`` sees the keys of all blocks, each entry's
    block, and the joined extras, and returns one item per entry."""
    return by_block(shard_answers(sent, answer))


def shard_answers(sent: DataFrame, answer: Callable) -> DataFrame:
    """:data:`ANSWER` rows. Where ``answer`` returns a pair, its second part is a number of the shard (``total``)."""

    def run(key, table):
        sizes = table["n"].to_numpy()
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), dtype=np.uint64)
        block = np.repeat(table["block"].to_numpy(), sizes)
        items = answer(keys, block, b"".join(table["extra"].to_pylist()))
        items, total = items if isinstance(items, tuple) else (items, 0)
        parts = [p.tobytes() for p in np.split(items, np.cumsum(sizes)[:-1])]
        totals = pa.array([total] + [0] * (len(sizes) - 1), pa.int64())
        return pa.table({"block": table["block"].combine_chunks(), "shard": table["shard"].combine_chunks(), "answer": pa.array(parts, pa.binary()), "total": totals})

    return sent.groupBy("shard").applyInArrow(run, ANSWER)


def by_block(answers: DataFrame) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry's number among the distinct keys, and how many entries each has."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return at, n


class Words(dict):
    """64-bit digests of words, remembered."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        v = self[word] = xxh3_64_intdigest(word)
        return v


WORDS = Words()


def forget_words() -> None:
    WORDS.clear()


def word_digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(digests: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Digest of the ``k`` consecutive items that start at each position."""
    n = len(digests) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, salt, dtype=np.uint64)
    odd = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)  # in no linear relation, so order always counts
    for i in range(k):
        total += digests[i : i + n] * odd[i]
    return mixed(total)
