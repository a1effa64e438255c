"""Language-model scores by prediction by partial matching, pretrained on the corpus.

The model is a trie of byte contexts up to ``order`` bytes long. A byte that its longest known context has
seen is coded there; otherwise the code escapes to the next shorter context, in which the bytes seen in the longer one
are excluded. Counts come from all training documents, and every n-gram seen at least ``min_count`` times is a node. The trie is cut into shards
by the last three bytes of the context, where a context meets all shorter ones down to three bytes; those of fewer bytes are in every
shard. Blocks send their distinct n-grams and get their code lengths back.

The text that is coded is the sequence of lower-cased words joined by one space, and an end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from trackspark.llm import blocks as B
from trackspark.llm.shared import crc_remainder, write_table

ORDER = 6
ALPHABET = 256
END = b"\n"  # never part of a word
AT_ONCE = 2 << 20
TAIL = np.uint64((1 << 24) - 1)
GRAMS = "block long, shard long, n long, keys binary, counts binary"
ANSWER = "block long, shard long, answer binary"
EVERYWHERE = 2  # orders up to this one are in every shard's trie
FINE = 16  # code lengths travel without so many of their last bits, rounded


def coded(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts the number made of it and the ``order`` bytes before it (before a text: ends),
    and where each text begins."""
    pad = END * order
    raw = np.frombuffer(b"".join([pad + t for t in texts]), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.zeros(max(0, len(raw) - order), dtype=np.uint64)
    for i in range(order + 1):
        code = code << np.uint64(8) | raw[i : i + len(code)]
    begins = np.concatenate(([0], np.cumsum(lengths + order)[:-1])) if len(texts) else np.empty(0, np.int64)
    inside = np.ones(len(code), dtype=bool)  # a byte of padding is never coded
    for i in range(order):
        late = begins[1:] - order + i
        inside[late] = False
    return code[inside], np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(texts) else begins


def all_orders(code: np.ndarray, order: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all lengths as numbers that carry their length, and their counts."""
    found, many = [], []
    if counts is None:
        u, n = np.unique(code, return_counts=True)  # sorts, which is much faster than the inverse or no counts
    else:
        u, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, counts, len(u)).astype(np.int64)
    for j in range(order, -1, -1):
        if j < order:
            u, at = np.unique(u & np.uint64((1 << (8 * (j + 1))) - 1), return_inverse=True)
            n = np.bincount(at, n, len(u)).astype(np.int64)
        found.append(u << np.uint64(3) | np.uint64(j))
        many.append(n)
    return np.concatenate(found), np.concatenate(many)


def squeezed(x: np.ndarray) -> bytes:
    """Compressed by byte planes: most planes of small numbers are zero."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def stretched(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=size * n)
    return np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def listed(x: np.ndarray) -> bytes:
    """Numbers, of which few differ, as a list of the different ones and each one's place in it."""
    values, at = np.unique(x.view(np.uint64), return_inverse=True)
    list_ = squeezed(np.diff(values, prepend=np.uint64(0)))
    return np.array([len(values), len(list_)], dtype="<u4").tobytes() + list_ + squeezed(at.astype(_place(len(values))))


def unlisted(data: bytes, n: int) -> np.ndarray:
    values, size = np.frombuffer(data, dtype="<u4", count=2).tolist()
    of = np.cumsum(stretched(data[8 : 8 + size], values, np.uint64), dtype=np.uint64).view(np.float64)
    return of[stretched(data[8 + size :], n, _place(values))]


def _place(values: int) -> str:
    return "<u1" if values <= 1 << 8 else "<u2" if values <= 1 << 16 else "<u4"


class Trie:
    """Code lengths of n-grams. Nodes of order j are contexts of j bytes; a node's bytes are the n-grams above it.

    A byte counted n times in a context has (n - 1/2) of the context's total. The rest is the escape: half a
    count for each kept byte (method D), and all counts of bytes whose nodes weren't kept, being counted less than ``least`` times.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, least: int = 1):
        self.order = order
        which = (keys & np.uint64(7)).astype(int)
        self.grams, self.n, self.nodes, self.total, self.escape = [], [], [], [], []
        for j in range(order + 1):
            g, n = keys[which == j] >> np.uint64(3), counts[which == j].astype(float)
            by = np.argsort(g)
            every, often = g[by], n[by]
            g, n = every[often >= least], often[often >= least]
            node, own = np.unique(g >> np.uint64(8), return_inverse=True)
            kept, kinds = np.bincount(own, n, len(node)), np.bincount(own, minlength=len(node))
            # A context occurs as often as its last byte follows the bytes before it, or as bytes follow it, where the former isn't
            # in this shard; contexts before a text, once a text.
            total = kept
            if j > 1:
                at, found = self._find(self.grams[j - 1], node)
                of, here = self._find(node, every >> np.uint64(8))
                followed = np.bincount(of[here], often[here], len(node))
                total = np.where(found, np.maximum(self.n[j - 1][at], kept), followed) if len(self.grams[j - 1]) else followed
            if j and len(node):
                starts = self._find(self.grams[0], np.array([END[0]], dtype=np.uint64))
                before = np.uint64(int.from_bytes(END * j, "big"))
                total = np.where(node == before, np.maximum(self.n[0][starts[0][0]] if starts[1][0] else 0, kept), total)
            for v, x in ((self.grams, g), (self.n, n), (self.nodes, node), (self.total, total), (self.escape, total - kept + 0.5 * kinds)):
                v.append(x)
        # For each node: the total and escape of its parent (the context without its first byte) without its own bytes.
        self.left_total, self.left_escape = [np.empty(0)], [np.empty(0)]
        for j in range(1, order + 1):
            if not len(self.nodes[j]):
                self.left_total.append(np.empty(0))
                self.left_escape.append(np.empty(0))
                continue
            parent = self._find(self.nodes[j - 1], self.nodes[j] & self._mask(j - 1))[0]
            at, found = self._find(self.grams[j - 1], self.grams[j] & self._mask(j))
            own = np.searchsorted(self.nodes[j], self.grams[j] >> np.uint64(8))
            taken = np.bincount(own, np.where(found, self.n[j - 1][at], 0.0), len(self.nodes[j]))
            self.left_total.append(self.total[j - 1][parent] - taken)
            self.left_escape.append(self.escape[j - 1][parent] - 0.5 * np.bincount(own, found, len(self.nodes[j])))

    @staticmethod
    def _mask(j: int) -> np.uint64:
        return np.uint64((1 << (8 * j)) - 1)

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last byte after the bytes before it."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        above = np.full(len(code), -1)  # the longer context's node, once one was found
        for j in range(self.order, -1, -1):
            if not len(self.nodes[j]):
                continue
            c, up = code[todo], above[todo]
            node, known = self._find(self.nodes[j], (c >> np.uint64(8)) & self._mask(j))
            at, seen = self._find(self.grams[j], c & self._mask(j + 1))
            total, escape = self.total[j][node], self.escape[j][node]
            if j < self.order and len(self.nodes[j + 1]):
                total = np.where(up < 0, total, self.left_total[j + 1][up])
                escape = np.where(up < 0, escape, self.left_escape[j + 1][up])
            some = known & (total > 0) & (escape > 0)  # else every byte of this context is excluded
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.log10(np.where(seen, self.n[j][at] - 0.5, escape) / total)
            out[todo] += np.where(some, part, 0.0)
            above[todo] = np.where(known, node, -1)
            todo = todo[~(some & seen)]
        out[todo] -= np.log10(ALPHABET - len(self.grams[0]))
        return out


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[str, int, bytes, bytes]:
    """The trie's n-grams and counts, compressed for their way to the tasks, under a name of their own."""
    by = np.argsort(keys)
    press = zstandard.ZstdCompressor(level=3).compress
    steps = np.diff(keys[by], prepend=np.uint64(0))
    return uuid.uuid4().hex, len(keys), press(steps.tobytes()), press(counts[by].astype("<u8").tobytes())


_tries: dict[str, Trie] = {}


def opened(data: tuple[str, int, bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams and counts of :func:`packed`."""
    _, n, steps, counts = data
    open_ = zstandard.ZstdDecompressor().decompress
    keys = np.cumsum(np.frombuffer(open_(steps, max_output_size=8 * n), dtype=np.uint64), dtype=np.uint64)
    return keys, np.frombuffer(open_(counts, max_output_size=8 * n), dtype="<u8")


def unpacked(data: tuple[str, int, bytes, bytes], order: int) -> Trie:
    """The trie, built once in each worker."""
    if data[0] not in _tries:
        _tries.clear()
        _tries[data[0]] = Trie(*opened(data), order)
    return _tries[data[0]]


def _codes(texts: list[bytes], order: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *[grams(part, order)[0] for part in _parts(texts)]])


def counted(texts: list[bytes], learnt: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts, ascending, and how often those to learn from have each. One sort of n-grams with a last bit
    that tells whether they are learnt."""
    code = np.empty(sum(map(len, texts)), dtype=np.uint64)
    at = done = 0
    for part in _parts(texts):
        own = np.repeat(np.array(learnt[done : done + len(part)], dtype=np.uint64), [len(t) for t in part])
        code[at : at + len(own)] = grams(part, order)[0] << np.uint64(1) | own
        at, done = at + len(own), done + len(part)
    code.sort()
    own = (code & np.uint64(1)).astype(np.uint8)
    code >>= np.uint64(1)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), dtype=bool), code[1:] != code[:-1])))
    return code[first], np.add.reduceat(own, first, dtype="<u4") if len(first) else np.empty(0, dtype="<u4")


def _by_shard(code: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending n-grams by the shard of their contexts, and where shards end."""
    shard = ((B.mixed(code >> np.uint64(8) & TAIL) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    by = np.argsort(shard, kind="stable")  # n-grams ascend within a shard
    return by, np.searchsorted(shard[by], np.arange(shards + 1, dtype=np.uint64))


def code_lengths(table: DataFrame, training, order: int, min_count: int) -> DataFrame:
    """``block, shard, answer``: for a table of blocks, the code lengths of each block's distinct n-grams.

    Every n-gram of the training documents is counted in its shard. Those of up to three bytes are summed over blocks and reach all shards:
    2^24 + 65,792 at most, and far fewer in texts.
    """
    shards = B.shards_for(table)
    plain = table.select("block", "ids", "texts")

    def shortest(row: dict) -> Iterator[dict]:
        own = [coded(t.lower().split()) for i, t in zip(row["ids"], B.unpack_texts(row["texts"], len(row["ids"])), strict=True) if training(i)]
        u, n = all_orders(_codes(own, min(order, EVERYWHERE)), min(order, EVERYWHERE))
        yield {"gram": u.astype(np.int64), "n": n}

    def send(row: dict) -> Iterator[dict]:
        texts = [coded(t.lower().split()) for t in B.unpack_texts(row["texts"], len(row["ids"]))]
        code, counts = counted(texts, [training(i) for i in row["ids"]], order)
        by, ends = _by_shard(code, shards)
        code, counts = code[by], counts[by]
        cols: dict[str, list] = {c: [] for c in ("block", "shard", "n", "keys", "counts")}
        for s, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b:
                steps = np.diff(code[a:b], prepend=np.uint64(0))
                for c, v in zip(cols, (row["block"], s, int(b - a), squeezed(steps), squeezed(counts[a:b])), strict=True):
                    cols[c].append(v)
        yield cols

    short = B.each_block(plain, "gram long, n long", shortest).groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).toArrow()
    everywhere = table.sparkSession.sparkContext.broadcast(packed(short["gram"].to_numpy().astype(np.uint64), short["n"].to_numpy()))

    def answer(key, t):
        sizes = t["n"].to_numpy()
        code = np.concatenate([np.cumsum(stretched(k, n, np.uint64), dtype=np.uint64) for k, n in zip(t["keys"].to_pylist(), sizes.tolist(), strict=True)])
        counts = np.concatenate([stretched(c, n, np.uint32) for c, n in zip(t["counts"].to_pylist(), sizes.tolist(), strict=True)])
        u, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, counts, len(u)).astype(np.int64)
        keys, often = all_orders(u[n > 0], order, n[n > 0])
        long = (keys & np.uint64(7)) > EVERYWHERE
        first, many = opened(everywhere.value)
        trie = Trie(np.concatenate([first, keys[long]]), np.concatenate([many.astype(np.int64), often[long]]), order, min_count)
        told = ((trie.log10(u).view(np.uint64) + np.uint64(1 << FINE - 1)) >> np.uint64(FINE) << np.uint64(FINE)).view(np.float64)[at]
        parts = [listed(p) for p in np.split(told, np.cumsum(sizes)[:-1])]
        return pa.table({"block": t["block"].combine_chunks(), "shard": t["shard"].combine_chunks(), "answer": pa.array(parts, pa.binary())})

    return B.each_block(plain, GRAMS, send).groupBy("shard").applyInArrow(answer, ANSWER)


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def score_documents(
    docs: DataFrame, folds: int = 5, held_out: int = 1, id_col="doc_id", text_col="text",
    order: int = ORDER, min_count: int = 2, block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Training rows are those whose crc32 of the id, modulo ``folds``, isn't ``held_out``; a null id is in neither part, and is scored. ``base_score``
    is the smoothed unigram model of the training tokens, ``score`` the model's log10 probability of the text. Null
    and empty texts are the end alone. Repeated rows count each. Without training rows every byte has
    probability 1/256. Other columns are ignored; an empty table gives no rows. ``order`` is at most 6.
    """
    table = B.write_blocks(docs, id_col, text_col, block_bytes)
    shards = B.shards_for(table)

    def training(doc_id: int | None) -> bool:
        return crc_remainder(doc_id, folds) not in (-1, held_out)

    lengths_of = code_lengths(table, training, order, min_count)
    lengths_of = lengths_of.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("codes"))

    def tokens(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, B.Shards]:
        """The coded texts, each token's number among the block's distinct ones, how many each text has, and the distinct ones."""
        known: dict[bytes, int] = {END: 0}
        texts, parts = [], []
        for t in B.unpack_texts(row["texts"], len(row["ids"])):
            words = t.lower().split()
            texts.append(coded(words))
            words.append(END)
            parts.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32))
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        return texts, np.concatenate([np.empty(0, np.int32), *parts]), lengths, B.Shards(B.word_digests(list(known)), shards)

    def send(row: dict) -> Iterator[dict]:
        _, of, lengths, own = tokens(row)
        learnt = np.repeat([training(i) for i in row["ids"]], lengths)
        yield from own.sent(row["block"], np.bincount(of[learnt], minlength=len(own.keys)).astype("<u4"))

    def count(keys: np.ndarray, block: np.ndarray, extra: bytes):
        u, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, np.frombuffer(extra, dtype="<u4"), len(u)).astype(np.uint64)
        return n[at], int((n > 0).sum())

    plain = table.select("block", "ids", "texts")
    answers = write_table(B.shard_answers(B.each_block(plain, B.SENT, send), count), "counts")
    distinct = answers.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]

    def learnt_tokens(row: dict) -> Iterator[dict]:
        own = B.unpack_texts(row["texts"], len(row["ids"]))
        yield {"n": [sum(len(t.split()) + 1 for i, t in zip(row["ids"], own, strict=True) if training(i))]}

    total = B.each_block(plain, "n long", learnt_tokens).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def finish(row: dict) -> Iterator[dict]:
        texts, of, lengths, own = tokens(row)
        n = own.answered(row["answers"], np.uint64).astype(float)
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        each = np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
        known = counted(texts, [False] * len(texts), order)[0]
        by, ends = _by_shard(known, shards)
        told, scores = np.empty(len(known)), []
        for r in row["codes"]:
            a, b = ends[r["shard"]], ends[r["shard"] + 1]
            told[by[a:b]] = unlisted(r["answer"], int(b - a))
        for part in _parts(texts):
            code, starts = grams(part, order)
            own_grams, at = np.unique(code, return_inverse=True)  # looked up in order, and once each
            scores.append(np.add.reduceat(told[np.searchsorted(known, own_grams)][at], starts))
        yield {
            "doc_id": row["ids"], "held_out": [crc_remainder(i, folds) == held_out for i in row["ids"]], "n_tokens": lengths,
            "n_known": np.add.reduceat((n > 0)[of].astype(np.int64), begins), "train_tokens": [total] * len(texts),
            "base_score": np.add.reduceat(each[of], begins), "score": np.concatenate(scores),
        }

    told = plain.join(B.by_block(answers), "block", "left").join(lengths_of, "block", "left")
    return B.each_block(told, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", finish)
