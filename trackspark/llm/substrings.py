"""Substring deduplication with prefix-partitioned suffix trees.

The suffixes are those of word sequences. Not every suffix is indexed: of the ``anchor``-word
prefixes that start inside a window of ``window`` words, the one with the least digest is that window's
anchor, so equal windows have equal anchors at equal places, and every window hangs on one
indexed suffix.

1. Suffixes at anchors are grouped by the first words' digest. A group of one is a leaf near the root:
   nothing below it repeats, and it is dropped. Shards by prefix are of bounded size.
2. A group that is left is split by longer prefixes: the windows that hang on its suffixes, each
   the digest of ``window`` words at one distance from the anchor. These are the nodes ``window`` words
   deep; one with more than one leaf is a repeat, and all its leaves but the first are
   removable. Runs of such leaves are the maximal repeats.

A block sends each prefix and each deep node once, with its first leaf, whatever number of leaves it has
there, so a passage that a third of all documents share stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from trackspark.llm import blocks as B


def split_words(text: bytes) -> list[bytes]:
    return text.split()

LEAF = [("two", "<u4"), ("id", "<i8")]


class _Suffixes:
    """The suffixes of a block's documents, end to end; windows never reach over a document's end."""

    def __init__(self, row: dict, window: int, anchor: int):
        self.words = [t.split() for t in B.unpack_texts(row["texts"], len(row["ids"]))]
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        digests = B.word_digests([w for ws in self.words for w in ws])
        self.digests, self.window, self.anchor = digests, window, anchor
        n = len(digests)
        inside = np.repeat(self.ends, lengths) - np.arange(n) >= window  # windows that fit into their document
        self.starts = np.flatnonzero(inside)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)[self.starts]
        heads = B.runs(digests, anchor)
        if len(self.starts):
            # Least digest of the prefixes that start in each window (of equal ones the first).
            width = window - anchor + 1
            view = np.lib.stride_tricks.sliding_window_view(heads, width)
            at = np.concatenate([self.starts[i : i + 65536] + view[self.starts[i : i + 65536]].argmin(axis=1) for i in range(0, len(self.starts), 65536)])
        else:
            at = np.empty(0, dtype=np.int64)
        self.at = at  # where each window's anchor starts
        self.heads = heads[at] if len(at) else np.empty(0, dtype=np.uint64)

    def nodes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two digests of each chosen window; the first also tells how far from the anchor it starts."""
        one, two = B.runs(self.digests, self.window), B.runs(self.digests, self.window, salt=1)
        s = self.starts[chosen]
        return one[s], two[s]


def _by_node(ids: list, x: _Suffixes, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen windows sorted by node and then in reading order: digests, ids (null ones last), the order, and
    which are their node's first in this block."""
    one, two = x.nodes(chosen)
    known = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
    own = known[x.doc[chosen]]
    order = np.lexsort((chosen, own, two, one))
    one, two, own = one[order], two[order], own[order]
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one, two, own, order, lead


def dedup_substrings(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 20, anchor: int = 8, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, repeats`` of every row of ``docs``.

    Words are separated by ``[\\x20\\x09-\\x0D]``. Every word is removed that a window of ``window`` words covers whose sequence also starts
    earlier: in a smaller id, or earlier in the same document; windows are judged on the input. Rows that
    repeat an id follow each other in reading order, null ids come last. ``kept_text`` joins the kept words by one space;
    ``repeats`` has the removed stretches as (first word, end). Null and empty texts have no words. Other columns are
    ignored. An empty table gives no rows.
    """
    if not 0 < anchor < window <= 64:
        raise ValueError("0 < anchor < window <= 64")
    table = B.write_blocks(docs, id_col, text_col, block_bytes)
    shards = B.shards_for(table)
    plain = table.select("block", "ids", "texts")

    def send_heads(row: dict) -> Iterator[dict]:
        x = _Suffixes(row, window, anchor)
        # One indexed suffix per anchor place; each distinct prefix goes out once.
        _, first = np.unique(x.at, return_index=True)
        keys, n = np.unique(x.heads[first], return_counts=True)
        yield from B.Shards(keys, shards).sent(row["block"], (n > 1).astype(np.uint8))

    def branching(keys: np.ndarray, block: np.ndarray, extra: bytes) -> np.ndarray:
        at, n = B.groups(keys)
        return ((n[at] > 1) | (np.frombuffer(extra, dtype=np.uint8) > 0)).astype(np.uint8)

    heads = B.exchange(B.each_block(plain, B.SENT, send_heads), branching)

    def candidates(row: dict, x: _Suffixes) -> np.ndarray:
        keys, at = np.unique(x.heads, return_inverse=True)
        return np.flatnonzero(B.Shards(keys, shards).answered(row["answers"], np.uint8)[at])

    def send_nodes(row: dict) -> Iterator[dict]:
        x = _Suffixes(row, window, anchor)
        chosen = candidates(row, x)
        one, two, own, _, lead = _by_node(row["ids"], x, chosen)
        extra = np.empty(int(lead.sum()), dtype=LEAF)
        extra["two"], extra["id"] = two[lead].astype(np.uint32), own[lead]
        yield from B.Shards(one[lead], shards).sent(row["block"], extra)

    def first_leaf(keys: np.ndarray, block: np.ndarray, extra: bytes) -> np.ndarray:
        """Whether another block has the first leaf of each entry's node."""
        e = np.frombuffer(extra, dtype=LEAF)
        order = np.lexsort((block, e["id"], e["two"], keys))
        same = (keys[order][1:] == keys[order][:-1]) & (e["two"][order][1:] == e["two"][order][:-1])
        later = np.zeros(len(keys), dtype=np.uint8)
        later[order[1:]] = same
        return later

    marked = plain.join(heads, "block", "left")
    leaves = B.exchange(B.each_block(marked, B.SENT, send_nodes), first_leaf)

    def finish(row: dict) -> Iterator[dict]:
        x = _Suffixes(row, window, anchor)
        chosen = candidates(row, x)
        one, _, _, order, lead = _by_node(row["ids"], x, chosen)
        later = B.Shards(one[lead], shards).answered(row["later"], np.uint8).astype(bool)
        gone = ~lead  # leaves that aren't the block's first of their node, and those of a node that starts earlier
        gone[np.flatnonzero(lead)] = later
        begins = x.starts[chosen[order[gone]]]
        n = len(x.digests)
        cover = np.bincount(begins, minlength=n + 1) - np.bincount(begins + window, minlength=n + 1)
        removed = np.cumsum(cover)[:n] > 0
        cols: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept_text", "repeats")}
        begin = 0
        for doc_id, words, end in zip(row["ids"], x.words, x.ends.tolist(), strict=True):
            r = removed[begin:end]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], r.astype(np.int8), [0]))))
            kept = b" ".join([w for w, g in zip(words, r.tolist(), strict=True) if not g] if r.any() else words)
            for n, v in zip(cols, (doc_id, len(words), int(r.sum()), kept.decode("utf-8", "replace"), edges.astype("<i8").tobytes()), strict=True):
                cols[n].append(v)
            begin = end
        yield cols

    told = marked.join(leaves.withColumnRenamed("answers", "later"), "block", "left")
    return B.each_block(told, "doc_id long, n_words long, n_removed long, kept_text string, repeats binary", finish)
