"""Plain Python versions of what SQL can't express."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingles(text: str | None) -> frozenset:
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


def substrings(rows: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            if run in seen:
                gone.update(range(i, i + window))
            seen.add(run)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def unigram(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    tokens = {i: [x.lower() for x in words(t)] + [None] for i, t in rows}
    count = Counter(x for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in t)
    n, v = sum(count.values()), len(count)
    return {
        i: (zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        for i, t in tokens.items()
    }


def ppm_log10(training: list[bytes], text: bytes, order: int) -> float:
    """Escape method D with exclusion, contexts before a text being ends."""
    seen: dict[bytes, Counter] = {}
    for t in training:
        p = b"\n" * order + t
        for i in range(order, len(p)):
            for j in range(order + 1):
                seen.setdefault(p[i - j : i], Counter())[p[i]] += 1
    p, total = b"\n" * order + text, 0.0
    for i in range(order, len(p)):
        excluded: set[int] = set()
        for j in range(order, -1, -1):
            left = {a: n for a, n in seen.get(p[i - j : i], {}).items() if a not in excluded}
            if not left:
                continue
            if p[i] in left:
                total += math.log10((left[p[i]] - 0.5) / sum(left.values()))
                break
            total += math.log10(0.5 * len(left) / sum(left.values()))
            excluded |= set(left)
        else:
            total -= math.log10(256 - len(excluded))
    return total


def tile_lengths(a: list, b: list, least: int) -> list[int]:
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        out.append(n)
