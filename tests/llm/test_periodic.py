"""Periodic runs against brute force, the transforms against direct sums, and edges."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import ntt, periodic, queries as Q


def runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            u = w[s : s + n]
            if n >= max(least, times * q) and not any(u[r:] == u[:-r] for r in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def answers(rows):
    return {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows}


@pytest.mark.parametrize("size", [1, 2, 8, 64, 256])
@pytest.mark.parametrize("columns", [3, 70])
def test_double_correlation(size, columns):
    b = np.random.default_rng(size).integers(0, ntt.PRIME, (size, columns)).astype(np.uint64)
    got = ntt.double_correlation(b) % np.uint64(ntt.PRIME)
    after = np.concatenate([b[:, 1:-1], b[:, 2:]]).astype(object)
    scale = 2 * pow(2, -64, ntt.PRIME)
    for d in range(size):
        assert (got[d] == (scale * (b[:, :-2].astype(object) * after[d : d + size]).sum(axis=0)) % ntt.PRIME).all()


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None, "a " * 30), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 5), (4, "x " * 6), (5, "a\tb\x0ba\x0cb\ra\nb a b")]
    for i in range(6, 300):
        w = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randint(1, rng.choice([3, 9, 40])))]
            w += unit * rng.choice([1, 1, 2, 3, 4, 5, 9]) + unit[: rng.randint(0, len(unit))]
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert answers(Q.op13_periodic(spark, str(tmp_path)).collect()) == {(i, *expected(i, t)) for i, t in rows}


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) <= 1500}
    got = {r.doc_id: r for r in Q.op13_periodic(spark, sf).collect()}
    assert len(got) == len(rows)
    assert answers(got[i] for i in short) == {(i, *expected(i, t)) for i, t in short.items()}


def test_operator_returns_runs_and_text(spark):
    docs = spark.createDataFrame([("k", "s " + "a b c " * 5 + "t"), (None, None)], "name string, body string")
    docs = docs.withColumns({c: F.lit(1) for c in ("doc_id", "text", "runs", "x")})
    got = {r.doc_id: r for r in periodic.periodic_runs(docs, "name", "body").collect()}
    assert [tuple(x) for x in got["k"].runs] == [(1, 15, 3)] and got["k"].kept_text == "s a b c t" and got["k"].n_words == 17
    assert got[None].runs == [] and got[None].kept_text == ""
    assert periodic.periodic_runs(docs.limit(0), "name", "body").collect() == []


def test_very_long_texts():
    n = 1 << 18
    one = periodic.find_runs(np.ones(n, dtype=np.uint64), np.array([n]))
    assert one == [(0, n, 1)]
    unit = np.random.default_rng(1).integers(1, 9999, 30_011).astype(np.uint64)
    x = np.concatenate([np.full(77, 10_001, dtype=np.uint64), np.tile(unit, 5), np.full(1, 10_002, dtype=np.uint64)])
    assert (77, 5 * len(unit), len(unit)) in periodic.find_runs(x, np.array([len(x)]))


def test_runs_end_with_their_text():
    x = np.ones(20, dtype=np.uint64)
    assert sorted(periodic.find_runs(x, np.array([12, 8]))) == [(0, 12, 1), (12, 8, 1)]
