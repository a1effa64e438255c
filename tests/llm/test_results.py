"""Registered queries and operators against brute force, exact round trips and held-out accuracy."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import duck
from trackspark.llm import jaccard, packing, ppm, queries as Q, tiling, urls

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def _multiset(values):
    return sorted((tuple(v) for v in values), key=repr)


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_sql(spark, name):
    df = getattr(Q, name)(spark, SF)
    cols = sorted(df.columns)
    want = duck(SF).sql(f"select {', '.join(cols)} from ({Q.ORACLE[name]})").fetchall()
    assert _multiset(df.select(*cols).collect()) == _multiset(want)


def test_near_duplicates(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op10_jaccard(spark, SF).collect()}
    assert got == brute.near_duplicates(rows)


@pytest.mark.parametrize("block_bytes", [2_000, 1 << 20])
def test_near_duplicates_of_shared_passages(spark, block_bytes):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage, base = [word() for _ in range(40)], [word() for _ in range(60)]
    rows = []
    for i in range(120):
        if i % 3 == 0:
            w = passage + [word() for _ in range(rnd.randrange(4, 40))]
        elif i % 3 == 1:
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(60)] = word()
        else:
            w = [word() for _ in range(rnd.randrange(0, 9))]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, block_bytes=block_bytes).collect()}
    assert got == brute.near_duplicates(rows)


def test_substrings(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op3_substrings(spark, SF).collect()}
    assert got == brute.substrings(rows)


def test_ppm(spark, rows):
    want = brute.unigram(rows)
    got = Q.op5_ppm(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
        assert r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) < 0


@pytest.mark.parametrize("order", [0, 2, 6])
def test_trie(order):
    rnd = random.Random(1)
    texts = [ppm.coded([bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 12))]) for _ in range(40)]
    learnt, told = texts[:30], [*texts[30:], b"xyz abc\n"]
    keys, counts = ppm.all_orders(ppm.grams(learnt, order)[0], order)
    trie = ppm.unpacked(ppm.packed(keys, counts.astype(float)), order)
    code, starts = ppm.grams(told, order)
    assert np.add.reduceat(trie.log10(code), starts) == pytest.approx([brute.ppm_log10(learnt, t, order) for t in told])


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_ppm_keeps_every_ngram(spark, block_bytes):
    """The sharded model scores as one trie of all n-grams does, however many these are; there is no bound on nodes."""
    rnd = random.Random(4)
    rows = [(i, " ".join("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 20)))) for i in range(60)]
    rows += [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: ppm.coded((t or "").encode().split()) for i, t in rows}
    learnt = [t for i, t in texts.items() if ppm.crc_remainder(i, 5) != 1]
    for order, least in ((6, 1), (6, 2), (4, 3), (1, 1)):
        keys, counts = ppm.all_orders(ppm.grams(learnt, order)[0], order)
        keep = counts >= least
        trie = ppm.Trie(keys[keep], counts[keep].astype(float), order)
        got = {r.doc_id: r.score for r in ppm.score_documents(docs, order=order, min_count=least, block_bytes=block_bytes).collect()}
        for i, t in texts.items():
            assert got[i] == pytest.approx(trie.log10(ppm.grams([t], order)[0]).sum(), rel=1e-10)
    assert "max_nodes" not in ppm.score_documents.__code__.co_varnames


def test_ppm_messages():
    """N-grams are counted by one sort, and code lengths, of which few differ, travel as a list and places in it."""
    rnd = random.Random(7)
    texts = [ppm.coded([bytes(rnd.choice(b"abcde") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 30))]) for _ in range(300)]
    learnt = [rnd.random() < 0.7 for _ in texts]
    code, counts = ppm.counted(texts, learnt, 6)
    assert np.array_equal(code, np.unique(ppm.grams(texts, 6)[0]))
    u, n = np.unique(ppm.grams([t for t, own in zip(texts, learnt) if own], 6)[0], return_counts=True)
    assert np.array_equal(code[counts > 0], u) and np.array_equal(counts[counts > 0], n)
    assert [len(x) for x in ppm.counted([], [], 6)] == [0, 0]
    for kinds, size in ((1, 0), (1, 9), (200, 5000), (70_000, 200_000)):
        x = -np.random.default_rng(kinds).random(kinds)[np.random.default_rng(1).integers(0, kinds, size)]
        assert np.array_equal(ppm.unlisted(ppm.listed(x), size), x)
    few = -np.random.default_rng(1).random(500)[np.random.default_rng(2).integers(0, 500, 20_000)]
    assert len(ppm.listed(few)) < len(ppm.squeezed(few)) / 2


def test_tiles():
    rnd = random.Random(2)
    for _ in range(40):
        a, b = ([rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 30))] for _ in range(2))
        found = tiling.tile(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 3)
        assert sorted((n for *_, n in found), reverse=True)[:1] == brute.tile_lengths(a, b, 3)[:1]
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
        assert len({x for i, _, n in found for x in range(i, i + n)}) == sum(n for *_, n in found)


def test_reordered_passages(spark):
    rnd = random.Random(3)
    item = [f"t{i}" for i in range(40)]
    filler = [f"f{rnd.randrange(900)}" for _ in range(200)]
    texts = {
        1: filler[:50] + item + filler[50:],
        2: item[20:] + filler[:30] + item[:20],
        3: filler,
        4: filler[:20] + item[:15] + filler[20:],
    }
    docs = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "short one")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.covered_words, r.tiles) for r in tiling.contaminated(docs, bench, items_at_once=1).collect()}
    assert got == {1: (9, 40, 1), 2: (9, 40, 2)}


def test_packing(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = Q.op9_packing(spark, SF).toPandas()
    plain = tokenizers.Tokenizer.from_file(Q.tokenizer_path())
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    assert set(pieces.doc_id) == set(ids)
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        assert list(g.start) == [0, *g.length.cumsum()[:-1]]
        assert g.length.sum() == len(ids[i]) == g.doc_tokens.iloc[0]
        for r in g.itertuples():
            assert zlib.crc32(np.array(ids[i][r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]]
        total = g.length.sum()
        assert total <= 1024 and g.sequence_length.eq(total).all()
    assert sorted(pieces.sequence_id.unique()) == list(range(pieces.sequence_id.nunique()))


def test_encoder():
    pytest.importorskip("tokenizers")
    e = packing.Encoder(Q.tokenizer_path())
    texts = ["", " ", "a", " a b", "a  b", "x \n y", "don't stop 'tis 's", "<|endoftext|> a", "é à. ñ, Ωmega", "tab\t x\n\ny  ", "123 a1b. x.,! ... !"]
    texts += ["ª º ǅ 中文 字.", "é á. \u0301x", "mañana's y'all ', .", "end.\nNext one", "one\ntwo."]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want == e.encode(texts)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    r = Q.op8_language(spark, MID).join(docs, "doc_id").where("held_out and lang is not null")
    share = r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.9


@pytest.mark.parametrize("name, label", [("op1_quality", "quality"), ("op4_toxicity", "toxic")])
def test_classifier_held_out(spark, name, label):
    labels = spark.read.parquet(f"{MID}/labels.parquet").select("doc_id", label)
    got = getattr(Q, name)(spark, MID)
    n, wrong = got.agg(F.count("*"), F.sum(((F.col("predicted") == 1) != (F.col("score") >= 0.7)).cast("int"))).first()
    assert n == 1000 and wrong == 0
    d = got.join(labels, "doc_id").where(f"held_out and {label} is not null").toPandas()
    y, rank = d[label].astype(int), d.score.rank()
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    auc = (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)
    assert auc > 0.75 and d.score.between(0, 1).all()


def test_url_borders(spark):
    rules = urls.rules_frame(spark, Q.URL_RULES)
    told = [
        (1, "http://Example.ORG/es/x?y"), (2, "http://badexample.org/es/"), (3, "http://a.b.example.org/en/12#z"), (4, None),
        (5, "no scheme"), (6, "x://com/fr/"), (7, "x://a.com/de/?"), (8, "x://net/"), (9, "x://"), (9, "x://"),
    ]
    got = [(r.page_id, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(told, "page_id long, url string"), rules).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "example.org/es/", "block"), (2, "org/", "allow"), (3, "example.org/en/1", "block"), (4, None, "allow"), (5, None, "allow"),
        (6, "com/fr/", "allow"), (7, "com/de/", "block"), (8, None, "allow"), (9, None, "allow"), (9, None, "allow"),
    ], key=repr)


def test_pipeline(spark, rows):
    got = corpus_pipeline.run(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_duplicates", "decontamination", "packing"]
    kept = {i: t for i, t in rows if any(c.isalpha() for c in t or "")}
    best: dict[str, tuple] = {}
    for i, t in kept.items():
        key = b"".join(t.encode().split()).decode()
        best[key] = min(best.get(key, (0, i)), (-len(t), i))
    left = [(i, kept[i]) for _, i in best.values()]
    component = brute.near_duplicates(left)
    left = {i for i, _ in left if component[i][1] == i}
    gone = {r.doc_id for r in Q.op7_tiling(spark, SF).collect()}
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == left - gone
