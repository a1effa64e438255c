import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import hashing, knn, resolve


def vectors(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], "id long, vector array<double>")


def brute(m, k, metric="cosine"):
    out = {}
    for q in range(len(m)):
        scored = []
        for s in range(len(m)):
            if s == q:
                continue
            if metric == "cosine":
                n = np.linalg.norm(m[q]) * np.linalg.norm(m[s])
                score = float(m[q] @ m[s] / n) if n else 0.0
            else:
                score = 1 - float(np.linalg.norm(m[q] - m[s]))
            scored.append((-round(score, 9), s))
        out[q] = [(s, -d) for d, s in sorted(scored)[:k]]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    return out


@pytest.fixture(scope="module")
def clustered():
    """Clusters, a third of all rows being copies of one vector, and zero vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 4
    m = centres[rng.integers(0, 8, 240)] + rng.normal(size=(240, 6)) * 0.3
    m[rng.choice(240, 80, replace=False)] = centres[0]
    m[[5, 77, 150]] = 0.0
    return m


@pytest.mark.parametrize("metric", knn.METRICS)
@pytest.mark.parametrize("rows_per_cell", [10**6, 20])
def test_join_is_exact(spark, clustered, metric, rows_per_cell, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 32)
    lib = vectors(spark, clustered)
    index = knn.build_index(lib, 7, metric, rows_per_cell=rows_per_cell)
    assert (len(index.count) > 1) == (rows_per_cell == 20)
    got = as_dict(knn.knn_join(index, lib, 7))
    want = brute(clustered, 7, metric)
    # Copies tie exactly; other scores are far apart.
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-8)


def test_copies_are_folded(spark, clustered):
    index = knn.build_index(vectors(spark, clustered), 4)
    assert index.rows.count() < 240 - 70


def test_far_cells_are_skipped(spark):
    rng = np.random.default_rng(0)
    m = np.concatenate([c + rng.normal(size=(50, 8)) * 0.01 for c in np.eye(8)])
    index = knn.build_index(vectors(spark, m), 3, rows_per_cell=25)
    d = knn._distances(knn._points(m, "cosine", 1), index.pivots)
    arrays = (index.pivots, index.count, index.nearest, index.farthest)
    opened = knn._least_distances(d, arrays) <= 0.1
    assert opened.sum(axis=1).max() < len(index.count)
    compared = []
    got = as_dict(knn.knn_join(index, vectors(spark, m), 3, report=compared))
    assert len(compared) == 3 and sum(compared) < 0.5 * len(m) ** 2
    assert {q: [i for i, _ in v] for q, v in got.items()} == {
        q: [i for i, _ in v] for q, v in brute(m, 3).items()
    }


def test_rounds_meet_no_cell_twice():
    rng = np.random.default_rng(3)
    points, pivots = rng.normal(size=(200, 6)), rng.normal(size=(30, 6))
    count = rng.integers(0, 9, 30)
    arrays = (pivots, count, np.zeros(30), np.full(30, 2.0))
    first, second = np.full(200, 2.5), np.full(200, 2.0)
    masks = [knn._asked_cells(points, arrays, 5, done, len(done) == 2) for done in ([], [first], [first, second])]
    assert (np.sum(masks, axis=0) <= 1).all() and masks[1].sum(axis=1).max() <= knn.NEAR_CELLS
    low = knn._least_distances(knn._distances(points, pivots), arrays)
    assert (np.sum(masks, axis=0).astype(bool) >= (low <= 2.0)).all()


def unit(rng, n, d):
    m = rng.normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1)[:, None]


def test_hashed_search_finds_most(spark):
    rng = np.random.default_rng(5)
    centres = unit(rng, 40, 16)
    m = np.repeat(centres, 25, axis=0) + 0.15 * rng.normal(size=(1000, 16))
    m[7] = 0
    lib = vectors(spark, m)
    index = hashing.build_hash_index(lib, 5, tables=6, probes=4, rows_per_bucket=64)
    assert index.directions.shape[1] == 6
    exact = brute(m, 5)
    got = as_dict(hashing.approximate_knn_join(index, lib, 5))
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in exact[q]}) for q in exact)
    assert hits >= 0.9 * 5 * len(m)
    scores = {(q, i): s for q, v in brute(m, len(m) - 1).items() for i, s in v}
    for q, found in got.items():
        assert len(found) <= 5 and q not in {i for i, _ in found}
        for i, s in found:
            assert s == pytest.approx(scores[q, i], abs=1e-9)
    row = hashing.recall(index, lib, knn.knn_join(knn.build_index(lib, 5), lib, 5), 5).head()
    assert row.n_queries == 1000 and row.wanted == 5000 and row.found >= 4500
    with pytest.raises(ValueError):
        hashing.approximate_knn_join(index, lib, 6)


def test_hashed_search_splits_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = np.concatenate([np.ones((100, 4)) + 0.1 * rng.normal(size=(100, 4)), rng.normal(size=(20, 4))])
    lib = vectors(spark, m)
    index = hashing.build_hash_index(lib, 3, tables=2, probes=1)
    whole = hashing.approximate_knn_join(index, lib, 3).collect()
    monkeypatch.setattr(hashing, "BLOCK_ROWS", 30)
    monkeypatch.setattr(hashing, "CHUNK_ROWS", 20)
    assert sorted(hashing.approximate_knn_join(index, lib, 3).collect()) == sorted(whole) and len(whole) > 300
    plan = hashing.approximate_knn_join(hashing.build_hash_index(lib, 3), lib, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_seed_is_sent_once_per_parcel_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK_ROWS", 100)
    m = np.random.default_rng(8).normal(size=(400, 8))
    lib = vectors(spark, m)
    index = hashing.build_hash_index(lib, 3, tables=3, probes=16, rows_per_bucket=25)
    assert index.parcel_signs == 2 and index.directions.shape[1] == 6
    sent = hashing.asked_parcels(index, lib.select(F.col("id").alias("query_id"), F.col("vector").alias("v"))).collect()
    assert len(sent) <= 400 * 3 * 4 and len({(r.query_id, r.hash_table, r.parcel) for r in sent}) == len(sent)
    assert sum(len(r.codes) for r in sent) == 400 * 3 * 16  # no probe is lost
    codes = hashing._codes(knn._points(m, "cosine", 0), index.directions)[0]
    looked = hashing.probe_codes(*hashing._codes(knn._points(m, "cosine", 1), index.directions), 16)
    unit_m = m / np.linalg.norm(m, axis=1)[:, None]
    got = as_dict(hashing.approximate_knn_join(index, lib, 3))
    for q in range(len(m)):
        met = [i for i in range(len(m)) if i != q and any(codes[i, t] in looked[q, t] for t in range(3))]
        best = sorted(met, key=lambda i: -float(unit_m[q] @ unit_m[i]))[:3]
        assert [i for i, _ in got.get(q, [])] == best


def test_a_seed_is_sent_once_per_parcel_of_cells(spark, monkeypatch):
    m = np.random.default_rng(9).normal(size=(600, 12))
    lib, sent, meet = vectors(spark, m), [], knn._meet
    monkeypatch.setattr(knn, "BLOCK_ROWS", 200)
    monkeypatch.setattr(knn, "_meet", lambda index, probes, *more: sent.append(probes.count()) or meet(index, probes, *more))
    index = knn.build_index(lib, 3, rows_per_cell=10)
    parcels = knn._parcels(index.count)
    assert len(index.count) == 60 and np.bincount(parcels, index.count).max() <= 200 and parcels[-1] <= 6
    assert as_dict(knn.knn_join(index, lib, 3)) == brute(m, 3)
    assert len(sent) == 3 and max(sent) <= 600 * (parcels[-1] + 1)  # vectors without structure ask for nearly every cell


def test_memory_of_a_group_is_bounded(monkeypatch):
    """Distances are made in tiles and seeds' best kept as they come, whatever a chunk and a block hold."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    q, s = rng.normal(size=(70, 4)), np.repeat(rng.normal(size=(30, 4)), 3, axis=0)
    seeds = pa.table({"query_id": pa.array(range(70)), "point": knn._lists(q)})
    block = pa.table({"id": pa.array(range(90)), "point": knn._lists(s)})
    fields = (pa.int64(), pa.int64())
    both = [(np.arange(70), np.arange(90))]
    for metric in knn.METRICS:
        whole = knn._group_top_k(seeds, block, both, 4, metric, True, fields)
        with monkeypatch.context() as small:
            small.setattr(knn, "_AT_ONCE", 95)
            small.setattr(knn, "_RESCORED", 7)
            parts = [(np.arange(70), np.arange(a, 90, 4)) for a in range(4)]
            assert knn._group_top_k(seeds, block, parts, 4, metric, True, fields).equals(whole)
        assert whole.num_rows == 280


def test_probes_change_the_least_sure_signs():
    products = np.array([[[0.1, -0.5, 2.0]]])
    codes = np.array([[0b101]])
    assert hashing.probe_codes(codes, products, 4).tolist() == [[[0b101, 0b100, 0b111, 0b110]]]


def test_fewer_rows_than_asked(spark):
    lib = vectors(spark, np.eye(3))
    got = as_dict(knn.knn_join(knn.build_index(lib, 5), lib, 5))
    assert {q: len(v) for q, v in got.items()} == {0: 2, 1: 2, 2: 2}
    with pytest.raises(ValueError):
        knn.knn_join(knn.build_index(lib, 2), lib, 5)
    one = vectors(spark, np.eye(1))
    assert knn.knn_join(knn.build_index(one, 5), one, 5).count() == 0


@pytest.mark.parametrize("metric", knn.METRICS)
def test_single_equals_join(spark, clustered, metric):
    lib = vectors(spark, clustered)
    want = brute(clustered, 6, metric)
    for q in (0, 5, 100):
        got = knn.similar_to(lib, lib.where(F.col("id") == q), 6, metric=metric).collect()
        assert np.allclose([r.similarity_score for r in got], [s for _, s in want[q]], atol=1e-8)
        assert [r["rank"] for r in got] == list(range(1, 7))
    with pytest.raises(ValueError):
        knn.similar_to(lib, lib.where("id = -1"), 6)


def test_exclusion_and_overfetch(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 5))
    lib, seed = vectors(spark, m), vectors(spark, m[:1])
    order = [i for i, _ in brute(m, 39)[0]]
    gone = spark.createDataFrame([(i,) for i in order[:6]], "id long")
    few = knn.similar_to(lib, seed, 2, gone)  # all six candidates are excluded
    assert few.count() == 0
    full = knn.similar_to(lib, seed, 2, gone, overfetch=None)
    assert [r.id for r in full.collect()] == order[6:8]
    some = knn.similar_to(lib, seed, 2, gone.where(F.col("id") != order[3]))
    assert [r.id for r in some.collect()] == [order[3]]
    near = knn.knn_join(knn.build_index(lib, 6), lib, 6)
    pairs = gone.where(F.col("id") != order[3]).withColumn("query_id", F.lit(0).cast("long"))
    batch = knn.without_excluded(near, pairs, 2).where("query_id = 0").collect()
    assert [(r.id, r["rank"]) for r in batch] == [(order[3], 1)]


def test_plans(spark):
    lib = vectors(spark, np.eye(4))
    plan = knn.similar_to(lib, lib.where("id = 0"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan
    plan = knn.knn_join(knn.build_index(lib, 2), lib, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


CATALOG = ["/m/a/Foo - Bar.mp3", "/m/b/Foo - Bar.mp3", "/m/c/xBar.mp3", "/m/d/Q.flac", "/m/e/50% [x].ogg", "/m/Foo - Z.wav"]
ASKED = {
    "exact": ("/m/b/Foo - Bar.mp3", "/m/b/Foo - Bar.mp3", 1),
    "base name, first in order": ("/else/Foo - Bar.mp3", "/m/a/Foo - Bar.mp3", 2),
    "suffix of a name": ("Bar.mp3", "/m/a/Foo - Bar.mp3", 2),
    "artist": ("Foo - Unknown.mp3", "/m/Foo - Z.wav", 3),
    "stem": ("Q.mp3", "/m/d/Q.flac", 4),
    "short stem": ("Z.xyz", "/m/Foo - Z.wav", 4),
    "literal": ("50% [x].mp3", "/m/e/50% [x].ogg", 4),
    "case": ("q.mp3", None, None),
    "empty": ("", None, None),
    "empty base": ("/m/a/", None, None),
    "empty artist": (" - x.mp3", None, None),
    "none": ("nothing here.mp3", None, None),
}


@pytest.mark.parametrize("automaton", [resolve.AUTOMATON_BYTES, -1])
def test_resolve(spark, automaton):
    catalog = spark.createDataFrame([(p,) for p in reversed(CATALOG)], "file_path string")
    asked = spark.createDataFrame([(k, v[0]) for k, v in ASKED.items()], "query_id string, song_path string")
    for hot in (10**6, 3):
        got = {r.query_id: (r.file_path, r.tier) for r in resolve.resolve_songs(asked, catalog, hot_rows=hot, automaton_bytes=automaton).collect()}
        assert got == {k: v[1:] for k, v in ASKED.items()}
    for text, path, tier in ASKED.values():
        row = resolve.resolve_one(catalog, text).head()
        assert (row and (row.file_path, row.tier)) == (path and (path, tier))


@pytest.mark.parametrize("automaton", [resolve.AUTOMATON_BYTES, -1])
def test_resolve_many_alike(spark, automaton):
    """A third of all queries ask for one song, and one gram is in every path."""
    catalog = spark.range(60).select(F.format_string("/lib/common name %03d.mp3", "id").alias("file_path"))
    asked = spark.range(90).select(
        F.col("id").alias("query_id"),
        F.when(F.col("id") < 30, "/x/name 007.mp3").otherwise(F.format_string("%03d.ogg", F.col("id"))).alias("song_path"),
    )
    got = {r.query_id: r.file_path for r in resolve.resolve_songs(asked, catalog, hot_rows=10, automaton_bytes=automaton).collect()}
    want = {i: "/lib/common name 007.mp3" if i < 30 else f"/lib/common name {i:03d}.mp3" if i < 60 else None for i in range(90)}
    assert got == want
    plan = resolve.resolve_songs(asked, catalog, automaton_bytes=automaton)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_resolve_in_table_order(spark):
    rows = [("/a/x.mp3", 2), ("/b/x.mp3", 1), (None, 0), ("/c/é日.mp3", 9), ("/d/é日.mp3", None)]
    catalog = spark.createDataFrame(rows, "file_path string, ord int")
    asked = spark.createDataFrame([(1, "x.mp3"), (2, "é日.ogg"), (3, None)], "query_id int, song_path string")
    for automaton in (resolve.AUTOMATON_BYTES, -1):
        got = {r.query_id: r.file_path for r in resolve.resolve_songs(asked, catalog, order="ord", automaton_bytes=automaton).collect()}
        assert got == {1: "/b/x.mp3", 2: "/d/é日.mp3", 3: None}
    assert resolve.resolve_one(catalog, "x.mp3", "ord").head().file_path == "/b/x.mp3"


def test_resolve_ways_agree(spark):
    """Names of all lengths, with letters of several bytes: the grams find what the automaton finds."""
    draw = np.random.default_rng(5)
    text = lambda most: "".join(draw.choice(list("aabc é日/.-"), draw.integers(0, most)))
    catalog = spark.createDataFrame([(text(40),) for _ in range(400)] + [(None,), ("",)], "file_path string")
    asked = spark.createDataFrame([(i, text(14)) for i in range(400)] + [(400, None)], "query_id int, song_path string")
    one, two = (
        sorted(map(tuple, resolve.resolve_songs(asked, catalog, automaton_bytes=b).collect()), key=str) for b in (resolve.AUTOMATON_BYTES, -1)
    )
    assert one == two and len({r[-1] for r in one}) >= 3
    assert resolve.resolve_songs(asked, catalog.limit(0), automaton_bytes=-1).where("file_path is not null").isEmpty()


def test_resolve_sends_few_grams(spark, monkeypatch):
    """A path sends the grams that names are looked up by, not all it has."""
    sent, plain = [], resolve.hot_join

    def join(left, right, key, *rest):
        if "gram" in left.columns:
            sent.append(left.count())
        return plain(left, right, key, *rest)

    monkeypatch.setattr(resolve, "hot_join", join)
    name = "%s/a common name - a common type %05d.mp3"
    catalog = spark.range(2000).select(F.format_string(name, F.lit("/lib"), "id").alias("file_path"))
    asked = spark.range(2000).select(F.col("id").alias("query_id"), F.format_string(name, F.lit("/old"), F.col("id") * 2).alias("song_path"))
    got = resolve.resolve_songs(asked, catalog, automaton_bytes=-1)
    assert {r.tier: r["count"] for r in got.groupBy("tier").count().collect()} == {2: 1000, 3: 1000}
    assert sent and sent[0] <= 5 * 2000


def test_rows_are_shuffled_once_a_chunk(spark, monkeypatch):
    """However many blocks and hash tables a library has, its rows go past each chunk of seeds once, and a seed is sent once."""
    m = np.random.default_rng(12).normal(size=(500, 6))
    lib, sent, plain = vectors(spark, m), [], knn.pass_chunks

    def counted(seeds, library, dims, chunks, *more, **options):
        sent.append((seeds.count(), library.count() / chunks, chunks))
        return plain(seeds, library, dims, chunks, *more, **options)

    for module in (knn, hashing):
        monkeypatch.setattr(module, "BLOCK_ROWS", 16)
        monkeypatch.setattr(module, "CHUNK_ROWS", 100)
        monkeypatch.setattr(module, "pass_chunks", counted)
    assert as_dict(knn.knn_join(knn.build_index(lib, 3), lib, 3)) == brute(m, 3)
    index = hashing.build_hash_index(lib, 3, tables=4, probes=8, rows_per_bucket=25)
    found = as_dict(hashing.approximate_knn_join(index, lib, 3))
    monkeypatch.setattr(hashing, "ALL_ASKED", 0)
    assert as_dict(hashing.approximate_knn_join(index, lib, 3)) == found and len(found) == 500
    assert len(sent) == 3 and all(seeds == 500 and rows <= 500 and chunks == 8 for seeds, rows, chunks in sent)


def test_floor_and_order_of_blocks_change_nothing():
    """A seed's best are the same when blocks come one by one, a pair comes twice, or the floor is its worst score."""
    import pyarrow as pa

    rng = np.random.default_rng(13)
    q, s = unit(rng, 40, 9), np.repeat(unit(rng, 300, 9), 2, axis=0)
    ids, fields = np.arange(100, 700), (pa.int64(), pa.int64())
    for metric in knn.METRICS:
        one = knn._Best(np.arange(40), q, 6, metric, True)
        one.meet(ids, s, [(np.arange(40), np.arange(600))])
        want = one.table(fields)
        worst = want.group_by("query_id").aggregate([("score", "min")]).sort_by("query_id").column("score_min").to_numpy()
        many = knn._Best(np.arange(40), q, 6, metric, True, worst, repeats=True)
        for a in (400, 0, 200, 400):
            many.meet(ids[a : a + 200], s[a : a + 200], [(np.arange(40), np.arange(200))])
        assert want.num_rows == 240 and many.table(fields).equals(want)


def test_vectors_travel_packed():
    import pyarrow as pa

    rng = np.random.default_rng(14)
    double = rng.normal(size=(30, 5))
    single = double.astype(np.float32).astype(np.float64)
    assert len(knn._packed(single)[0].as_py()) == 20 and len(knn._packed(double)[0].as_py()) == 40
    both = pa.chunked_array([knn._packed(single), knn._packed(double), knn._packed(double[:0])])
    assert (knn._unpacked(both, 5) == np.concatenate([single, double])).all()
    odd = np.array([[np.nan, 1.0, 1e300, -np.inf, 0.1]])
    assert np.array_equal(knn._unpacked(knn._packed(odd), 5), odd, equal_nan=True)


def test_more_buckets_get_more_probes(spark):
    """Among random vectors, 64 of 2^12 buckets find less than nine tenths of the neighbours."""
    lib = vectors(spark, unit(np.random.default_rng(15), 256, 4))
    assert [hashing.build_hash_index(lib, 3, rows_per_bucket=r).probes for r in (512, 64, 1, 0.25)] == [1, 8, 64, 161]
