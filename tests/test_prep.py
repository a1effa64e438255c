import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import knn, prep
from trackspark.plans.recommend import Recommender
from trackspark.sources import models


def table(spark, m, names):
    return spark.createDataFrame([tuple(float(x) for x in r) for r in m], ", ".join(f"`{n}` double" for n in names))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    m = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    return np.column_stack([m, np.full(60, 0.1)])


COLS = ["mfcc_1_mean", "CHROMA_1_mean", "tempo", "spectral_centroid_mean", "rms_mean", "constant"]
W = np.array([1.2, 0.8, 1.0, 1.0, 1.0, 1.0])


def matrix(df, column="vector"):
    return np.array([r[0] for r in df.select(column).collect()])


def scaled(m):
    s = m.std(axis=0)
    s[-1] = 1
    z = (m - m.mean(axis=0)) / s
    z[:, -1] = 0
    return z


def test_population_scaling_and_weights(spark, data):
    df = table(spark, data, COLS)
    space = prep.fit_feature_space(df, n_components=None)
    assert space.columns == tuple(COLS) and space.weights == tuple(W)
    assert np.allclose(matrix(space.transform(df)), scaled(data) * W, atol=1e-12)
    stats = {r.feature: (r.mean, r["std"]) for r in prep.column_stats(df, COLS).collect()}
    assert stats["tempo"] == pytest.approx((data[:, 2].mean(), data[:, 2].std()))
    own = prep.fit_feature_space(df, weights={"mfcc": 2.0}, n_components=None)
    assert own.weights == (2.0, 0.8, 1.0, 1.0, 1.0, 1.0)


def test_weight_groups():
    names = ["mfcc_tempo", "chroma_tempo", "my_TEMPO", "bandwidth", "Centroid", "other"]
    w = {"mfcc": 1, "chroma": 2, "tempo": 3, "spectral": 4, "default": 5}
    assert prep.column_weights(names, w) == [1, 2, 3, 4, 4, 5]


def test_pca_cut(spark, data):
    df = table(spark, data, COLS)
    z = scaled(data) * W
    shares = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    shares = shares / shares.sum()
    want = int(np.searchsorted(np.cumsum(shares), 0.95, side="right")) + 1
    space = prep.fit_feature_space(df)
    assert space.n_components == want and space.explained > 0.95
    assert sum(shares[: want - 1]) <= 0.95
    got = matrix(space.transform(df))
    assert got.shape == (60, want)
    _, vec = np.linalg.eigh(np.cov(z.T))
    assert np.allclose(np.abs(got), np.abs(z @ vec[:, ::-1][:, :want]), atol=1e-8)
    fixed = prep.fit_feature_space(df, n_components=3)
    assert matrix(fixed.transform(df)).shape == (60, 3)


def test_all_constant(spark):
    df = table(spark, np.ones((4, 2)), ["a", "b"])
    space = prep.fit_feature_space(df)
    assert matrix(space.transform(df)).tolist() == [[0.0, 0.0]] * 4
    single = table(spark, np.ones((1, 2)), ["a", "b"])
    assert matrix(prep.fit_feature_space(single).transform(single)).tolist() == [[0.0, 0.0]]


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (5.0, float("nan"))], "a double, b double")
    with pytest.raises(ValueError, match="a, b"):
        prep.fit_feature_space(df)
    space = prep.fit_feature_space(df, n_components=None, fill_missing=0.0)
    assert np.allclose(matrix(space.transform(df)), scaled3([[1, 2], [0, 3], [5, 0]]))
    with pytest.raises(ValueError):
        prep.fit_feature_space(df.where("false"))


def scaled3(m):
    m = np.array(m, float)
    return (m - m.mean(axis=0)) / m.std(axis=0)


def test_columns(spark):
    df = spark.createDataFrame(
        [(" /a  ", 1, True, 2.0, "x", 3.0)], "FILE_PATH string, n int, flag boolean, f double, t string, file_size_mb double"
    )
    fixed = prep.clean_key(prep.canonical_columns(df))
    assert fixed.columns[0] == "file_path" and fixed.head().file_path == "/a"
    assert prep.feature_columns(fixed) == ["n", "flag", "f"]
    with pytest.raises(ValueError, match="file_path"):
        prep.canonical_columns(df.drop("FILE_PATH"))
    bad = prep.clean_key(spark.createDataFrame([(None,)], "file_path string"))
    with pytest.raises(Exception, match="null file_path"):
        bad.collect()
    flags = table(spark, [[1, 0], [2, 1], [4, 1]], ["n", "f"]).withColumn("f", F.col("f").cast("boolean"))
    assert np.allclose(matrix(prep.fit_feature_space(flags, n_components=None).transform(flags))[:, 1], scaled3([[0], [1], [1]])[:, 0])


def test_save_and_load(spark, data, tmp_path):
    df = table(spark, data, COLS)
    space = prep.fit_feature_space(df)
    models.save_space(space, str(tmp_path / "m"), spark)
    again = models.load_space(str(tmp_path / "m"), spark)
    assert (again.columns, again.weights, again.n_components) == (space.columns, space.weights, space.n_components)
    assert np.allclose(matrix(again.transform(df)), matrix(space.transform(df)))
    plain = prep.fit_feature_space(df, n_components=None)
    models.save_space(plain, str(tmp_path / "m"), spark)
    assert models.load_space(str(tmp_path / "m"), spark).n_components is None
    with pytest.raises(FileNotFoundError):
        models.load_space(str(tmp_path / "none"), spark)


@pytest.fixture(scope="module")
def songs(spark, data):
    rows = [(f"/lib/Artist {i % 7} - Song {i:02d}.mp3", float(30 + i), *map(float, r)) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "File_Path string, duration double, " + ", ".join(f"`{c}` double" for c in COLS)).cache()


def test_recommender(spark, songs, data, tmp_path):
    rec = Recommender(songs)
    with pytest.raises(ValueError):
        rec.find_similar("x")
    rec.fit(n_neighbors=4, n_components=None)
    m = np.column_stack([np.arange(30.0, 90.0), data])
    z = scaled(m) * np.concatenate([[1.0], W])
    u = z / np.linalg.norm(z, axis=1)[:, None]
    order = np.argsort(-(u @ u[8]), kind="stable")
    order = [i for i in order if i != 8]
    path = "/lib/Artist {} - Song {:02d}.mp3"
    top = rec.find_similar("/elsewhere/Artist 1 - Song 08.mp3").collect()
    assert [r.file_path for r in top] == [path.format(i % 7, i) for i in order[:4]]
    assert [r.similarity_score for r in top] == pytest.approx([float(u[i] @ u[8]) for i in order[:4]])
    fewer = rec.find_similar("Song 08", 3, exclude=[top[0].file_path]).collect()
    assert [r.file_path for r in fewer] == [path.format(i % 7, i) for i in order[1:4]]
    with pytest.raises(ValueError, match="not found"):
        rec.find_similar("nobody")

    asked = spark.createDataFrame([(1, "Song 08.mp3"), (2, "Song 08.mp3"), (3, "nobody")], "query_id int, song_path string")
    gone = spark.createDataFrame([(2, top[0].file_path)], "query_id int, file_path string")
    many = rec.find_similar_many(asked, 3, gone).orderBy("query_id", "rank").collect()
    assert [r.file_path for r in many if r.query_id == 1] == [r.file_path for r in top[:3]]
    assert [r.file_path for r in many if r.query_id == 2] == [r.file_path for r in fewer]
    assert {r.query_id for r in many} == {1, 2}

    shown = rec.report("Song 08.mp3", rec.find_similar("Song 08.mp3")).collect()
    assert [r["rank"] for r in shown] == [0, 1, 2, 3, 4]
    assert (shown[0].title, shown[0].artist, shown[0].duration, shown[0].similarity, shown[0].band) == (
        "Song 08", "Unknown Artist", "0:38", "100%", "query",
    )
    assert shown[1].similarity == f"{top[0].similarity_score * 100:.0f}%"
    assert shown[1].artist == f"Artist {order[0] % 7}"

    for metric, n in (("cosine", 5), ("euclidean", 3)):
        rec.fit(n, metric)
        rec.save_model(str(tmp_path / "model"))
        again = Recommender(songs).load_model(str(tmp_path / "model"))
        assert (again.metric, again.n_neighbors) == (metric, n)
        a, b = (x.find_similar("Song 08.mp3").collect() for x in (rec, again))
        assert [(r.file_path, r.similarity_score) for r in a] == [(r.file_path, r.similarity_score) for r in b] and len(a) == n


def test_one_scan_fits_everything(spark, data):
    df = table(spark, np.tile(data, (50, 1)) + np.arange(3000)[:, None] % 7, COLS).repartition(7)
    m = np.array([tuple(r) for r in df.collect()])
    found = prep.co_moments(df, COLS)
    assert found.n == 3000 and found.missing == (0,) * 6
    assert np.allclose(found.mean, m.mean(axis=0)) and np.allclose(found.products, (m - m.mean(axis=0)).T @ (m - m.mean(axis=0)))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    prep.fit_feature_space(df)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 3  # a job each for the dealing out above, the scan with its shuffle, and the result


def test_weights_and_defaults(spark):
    df = table(spark, [[1, 5], [2, 3], [4, 4]], ["mfcc_1_mean", "anything"])
    plain = prep.fit_feature_space(df, n_components=None)
    assert plain.weights == (1.2, 1.0)
    own = prep.fit_feature_space(df, n_components=None, weights={"default": 3.0})
    assert own.weights == (1.2, 3.0)
    assert np.allclose(matrix(own.transform(df)), scaled3([[1, 5], [2, 3], [4, 4]]) * [1.2, 3.0])


def test_booleans_are_filled(spark):
    df = spark.createDataFrame([(True, 1.0), (None, 2.0), (False, None)], "flag boolean, x double")
    space = prep.fit_feature_space(df, n_components=None, fill_missing=0.0)
    assert np.allclose(matrix(space.transform(df)), scaled3([[1, 1], [0, 2], [0, 0]]))


def test_full_rotation_keeps_neighbours(spark, data):
    df = table(spark, data, COLS).withColumn("id", F.monotonically_increasing_id())
    plain = prep.fit_feature_space(df, COLS, n_components=None).transform(df)
    turned = prep.fit_feature_space(df, COLS, n_components=6).transform(df)
    a, b = (
        knn.knn_join(knn.build_index(x, 5), x, 5).select("query_id", "rank", "id").orderBy("query_id", "rank").collect()
        for x in (plain, turned)
    )
    assert a == b
