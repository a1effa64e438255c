import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark import schema as S
from trackspark.operators import signals

SR = 8000
GRID = signals.Grid(256, 64)
MEL = signals.MelSettings(frame=512, hop=128, n_mels=24, n_mfcc=6, fmax=4000.0)


def tone(n, f):
    return 0.5 * np.sin(2 * np.pi * f * np.arange(n) / SR)


def rows(spark, named):
    return spark.createDataFrame(
        [(k, SR, [float(x) for x in np.float32(v)]) for k, v in named.items()], "track_id string, sr int, samples array<float>"
    )


@pytest.fixture(scope="module")
def tracks():
    rng = np.random.default_rng(7)
    return {
        "tone": tone(5000, 1000.0),
        "noise": rng.uniform(-1, 1, 3333),
        "fade": np.concatenate([tone(2048, 500.0), np.zeros(2048), 1e-4 * rng.normal(size=1000)]),
        "silence": np.zeros(1024),
        "constant": np.full(2000, -0.25),
        "flip": np.tile([1.0, -1.0], 800),
        "short": np.array([0.1, -0.2, 0.3]),
    }


def centred(y, frame, hop, mode):
    p = np.pad(np.float32(y).astype(float), frame // 2, mode=mode)
    return np.stack([p[i * hop : i * hop + frame] for i in range(1 + len(y) // hop)])


def expected(y):
    """Straight from the definitions, frame by frame."""
    zeros, edge = centred(y, 256, 64, "constant"), centred(y, 256, 64, "edge")
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    freq = np.arange(129) * SR / 256
    out = {m: [] for m in S.FRAME_MEASURES}
    for z, e in zip(zeros, edge):
        mag = np.abs(np.fft.rfft(z * win))
        share = mag / mag.sum() if mag.sum() > 1e-37 else mag
        c = (freq * share).sum()
        out["spectral_centroid"].append(c)
        out["spectral_bandwidth"].append(np.sqrt((share * (freq - c) ** 2).sum()))
        sign = np.where(np.abs(e) <= 1e-10, 0, e) < 0
        out["zero_crossing_rate"].append(np.mean(np.concatenate([[False], sign[1:] != sign[:-1]])))
        out["rms"].append(np.sqrt(np.mean(z**2)))
    return {m: (np.mean(v), np.std(v)) for m, v in out.items()}


def expected_mfcc(y):
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(27.5), mel(4000.0), 26) / 2595) - 1)
    freq = np.arange(257) * SR / 512
    bank = np.zeros((24, 257))
    for b in range(24):
        lo, mid, hi = hz[b : b + 3]
        for j, f in enumerate(freq):
            bank[b, j] = max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 512)
    power = np.abs(np.fft.rfft(centred(y, 512, 128, "constant") * win, axis=1)) ** 2
    db = 10 * np.log10(np.maximum(power @ bank.T, 1e-10))
    db = np.maximum(db, db.max() - 80)
    dct = np.array([[np.cos(np.pi * k * (2 * i + 1) / 48) * np.sqrt((1 if k == 0 else 2) / 24) for i in range(24)] for k in range(6)])
    c = db @ dct.T
    return c.mean(axis=0), c.std(axis=0)


@pytest.mark.parametrize("chunk", [256, 1024, 1 << 20])
def test_measures(spark, tracks, chunk):
    chunks = signals.chunk_signals(rows(spark, tracks), pad=128, chunk=chunk)
    stats = signals.track_statistics(signals.frame_measures(chunks, GRID, chunk), S.FRAME_MEASURES)
    got = {r.track_id: r for r in stats.collect()}
    assert set(got) == set(tracks)
    for name, y in tracks.items():
        for m, (mean, std) in expected(y).items():
            assert got[name][f"{m}_mean"] == pytest.approx(mean, rel=1e-9, abs=1e-9), (name, m)
            assert got[name][f"{m}_std"] == pytest.approx(std, rel=1e-6, abs=1e-6), (name, m)


@pytest.mark.parametrize("chunk,hot", [(512, 10**6), (1 << 20, 10**6), (512, 8)])
def test_mfcc(spark, tracks, chunk, hot):
    chunks = signals.chunk_signals(rows(spark, tracks), pad=256, chunk=chunk)
    names = [f"mfcc_{i}" for i in range(1, 7)]
    stats = signals.track_statistics(signals.mfcc_frames(chunks, MEL, chunk, hot_rows=hot), names)
    got = {r.track_id: r for r in stats.collect()}
    for name, y in tracks.items():
        mean, std = expected_mfcc(y)
        assert np.allclose([got[name][f"{n}_mean"] for n in names], mean, atol=1e-7), name
        assert np.allclose([got[name][f"{n}_std"] for n in names], std, atol=1e-6), name


def test_physical_sense(spark, tracks):
    chunks = signals.chunk_signals(rows(spark, tracks), pad=128)
    inner = signals.frame_measures(chunks, GRID).where("frame_no between 4 and 20")
    got = {r.track_id: r for r in signals.track_statistics(inner, S.FRAME_MEASURES).collect()}
    assert got["tone"].spectral_centroid_mean == pytest.approx(1000, abs=5)
    assert got["constant"].rms_mean == pytest.approx(0.25)
    assert got["constant"].zero_crossing_rate_mean == 0
    assert got["flip"].zero_crossing_rate_mean == pytest.approx(255 / 256)
    assert (got["silence"].spectral_centroid_mean, got["silence"].spectral_bandwidth_mean) == (0, 0)


def test_feature_row(spark, tracks):
    sig = rows(spark, {k: np.tile(v, 40) for k, v in tracks.items() if k in ("tone", "noise")}).withColumn("sr", F.lit(44100))
    out = signals.track_features(signals.chunk_signals(sig))
    assert out.columns == ["track_id", *S.FEATURE_COLUMNS]
    assert len(S.FEATURE_COLUMNS) == 77 and len(S.FEATURE_SCHEMA) == 81
    r = {x.track_id: x for x in out.collect()}["tone"]
    assert r.duration == pytest.approx(200000 / 44100)
    assert (r.tempo, r.chroma_12_std, r.drone_likelihood) == (120.0, 0.0, 0.0)
    assert all(x is not None for x in r)


@pytest.mark.parametrize("mel", [None, MEL])
def test_a_row_per_chunk_leaves_the_tasks(spark, tracks, mel):
    chunks = signals.chunk_signals(rows(spark, tracks), pad=256, chunk=512)
    meter = signals.Meter(GRID, mel, 512, S.FRAME_MEASURES)
    pieces = signals.chunk_moments(chunks, meter, "track_id")
    assert pieces.count() == chunks.count()
    frames = pieces.groupBy("track_id").agg(F.sum("measures_n").alias("a"), F.sum("mfcc_n").alias("b")).collect()
    assert {r.track_id: r.a for r in frames} == {k: 1 + len(v) // 64 for k, v in tracks.items()}
    assert {r.track_id: r.b for r in frames} == {k: 1 + len(v) // 128 if mel else 0 for k, v in tracks.items()}


@pytest.mark.parametrize("chunk", [512, 1 << 20])
def test_moments_equal_definitions(spark, tracks, chunk):
    chunks = signals.chunk_signals(rows(spark, tracks), pad=256, chunk=chunk)
    got = {r.track_id: r for r in signals.track_moments(chunks, S.FRAME_MEASURES, GRID, MEL, chunk).collect()}
    assert set(got) == set(tracks)
    for name, y in tracks.items():
        for m, (mean, std) in expected(y).items():
            assert got[name][f"{m}_mean"] == pytest.approx(mean, rel=1e-9, abs=1e-9), (name, m)
            assert got[name][f"{m}_std"] == pytest.approx(std, rel=1e-6, abs=1e-6), (name, m)
        mean, std = expected_mfcc(y)
        assert np.allclose([got[name][f"mfcc_{i}_mean"] for i in range(1, 7)], mean, atol=1e-7), name
        assert np.allclose([got[name][f"mfcc_{i}_std"] for i in range(1, 7)], std, atol=1e-6), name
