"""Ranged reading, encodings, resampling, progress of a batch run, and tables that are added to."""

import json
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_sources import SR, write_wav
from trackspark import schema as S
from trackspark.operators import signals
from trackspark.operators.resample import Resampler
from trackspark.plans import extract
from trackspark.sources import catalog, features, pcm, ranges
from trackspark.streaming import ingest

CHUNK = 1 << 15
STATS = [c for c in S.FEATURE_COLUMNS if c not in S.PLACEHOLDERS]


def riff(y, width, floating=False, rate=SR, channels=1, extensible=False, tag=b"RIFF", before=b""):
    """Bytes of a WAV file of float samples in [-1, 1)."""
    y = np.asarray(y, dtype=np.float64)
    if floating:
        data = y.astype(f"<f{width}").tobytes()
    elif width == 1:
        data = (np.floor(y * 128) + 128).astype(np.uint8).tobytes()
    elif width == 3:
        data = np.floor(y * 2**23).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        data = np.floor(y * 2 ** (8 * width - 1)).astype(f"<i{width}").tobytes()
    kind = 3 if floating else 1
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * width * channels, width * channels, 8 * width)
    if extensible:
        fmt += struct.pack("<HHIH", 22, 8 * width, 0, kind) + bytes(14)
    size = 0xFFFFFFFF if tag == b"RF64" else len(data)
    ds64 = b"ds64" + struct.pack("<IQQQI", 28, 0, len(data), 0, 0) if tag == b"RF64" else b""
    return tag + struct.pack("<I", 0) + b"WAVE" + ds64 + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", size) + data


def tone(n, f, rate=SR):
    return 0.5 * np.sin(2 * np.pi * f * np.arange(n) / rate)


@pytest.mark.parametrize("width,floating,step", [(1, False, 2**-7), (2, False, 2**-15), (3, False, 2**-23), (4, False, 1e-7), (4, True, 1e-7), (8, True, 1e-7)])
@pytest.mark.parametrize("extensible", [False, True])
def test_encodings(width, floating, step, extensible):
    y = tone(5000, 440)
    got = pcm.signal(riff(y, width, floating, extensible=extensible), ".wav", SR)
    assert got.n == 5000 and np.abs(got.samples(0, 5000) - y).max() <= step
    stereo = np.stack([y, np.zeros(5000)], axis=1).reshape(-1)
    assert np.abs(pcm.signal(riff(stereo, width, floating, channels=2), ".wav", SR).samples(0, 5000) - y / 2).max() <= step


def test_headers():
    y = tone(100, 440)
    odd = riff(y, 2, before=b"LIST" + struct.pack("<I", 3) + b"abc\0")
    assert pcm.signal(odd, ".wav", SR).n == 100
    assert pcm.signal(riff(y, 2, tag=b"RF64"), ".wav", SR).n == 100
    assert pcm.signal(riff(y, 2)[:-51], ".wav", SR).n == 74  # cut short
    assert pcm.signal(b"\1\2\3", ".raw", SR).n == 1  # an odd last byte is no sample
    for data, message in (
        (riff(y, 2, rate=0), "sample rate 0"), (riff(y, 2, channels=0), "no channels"), (riff(y, 2)[:30], "WAV"), (riff([], 2), "empty"),
        (b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd", "before"), (riff(y, 2)[:20] + b"\7\0" + riff(y, 2)[22:], "encoding 7"), (b"", "not a WAV"),
    ):
        with pytest.raises(ValueError, match=message):
            pcm.signal(data, ".wav", SR)
    with pytest.raises(ValueError, match="finite"):
        pcm.signal(riff([0.1, np.nan], 4, True), ".wav", SR).samples(0, 2)


@pytest.mark.parametrize("rate", [8000, 22050, 48000, 96000, 44101])
def test_resampling(rate):
    r = Resampler(rate, SR)
    n = 3 * rate // 2
    x = tone(n, 1000.0, rate)
    y = r.apply(x, 0, 0, r.length(n))
    assert len(y) == -(-n * SR // rate)
    inner = slice(2000, -2000)
    assert np.abs(y - tone(len(y), 1000.0))[inner].max() < 1e-4
    parts = []
    for a in range(0, len(y), 7001):  # pieces with the source samples they need equal the whole
        b = min(a + 7001, len(y))
        s, t = r.span(a, b, n)
        parts.append(r.apply(x[s:t], s, a, b))
    assert np.array_equal(np.concatenate(parts), y)
    if rate > 47_000:  # nothing above the new Nyquist frequency folds back
        high = r.apply(tone(n, 23_500.0, rate), 0, 0, len(y))
        assert np.abs(high[inner]).max() < 1e-3


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib dir"
    root.mkdir()
    rng = np.random.default_rng(4)
    n = 300_000
    noise = 0.3 * rng.standard_normal(n).clip(-3, 3)
    fade = noise * np.linspace(1, 0, n) ** 6
    fade[200_000:] = 0  # silence far below the loudest band: cut off elsewhere than its own piece says
    (root / "noise.wav").write_bytes(riff(noise, 2))
    (root / "fade ä%20.wav").write_bytes(riff(fade, 4, True))
    (root / "rise.wav").write_bytes(riff(fade[::-1], 3))
    (root / "wide.wav").write_bytes(riff(np.repeat(tone(n, 900.0, 48000), 2), 2, rate=48000, channels=2))
    (root / "short.wav").write_bytes(riff(noise[:9000], 2))
    late = riff(noise, 4, True)
    (root / "late fault.wav").write_bytes(late[:-4] + struct.pack("<f", np.inf))
    (root / "bad.wav").write_bytes(b"RIFF" + bytes(400_000))
    return str(root)


def by_name(rows):
    return {r.file_name: r for r in rows.collect()}


def alike(a, b):
    for c in STATS:
        assert a[c] == pytest.approx(b[c], rel=1e-9, abs=1e-7), c


def test_ranges_equal_whole_files(spark, library):
    files = catalog.scan_files(spark, library)
    whole = by_name(extract.extract_files(files, chunk=1 << 19))
    for piece_chunks in (1, 4):
        cut = by_name(extract.extract_ranges(files.select("path", "length"), chunk=CHUNK, piece_chunks=piece_chunks))
        assert set(cut) == set(whole) and len(cut) == 7
        assert {k for k, r in cut.items() if r.error} == {k for k, r in whole.items() if r.error} == {"late fault.wav", "bad.wav"}
        for name, r in whole.items():
            if r.error:
                assert all(cut[name][c] is None for c in S.FEATURE_COLUMNS)
            else:
                alike(cut[name], r)
    one_pass = by_name(extract.extract_files(files, chunk=CHUNK, piece_chunks=1))  # the same pieces inside a task
    for name, r in whole.items():
        if not r.error:
            alike(one_pass[name], r)


def test_a_second_reading_only_where_needed(spark, library):
    files = catalog.scan_files(spark, library).select("path", "length")
    rows = extract.extract_ranges(files, chunk=CHUNK, piece_chunks=1)
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()
    listed = pcm.attributes(files).select(*S.METADATA_COLUMNS, "path", "length").where("length > 100000")
    cut = ranges.with_pieces(ranges.probed(listed, SR), SR, CHUNK)
    pieces = cut.mapInArrow(extract._pieces(SR, CHUNK), extract._PIECE).cache()
    again = signals.to_cut_again(pieces, 80.0, ("file_path", "start"))
    named = {r.file_path.split("/")[-1] for r in again.collect()}
    assert {"fade ä%20.wav", "rise.wav"} <= named and "noise.wav" not in named


def test_anti_join_reads_names_only(spark, library, tmp_path):
    files = catalog.scan_files(spark, library)
    done = spark.createDataFrame([("/x", 1.0)], "file_path string, duration double")
    listed = files.withColumn("file_path", catalog.local_path("path"))
    todo = extract.incremental.pending(listed.select("file_path"), done)
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "content" not in plan


def test_resampled_features(spark, tmp_path):
    (tmp_path / "a48.wav").write_bytes(riff(tone(96_000, 1000.0, 48000), 2, rate=48000))
    (tmp_path / "a44.wav").write_bytes(riff(tone(88_200, 1000.0), 2))
    got = by_name(extract.extract_listed(catalog.scan_files(spark, str(tmp_path)), True))
    a, b = got["a48.wav"], got["a44.wav"]
    assert a.duration == b.duration == 2.0
    assert a.spectral_centroid_mean == pytest.approx(b.spectral_centroid_mean, rel=2e-3)
    assert a.rms_mean == pytest.approx(b.rms_mean, rel=1e-3)


def test_readers_agree(spark, library):
    files = catalog.scan_files(spark, library)
    a, b = (by_name(extract.extract_listed(files, ranged)) for ranged in (True, False))
    for name, r in a.items():
        assert r.error == b[name].error
        if not r.error:
            alike(r, b[name])
    with pytest.raises(ValueError):
        extract.process_directory(spark, library, reader="none")


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    lib, out = tmp_path / "lib", str(tmp_path / "t.parquet")
    for i in range(12):
        write_wav(lib / f"{i}.wav", 900 * np.sin(np.arange(5000) / (i + 3)))
    (lib / "bad.wav").write_bytes(b"x")
    real, calls = extract.extract_listed, []

    def dies(files, *a, **k):
        if len(calls) == 2:
            raise KeyboardInterrupt
        calls.append({r.path for r in files.select("path").collect()})
        return real(files, *a, **k)

    monkeypatch.setattr(extract, "extract_listed", dies)
    with pytest.raises(KeyboardInterrupt):
        extract.process_directory(spark, str(lib), out, files_per_part=3)
    assert not os.path.exists(out)
    os.makedirs(next((tmp_path / "t.parquet.progress").iterdir()) / "part-unfinished")  # a part without its mark
    again = []

    def counts(files, *a, **k):
        again.append({r.path for r in files.select("path").collect()})
        return real(files, *a, **k)

    monkeypatch.setattr(extract, "extract_listed", counts)
    run = extract.process_directory(spark, str(lib), out, files_per_part=3)
    first, second = set().union(*calls), set().union(*again)
    assert first and second and not first & second and len(first | second) == 13
    assert (run.new, run.skipped, run.errors) == (12, 0, 1)
    assert run.failed.count() == 1 and run.features.select("file_path").distinct().count() == run.features.count() == 12
    assert not os.path.exists(out + ".progress")
    last = extract.process_directory(spark, str(lib), out, files_per_part=3)
    assert (last.new, last.skipped, last.errors) == (0, 12, 1) and last.features.count() == 12


def test_killed_before_the_log_was_cleared(spark, tmp_path, monkeypatch):
    lib, out = tmp_path / "lib", str(tmp_path / "t.csv")
    write_wav(lib / "a.wav", 900 * np.sin(np.arange(5000) / 9))
    clear = extract.progress.ProgressLog.clear
    monkeypatch.setattr(extract.progress.ProgressLog, "clear", lambda self: None)
    extract.process_directory(spark, str(lib), out)
    monkeypatch.setattr(extract.progress.ProgressLog, "clear", clear)
    run = extract.process_directory(spark, str(lib), out)
    assert (run.new, run.skipped) == (0, 1) and run.features.count() == 1


@pytest.mark.parametrize("name", ["all.csv", "all.json"])
def test_single_file_tables_are_resumed(spark, tmp_path, name):
    lib, out = tmp_path / "lib", tmp_path / name
    for i in range(3):
        write_wav(lib / f"{i}.wav", 900 * np.sin(np.arange(5000) / (i + 3)))
    old = {**{c: 0.25 for c in S.FEATURE_COLUMNS}, "file_path": f"{lib}/1.wav", "file_name": "1.wav", "file_extension": ".wav", "file_size_mb": 0.01}
    if name.endswith("json"):
        out.write_text(json.dumps([old], indent=2))
    else:
        out.write_text(",".join(old) + "\n" + ",".join(str(v) for v in old.values()) + "\n")
    run = extract.process_directory(spark, str(lib), str(out))
    assert (run.new, run.skipped) == (2, 1)
    rows = by_name(features.load_features(spark, str(out)))
    assert set(rows) == {"0.wav", "1.wav", "2.wav"} and rows["1.wav"].rms_mean == 0.25 and rows["0.wav"].rms_mean != 0.25
    assert sorted(os.listdir(tmp_path)) == sorted([name, "lib"])


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_appending_goes_by_name(spark, tmp_path, kind):
    path = str(tmp_path / f"t.{kind}")
    features.save_features(spark.createDataFrame([("/a", 1.0, 2.0)], "file_path string, duration double, tempo double"), path)
    features.append_features(spark.createDataFrame([(3.0, "/b", 4.0)], "tempo double, file_path string, duration double"), path)
    features.append_features(spark.createDataFrame([("/c", 5.0)], "FILE_PATH string, tempo double"), path)
    rows = {r.file_path: (r.duration, r.tempo) for r in features.load_features(spark, path).collect()}
    assert rows == {"/a": (1.0, 2.0), "/b": (4.0, 3.0), "/c": (None, 5.0)}
    features.append_features(spark.createDataFrame([("/d", 6.0, 7.0)], "file_path string, rms_mean double, duration double"), path)
    rows = {r.file_path: (r.duration, r.tempo, r.rms_mean) for r in features.load_features(spark, path).collect()}
    assert rows == {"/a": (1.0, 2.0, None), "/b": (4.0, 3.0, None), "/c": (None, 5.0, None), "/d": (7.0, None, 6.0)}
    with pytest.raises(ValueError):
        features.append_features(spark.createDataFrame([("/e", "/f")], "file_path string, FILE_PATH string"), path)


def test_stream_opens_its_files(spark, tmp_path):
    lib = tmp_path / "lib"
    write_wav(lib / "a.wav", 900 * np.sin(np.arange(5000) / 9))
    (lib / "b.wav").write_bytes(b"RIFF")
    got = {}
    for reader in ("ranges", "content"):
        out = str(tmp_path / reader)
        ingest.start_extraction(spark, str(lib), out, str(tmp_path / f"cp-{reader}"), reader=reader).awaitTermination()
        got[reader] = (ingest.extracted(spark, out).collect(), ingest.failures(spark, out).count())
    assert got["ranges"] == got["content"] and got["ranges"][1] == 1


def test_written_by_the_standard_library(tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setparams((1, 1, 22050, 0, "NONE", ""))
        w.writeframes(bytes([0, 128, 255]))
    data = (tmp_path / "x.wav").read_bytes()
    assert pcm.signal(data, ".wav", 22050).samples(0, 3).tolist() == [-1.0, 0.0, 127 / 128]
