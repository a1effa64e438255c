import json
import os
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark import schema as S, session
from trackspark.plans import extract
from trackspark.sources import catalog, features, incremental, pcm

SR = 44100


def write_wav(path, y, sr=SR, channels=1):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(np.asarray(y, "<i2").tobytes())


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    t = np.arange(30000)
    for i, name in enumerate(["a/one.wav", "a/b/two.wav", "three.wav"]):
        write_wav(root / name, 9000 * np.sin(t * (i + 1) / 20))
    write_wav(root / "stereo.wav", np.repeat(5000 * np.sin(t / 9), 2), channels=2)
    write_wav(root / "slow.wav", np.zeros(100), sr=8000)
    write_wav(root / "void.wav", [])
    for name, data in {"bad.wav": b"RIFF", "song.mp3": b"ID3", "LOUD.MP3": b"x", "note.txt": b"x", "_skip.wav": b"x", "x.flac": b"fLaC", "nothing.mp3": b""}.items():
        (root / name).write_bytes(data)
    return str(root)


def test_catalog(spark, library):
    rows = catalog.audio_catalog(spark, library).collect()
    names = [r.file_path[len(library) + 1 :] for r in rows]
    assert names == sorted(["a/b/two.wav", "a/one.wav", "bad.wav", "slow.wav", "song.mp3", "stereo.wav", "three.wav", "void.wav", "x.flac"])
    one = rows[1]
    assert (one.file_name, one.file_extension) == ("one.wav", ".wav")
    assert one.file_size_mb == pytest.approx(os.path.getsize(one.file_path) / 1048576)
    with pytest.raises(ValueError):
        catalog.audio_catalog(spark, library + "/none")
    every = [r.file_path[len(library) + 1 :] for r in catalog.full_catalog(spark, library).collect()]
    assert every == sorted([*names, "_skip.wav", "nothing.mp3"])
    with pytest.raises(ValueError):
        catalog.full_catalog(spark, library + "/none")
    walked, scanned = ({r.path: (r.length, r.modificationTime.replace(microsecond=0)) for r in f(spark, library).drop("content").collect()} for f in (catalog.walk_files, catalog.scan_files))
    assert {k: v for k, v in walked.items() if k in scanned} == scanned
    plan = catalog.audio_catalog(spark, library)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_pcm_extremes():
    y = pcm.pcm16(np.array([-32768, 0, 32767], "<i2").tobytes())
    assert y.dtype == np.float32 and y.tolist() == [-1.0, 0.0, 32767 / 32768]


def test_decoding(spark, library):
    files = catalog.scan_files(spark, library)
    rows = pcm.decode_files(files, chunk=10000, pad=100).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file_name, []).append(r)
    errors = {k: v[0].error for k, v in by.items() if v[0].error}
    assert set(errors) == {"bad.wav", "void.wav", "song.mp3", "x.flac"}
    assert "empty" in errors["void.wav"] and "decoder" in errors["song.mp3"]
    assert by["slow.wav"][0].n_samples == -(-100 * 44100 // 8000) and by["slow.wav"][0].sr == SR  # resampled from 8 kHz
    one = sorted(by["one.wav"], key=lambda r: r.start)
    assert [(r.start, r.lead, len(r.samples)) for r in one] == [(0, 0, 10100), (10000, 9900, 10200), (20000, 19900, 10100), (30000, 29900, 100)]
    whole = np.concatenate([np.array(r.samples[r.start - r.lead :][:10000]) for r in one])
    assert np.array_equal(whole * 32768, np.asarray(9000 * np.sin(np.arange(30000) / 20), "<i2"))
    assert by["stereo.wav"][0].n_samples == 30000


@pytest.mark.parametrize("name", ["t.csv", "t.json", "t.parquet"])
def test_directory_runs(spark, library, tmp_path, name):
    out = str(tmp_path / "deep" / "er" / name)
    first = extract.process_directory(spark, library, out)
    assert (first.new, first.skipped, first.errors) == (5, 0, 6)
    assert set(first.features.columns) == set(S.FEATURE_SCHEMA.names)
    assert {r.file_path.split("/")[-1] for r in first.failed.collect()} == {"bad.wav", "void.wav", "song.mp3", "x.flac", "_skip.wav", "nothing.mp3"}
    write_wav(os.path.join(library, "four.wav"), 3000 * np.sin(np.arange(9000) / 5))
    second = extract.process_directory(spark, library, out)
    assert (second.new, second.skipped, second.errors) == (1, 5, 6)
    saved = features.load_features(spark, out)
    assert saved.count() == 6 and saved.select("file_path").distinct().count() == 6
    assert dict(saved.dtypes)["mfcc_3_std"] == "double"
    third = extract.process_directory(spark, library, out)
    assert (third.new, third.skipped) == (0, 6) and third.features.count() == 6
    if name == "t.csv":
        forced = extract.process_directory(spark, library, out, force=True)
        assert (forced.new, forced.skipped) == (6, 0)
        saved = features.load_features(spark, out)  # the old files are gone
        assert saved.count() == 6
        r = saved.where("file_name = 'one.wav'").head()
        assert r.duration == pytest.approx(30000 / SR) and r.tempo == 120.0
        assert r.rms_mean == pytest.approx(9000 / 32768 / 2**0.5, rel=0.05)


def test_directory_run_without_checkpoint_folder(spark, library, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: None)
    run = extract.process_directory(spark, library)
    assert (run.new, run.errors) == (5, 6) and run.features.where("mfcc_1_mean is null").count() == 0


def test_releasing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path / "cp"))
    df = spark.range(5)
    with session.releasing():
        a = session.materialise_table(df)
        with session.keeping():
            session.materialise_table(df)
        assert a.count() == 5 and len(os.listdir(tmp_path / "cp")) == 2
    assert len(os.listdir(tmp_path / "cp")) == 1
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: None)
    with session.releasing():
        b = session.materialise(df)
        assert b.count() == 5 and b.storageLevel.useMemory
    assert not b.storageLevel.useMemory


def test_empty_folder(spark, tmp_path):
    (tmp_path / "e").mkdir()
    run = extract.process_directory(spark, str(tmp_path / "e"), str(tmp_path / "out.csv"))
    assert (run.new, run.errors, run.features.count()) == (0, 0, 0)
    assert not (tmp_path / "out.csv").exists()
    with pytest.raises(ValueError):
        extract.process_directory(spark, str(tmp_path / "none"))


ROW = {"file_path": '/a, "b".mp3', "duration": 1.5, "mfcc_1_mean": None, "extra": 7}


def test_read_foreign_tables(spark, tmp_path):
    c = tmp_path / "f.csv"
    c.write_text('FILE_PATH,duration,mfcc_1_mean,extra,name\n"/a, ""b"".mp3",1.5,,7,x\n/c.mp3,2,,8,y\n')
    df = features.load_features(spark, str(c))
    assert df.columns == ["FILE_PATH", "duration", "mfcc_1_mean", "extra", "name"]
    assert [t for _, t in df.dtypes] == ["string", "double", "double", "int", "string"]
    assert df.head().FILE_PATH == '/a, "b".mp3'
    j = tmp_path / "f.json"
    j.write_text(json.dumps([ROW, {**ROW, "file_path": "/c"}], indent=2))
    df = features.load_features(spark, str(j))
    assert df.count() == 2 and dict(df.dtypes)["mfcc_1_mean"] == "double"


def test_broken_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        features.load_features(spark, str(tmp_path / "no.csv"))
    with pytest.raises(FileNotFoundError):
        features.load_features(spark, str(tmp_path / "no.json"))
    bad = tmp_path / "bad.json"
    bad.write_text('[{"file_path": "/a", ')
    with pytest.raises(ValueError):
        features.load_features(spark, str(bad))
    worse = tmp_path / "bad.csv"
    worse.write_text("file_path,duration\n/a,abc\n")
    with pytest.raises(ValueError):
        features.load_features(spark, str(worse))
    p = tmp_path / "bad.parquet"
    p.write_bytes(b"not parquet at all")
    with pytest.raises(ValueError):
        features.load_features(spark, str(p))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([('/a, "b"\n.mp3'.replace("\n", " "), 1.25, None)], "file_path string, duration double, tempo double")
    for kind in ("csv", "json", "parquet"):
        path = str(tmp_path / "new" / f"t.{kind}")
        assert features.save_features(df, path)
        back = features.load_features(spark, path)
        cols = [c for c in df.columns if c in back.columns]
        assert back.select(cols).collect() == df.select(cols).collect()
    assert not features.save_features(df.where("false"), str(tmp_path / "none.csv"))
    assert features.table_format("x.dat") == "csv" and features.table_format("x", "json") == "json"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("/a", 0.2), ("/b", 0.9)], "file_path string, similarity_score double")
    features.export_similar(df, str(tmp_path / "r.csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r.csv"))
    assert [r.file_path for r in back.collect()] == ["/b", "/a"]


def test_incremental(spark):
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    done = spark.createDataFrame([("b", 1.0)], "file_path string, x double")
    todo = incremental.pending(cat, done)
    assert sorted(r.file_path for r in todo.collect()) == ["a", "c"]
    assert incremental.pending(cat, None) is cat
    assert incremental.merged(done, todo.withColumn("x", F.lit(2.0))).count() == 3
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def test_shuffles_go_with_the_write_that_needed_them(spark, monkeypatch, tmp_path):
    """What a kept table was shuffled for is not left on disk, and the setting that does it is as before."""
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path / "cp"))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {os.path.basename(f) for f in disk.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key, None)
    kept = session.materialise_table(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 900).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(key, None) == was
    assert kept.agg(F.sum("count")).head()[0] == 20_000
