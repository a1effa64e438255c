"""Streams over split logs must end where the batch operators do."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_sources import write_wav
from trackspark.operators import history, playback
from trackspark.plans import listening
from trackspark.streaming import ingest, queues
from trackspark.streaming.history import stream_history
from trackspark.streaming.playback import stream_auto_advances, stream_modes_at_ends
from trackspark.streaming.song_end import stream_song_ends

SCHEMA = "user_id long, ts timestamp, event_id long, song string, is_busy boolean, is_playing boolean"


def write_log(spark, folder, shuffle):
    rnd = random.Random(1)
    rows = []
    for e in range(300):
        user = 0 if rnd.random() < 0.4 else rnd.randrange(1, 5)
        rows.append((user, datetime(2024, 1, 1) + timedelta(seconds=e // 2), e, f"s{rnd.randrange(10)}", rnd.random() < 0.6, rnd.random() < 0.7))
    parts = list(rows)
    if shuffle:
        rnd.shuffle(parts)
    for i in range(0, 300, 60):  # files in time order of their names
        spark.createDataFrame(parts[i : i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.schema(SCHEMA).parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_history(spark, tmp_path):
    log = write_log(spark, tmp_path / "log", shuffle=True)  # plays arrive late and unordered
    got = {}

    def collect(df, _):
        for r in df.collect():
            got[r.user_id] = r

    q = (
        stream_history(stream(spark, tmp_path / "log"), 20)
        .writeStream.outputMode("update")
        .foreachBatch(collect)
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert len(q.recentProgress) >= 5
    want = {r.user_id: r for r in history.recent_songs(log, 20).collect()}
    assert {u: r.history for u, r in got.items()} == {u: r.history for u, r in want.items()}
    assert all(r.seed == r.history[-1] and r.previous == r.history[-2] for r in got.values())


def late_log(spark, folder):
    """A log whose files interleave: samples come up to 40 s late. The last files move the watermark past all of it."""
    rnd = random.Random(9)
    rows = []
    for e in range(400):
        user = 0 if rnd.random() < 0.4 else rnd.randrange(1, 5)
        song = None if rnd.random() < 0.1 else f"s{rnd.randrange(3)}"
        rows.append((user, datetime(2024, 1, 1) + timedelta(seconds=e // 2), e, song, rnd.random() < 0.5, rnd.random() < 0.7))
    arriving = sorted(rows, key=lambda r: r[2] // 2 + rnd.uniform(0, 40))
    after = [(99, datetime(2024, 1, 2, i), 1000 + i, "x", False, False) for i in range(3)]
    log = spark.createDataFrame(rows, SCHEMA)
    for part in [arriving[i : i + 50] for i in range(0, 400, 50)] + [after[:1], after[1:2], after[2:]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)  # files are taken in the order of their times
    return log


def drained(spark, df, tmp_path, name):
    out = str(tmp_path / name)
    q = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out), q


def test_song_ends(spark, tmp_path):
    log = late_log(spark, tmp_path / "log").withColumnRenamed("user_id", "device_id")
    live = stream(spark, tmp_path / "log").withColumnRenamed("user_id", "device_id")
    got, q = drained(spark, stream_song_ends(live, "1 minute"), tmp_path, "out")
    want = playback.song_ends(log).select("device_id", "ts", "event_id", "song").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and want
    assert len(q.recentProgress) >= 8


def test_silent_devices_are_forgotten(spark, tmp_path):
    late_log(spark, tmp_path / "log")
    live = stream(spark, tmp_path / "log").withColumnRenamed("user_id", "device_id")
    _, q = drained(spark, stream_song_ends(live, "1 minute", forget_after_ms=3_600_000), tmp_path, "out")
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) >= 5 and rows[-1] <= 2


def test_auto_advances(spark, tmp_path):
    log = late_log(spark, tmp_path / "log").withColumn("is_auto", F.col("is_playing"))
    live = stream(spark, tmp_path / "log").withColumn("is_auto", F.col("is_playing"))
    got, _ = drained(spark, stream_auto_advances(live, 3), tmp_path, "out")
    want = playback.auto_advances(log, refresh_every=3).select(got.columns)
    assert sorted(map(tuple, got.where("user_id < 99").collect()), key=lambda r: r[2]) == sorted(map(tuple, want.collect()), key=lambda r: r[2])


def test_modes_at_ends(spark, tmp_path):
    log = late_log(spark, tmp_path / "log")
    live = stream(spark, tmp_path / "log")

    def parts(df):
        kind = F.when(F.col("song") == "s0", "loop").otherwise("auto")
        return df.where("is_busy").select("user_id", "ts", "event_id"), df.where("not is_busy").select("user_id", "ts", "event_id", kind.alias("kind"))

    ends, toggles = parts(log)
    want = playback.mode_at(ends, playback.playback_modes(toggles)).select("user_id", "event_id", "mode", "action").collect()
    got, _ = drained(spark, stream_modes_at_ends(*parts(live)), tmp_path, "out")
    assert sorted(map(tuple, got.where("user_id < 99").select("user_id", "event_id", "mode", "action").collect())) == sorted(map(tuple, want))
    assert len({r.mode for r in want}) == 3


def test_extraction(spark, tmp_path):
    lib = tmp_path / "lib"
    for i in range(5):
        write_wav(lib / f"d{i % 2}" / f"{i}.wav", 4000 * np.sin(np.arange(9000) / (i + 2)))
    (lib / "bad.wav").write_bytes(b"?")

    def run():
        ingest.start_extraction(spark, str(lib), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=2).awaitTermination()

    run()
    assert ingest.extracted(spark, str(tmp_path / "out")).count() == 5
    assert ingest.failures(spark, str(tmp_path / "out")).count() == 1
    run()  # nothing new
    write_wav(lib / "late.wav", 100 * np.sin(np.arange(5000)))
    run()
    got = ingest.extracted(spark, str(tmp_path / "out"))
    assert got.count() == 6 == got.select("file_path").distinct().count()
    assert got.where("mfcc_1_mean is null").count() == 0


def test_queues(spark, tmp_path):
    log = write_log(spark, tmp_path / "log", shuffle=False)
    rng = np.random.default_rng(0)
    lib = spark.createDataFrame([(f"s{i}", rng.normal(size=4).tolist()) for i in range(40)], "id string, vector array<double>")
    q = queues.start_queues(stream(spark, tmp_path / "log"), lib, str(tmp_path / "out"), str(tmp_path / "cp"), 6, 4)
    q.awaitTermination()
    got = {r.user_id: (r.seed, [e.id for e in r.queue]) for r in queues.current_queues(spark, str(tmp_path / "out")).collect()}
    want = listening.user_queues(log, lib, 6, 4).collect()
    assert got == {r.user_id: (r.seed, [e.id for e in r.queue]) for r in want}
    assert any(v[1] for v in got.values())


@pytest.mark.parametrize("idle", [None, 10_000])
def test_plan_combines_before_state(spark, tmp_path, idle):
    write_log(spark, tmp_path / "log", shuffle=False)
    df = stream_history(stream(spark, tmp_path / "log"), idle_timeout_ms=idle)
    assert df.isStreaming and df.columns == ["user_id", "history", "seed", "previous"]
    assert F
