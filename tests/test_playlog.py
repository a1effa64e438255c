"""Play-log operators against step-by-step simulations, with and without hot keys."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from trackspark.operators import history, ordered, playback, playlist, queue, skew
from trackspark.plans import listening

T0 = datetime(2024, 1, 1)
HOT = 25  # makes the busy keys below hot


@pytest.fixture(scope="module")
def log(spark):
    """400 plays of 6 users; user 0 has a third of them, in uneven bursts."""
    rnd = random.Random(5)
    rows, at = [], 0
    for e in range(400):
        user = 0 if rnd.random() < 0.35 else rnd.randrange(1, 6)
        at += rnd.choice([0, 1, 1, 2, 300])
        song = rnd.choice([None, *range(12)]) if rnd.random() < 0.3 else rnd.randrange(12)
        rows.append((user, T0 + timedelta(seconds=at), e, song, rnd.random() < 0.8, rnd.random() < 0.6, rnd.random() < 0.7))
    df = spark.createDataFrame(
        rows, "user_id long, ts timestamp, event_id long, song long, is_auto boolean, is_busy boolean, is_playing boolean"
    ).cache()
    by_user = defaultdict(list)
    for r in rows:
        by_user[r[0]].append(r)
    return df, by_user


@pytest.fixture(params=[HOT, 10**6], ids=["hot", "cold"])
def hot_rows(request):
    return request.param


def test_hot_log_is_really_sliced(log):
    slices = ordered.find_slices(log[0], "user_id", ("ts", "event_id"), HOT)
    cuts = slices.cuts.collect()
    assert len(cuts) >= 5 and max(len(c["_cuts"]) for c in cuts) >= 4
    used = slices.apply(log[0]).select("user_id", ordered.SLICE).distinct().count()
    assert used > 12


def test_slicing_needs_no_python_worker(spark, log):
    cuts = ordered.find_slices(log[0], "user_id", ("ts", "event_id"), HOT).cuts
    keys = skew.small_table(spark, [(None, 2), (3, 4)], T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))
    assert [tuple(r) for r in keys.collect()] == [(None, 2), (3, 4)]
    for df in (cuts, keys):
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()


@pytest.mark.parametrize("hot", [100, 1000])
@pytest.mark.parametrize("shape", ["bursts", "one time", "even"])
def test_slices_are_even_however_rows_lie(spark, hot, shape):
    rnd = random.Random(3)
    at = {"bursts": lambda e: 10**6 * (e // 5000) + e % 7, "one time": lambda e: 5, "even": lambda e: e}[shape]
    rows = [(None if e % 3 else 7, T0 + timedelta(seconds=at(e)), e) for e in range(20_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")
    sliced = ordered.find_slices(df, "user_id", ("ts", "event_id"), hot).apply(df)
    sizes = sliced.groupBy("user_id", ordered.SLICE).agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b"))
    found = sizes.orderBy("user_id", ordered.SLICE).collect()
    assert sum(r.n for r in found) == 20_000 and max(r.n for r in found) <= 2 * hot
    for x, y in zip(found, found[1:]):
        assert x.user_id != y.user_id or x.b < y.a
    assert sliced.where(ordered.HOT).count() == 20_000


def test_recent(log):
    df, users = log
    got = {r.user_id: (r.history, r.seed) for r in history.recent_songs(df, 7).collect()}
    assert got == {u: ([p[3] for p in ps][-7:], ps[-1][3]) for u, ps in users.items()}


def test_history_at_each_play(log, hot_rows):
    df, users = log
    got = {r.event_id: r.history for r in history.history_at_each_play(df, 7, hot_rows=hot_rows).collect()}
    want = {p[2]: [q[3] for q in ps[max(0, i - 6) : i + 1]] for ps in users.values() for i, p in enumerate(ps)}
    assert got == want


@pytest.mark.parametrize("steps", [1, 4])
def test_previous(log, hot_rows, steps):
    df, users = log
    got = {r.event_id: r.previous for r in history.previous_track(df, steps, hot_rows=hot_rows).collect()}
    want = {p[2]: ps[i - steps][3] if i >= steps else None for ps in users.values() for i, p in enumerate(ps)}
    assert got == want


def test_history_cap(spark):
    rows = [(u, T0 + timedelta(seconds=i), i, i) for u, n in ((1, 1), (2, 50), (3, 51)) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, song long")
    got = {r.user_id: r.history for r in history.recent_songs(df).collect()}
    assert got == {1: [0], 2: list(range(50)), 3: list(range(1, 51))}


def simulate_ends(samples):
    was_playing, last, out = False, None, []
    for _, _, event, song, _, busy, playing in samples:
        if was_playing and not busy and song == last:
            was_playing = False
            if playing:
                out.append(event)
                last = None
        elif busy:
            was_playing, last = True, song
    return out


def test_song_ends(log, hot_rows):
    df, users = log
    ends = playback.song_ends(df, "user_id", hot_rows=hot_rows).collect()
    assert sorted(r.event_id for r in ends) == sorted(e for ps in users.values() for e in simulate_ends(ps))
    assert len(ends) > 5


def simulate_modes(kinds):
    auto = loop = False
    for k in kinds:
        if k == "auto":
            auto = not auto
            loop = loop and not auto
        else:
            loop = not loop
            auto = auto and not loop
        yield "loop" if loop else "auto" if auto else "none"


def toggles_of(df):
    return df.select("user_id", "ts", "event_id", F.when(F.col("is_busy"), "auto").otherwise("loop").alias("kind"))


def test_modes(log, hot_rows):
    df, users = log
    got = {r.event_id: r.mode for r in playback.playback_modes(toggles_of(df), hot_rows=hot_rows).collect()}
    want = {}
    for ps in users.values():
        for p, m in zip(ps, simulate_modes(["auto" if p[5] else "loop" for p in ps])):
            want[p[2]] = m
    assert got == want


@pytest.mark.parametrize("kinds,want", [("aa", "none"), ("al", "loop"), ("ala", "auto"), ("lla", "auto")])
def test_mode_cases(spark, kinds, want):
    rows = [(1, T0 + timedelta(seconds=i), i, {"a": "auto", "l": "loop"}[k]) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, kind string")
    assert playback.playback_modes(df).orderBy(F.desc("ts")).head().mode == want


def test_mode_at(log, hot_rows):
    df, users = log
    modes = playback.playback_modes(toggles_of(df.where("is_playing")), hot_rows=hot_rows)
    ends = df.where("not is_playing").select("user_id", "ts", "event_id", "song")
    got = {r.event_id: (r.mode, r.action) for r in playback.mode_at(ends, modes, hot_rows=hot_rows).collect()}
    act = {"loop": "replay", "auto": "next_in_queue", "none": "stop"}
    want = {}
    for ps in users.values():
        state, kinds = "none", []
        for p in ps:
            if p[6]:
                kinds.append("auto" if p[5] else "loop")
                state = list(simulate_modes(kinds))[-1]
            else:
                want[p[2]] = (state, act[state])
    assert got == want


def test_auto_advances(log, hot_rows):
    df, users = log
    got = {r.event_id: (r.advance, r.epoch, r.slot, r.refresh) for r in playback.auto_advances(df, hot_rows=hot_rows).collect()}
    want = {}
    for ps in users.values():
        a = 0
        for p in ps:
            a = a + 1 if p[4] else 0
            want[p[2]] = (a, a // 6, a % 6, a > 0 and a % 6 == 0)
    assert got == want


def test_playlist_cycle(log, hot_rows):
    df, users = log
    items = df.select("user_id", F.col("event_id").alias("pos"), "song")
    got = {r.pos: (r.next_song, r.previous_song) for r in playlist.playlist_cycle(items, "user_id", hot_rows=hot_rows).collect()}
    want = {
        p[2]: (ps[(i + 1) % len(ps)][3], ps[i - 1][3]) for ps in users.values() for i, p in enumerate(ps)
    }
    assert got == want


def test_playlist_start(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 0, "p"), ("b", 1, "q"), ("b", 2, "r")], "playlist_id string, pos int, song string")
    got = {r.playlist_id: (r.next_song, r.previous_song) for r in playlist.first_steps(df).collect()}
    assert got == {"a": ("x", "x"), "b": ("p", "q")}
    assert playlist.playlist_cycle(df.where("false")).count() == 0


def test_hot_join(log):
    df, users = log
    right = df.select("user_id").distinct().withColumn("name", F.concat(F.lit("u"), F.col("user_id")))
    right = right.where("user_id <> 3")
    for how in ("inner", "left"):
        got = skew.hot_join(df, right, "user_id", F.col("event_id"), how, hot_rows=HOT)
        want = df.join(right, "user_id", how)
        cols = ["user_id", "event_id", "name"]
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, want.select(*cols).collect()), key=str)


def simulate_queue(plays, near, request, size, every):
    """What plays at every advance, following the queue rules step by step."""
    hist, q, index, since, out = [], [], 0, 0, {}

    def build(seed):
        fresh = [n for n in near.get(seed, []) if n not in hist[-6:]][:request]
        return [n for n in fresh if n != seed][:size]

    started = False
    for p in plays:
        hist.append(p[3])
        if not p[4]:
            q, index, since, started = build(p[3]), 0, 0, True
            continue
        index, since = index + 1, since + 1
        if since >= every and q:
            q, index, since = build(p[3]), 0, 0
        if index >= len(q):
            index = 0
        out[p[2]] = q[index] if q and started else None
    return out


def test_auto_played(spark, log, hot_rows):
    df, users = log
    plays = df.where("song is not null")
    rnd = random.Random(2)
    lib = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(12)], "id long, vector array<double>")
    from trackspark.operators import knn

    k = 6
    near = defaultdict(list)
    for r in knn.knn_join(knn.build_index(lib, k), lib, k).orderBy("query_id", "rank").collect():
        near[r.query_id].append(r.id)
    got = listening.auto_played(plays, lib, request=3, size=2, overfetch=2, history_size=6, refresh_every=3, hot_rows=hot_rows)
    got = {r.event_id: r.next_id for r in got.collect()}
    want = {}
    for ps in users.values():
        want.update(simulate_queue([p for p in ps if p[3] is not None], near, 3, 2, 3))
    assert got == want
    assert sum(v is None for v in want.values()) > 0


def test_queue_rules(spark):
    near = [{"id": i, "score": 1 - i / 10} for i in range(8)]
    df = spark.createDataFrame([(near, [1, 2], 3)], "near array<struct<id:int,score:double>>, history array<int>, seed int")
    got = df.select(queue.pick_queue(F.col("near"), F.col("history"), F.col("seed"), 4, 2).alias("q")).head().q
    assert [e.id for e in got] == [0, 4]  # asked: 0 3 4 5


def test_auto_played_keeps_the_log_by_column(spark, monkeypatch):
    """The log with its histories and the neighbours are kept as columns, and what the search shuffles is gone before the queues are built."""
    kept, plain = [], listening.materialise_table
    monkeypatch.setattr(listening, "materialise_table", lambda df: kept.append(df.columns) or plain(df))
    plays = spark.range(60).select(
        (F.col("id") % 3).alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 7).alias("song"), (F.col("id") % 5 != 0).alias("is_auto")
    )
    lib = spark.range(7).select("id", F.array(F.col("id") + 1.0, F.lit(2.0), F.col("id") * F.col("id") * 0.5).alias("vector"))
    got = listening.auto_played(plays, lib, request=3, size=2, overfetch=1, history_size=3, refresh_every=3)
    assert got.count() == 48 and got.where("next_id is not null").count() > 20
    assert len(kept) == 2 and "history" in kept[0] and set(kept[1]) >= {"query_id", "id", "score"}
