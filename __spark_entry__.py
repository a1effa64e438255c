"""Queries over the test tables, and the same results as SQL.

``queries()`` runs the library's operators on the given tables; ``oracle_sql()`` states
what each must return. The tables stand in for a music service: ``embeddings`` are
feature vectors (and 64-sample signals), ``part`` is the track catalogue, ``events`` is
the play log and the stream of player samples, ``documents``/``labels`` are files and
their tags.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trackspark.functions import formats, names, paths
from trackspark.operators import (
    hashing,
    history,
    knn,
    playback,
    playlist,
    prep,
    queue,
    report,
    resolve,
    signals,
)
from trackspark.plans import extract, listening
from trackspark.schema import TOP_RECOMMENDATIONS
from trackspark.session import ship_package, widen
from trackspark.sources import catalog, incremental, pcm

# The training-data operators are a part of their own, which may be absent.
try:
    import corpus_pipeline
    from trackspark.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("trackspark.llm", "corpus_pipeline")):
        raise
    corpus_pipeline = llm_queries = None

DIMS = 64
SR = 44100
GRID = signals.Grid(frame=16, hop=8)
MEL = signals.MelSettings(frame=16, hop=8, n_mels=12, n_mfcc=5)
CHUNK = 32  # two-and-a-bit chunks per 64-sample signal, so chunk borders are exercised


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- table roles ------------------------------------------------------------


def _vectors(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    )


def _feature_columns(spark, sf) -> DataFrame:
    return prep.explode_array(
        _read(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", "e", DIMS
    )


def _tracks(spark, sf) -> DataFrame:
    """Track catalogue: ``id, file_path, duration`` and tag columns."""
    return _read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(
            "",
            F.lit("/lib/"), "p_brand", F.lit("/"), "p_name", F.lit(" - "), "p_type", F.lit(" "), "p_partkey", F.lit(".mp3"),
        ).alias("file_path"),
        (F.col("p_retailprice") / 7).alias("duration"),
        F.when(F.col("p_size") > 25, F.col("p_name")).alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
    )


def _plays(spark, sf) -> DataFrame:
    """Play log; every event plays one of the songs in ``embeddings``."""
    songs = _read(spark, sf, "embeddings").count()
    return _read(spark, sf, "events").select(
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (F.col("event_id") % songs).alias("song"),
        (F.col("event_type") != "signup").alias("is_auto"),
    )


def _toggles(spark, sf) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "auto").otherwise("loop")
    return (
        _read(spark, sf, "events")
        .where(F.col("event_type").isin("click", "signup"))
        .select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"))
    )


def _samples(spark, sf) -> DataFrame:
    """Player samples of 20 devices."""
    return _read(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("device_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("event_type").isin("view", "click", "purchase").alias("is_busy"),
        (F.col("event_type") != "error").alias("is_playing"),
        F.col("user_id").alias("song"),
    )


def _signals(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.lit(SR).alias("sr"), F.col("embedding").alias("samples")
    )


def _chunks(spark, sf) -> DataFrame:
    return signals.chunk_signals(widen(_signals(spark, sf)), pad=GRID.frame // 2, chunk=CHUNK)


def _micros(c: str = "ts"):
    return F.unix_micros(c).alias("ts_us")


def _r(c: str, digits: int = 6):
    return (F.round(c, digits) + 0.0).alias(c)


# --- features ---------------------------------------------------------------


def column_stats(spark, sf):
    df = _read(spark, sf, "lineitem")
    return prep.column_stats(df, prep.feature_columns(df)).select("feature", _r("mean"), _r("std"))


def feature_standardize(spark, sf):
    df = _feature_columns(spark, sf)
    cols = prep.feature_columns(df, metadata=("vec_id",))
    space = prep.fit_feature_space(df, cols, n_components=None)
    return space.transform(df).select("vec_id", F.posexplode("vector").alias("dim", "value")).select(
        "vec_id", "dim", _r("value")
    )


_WEIGHTED = {
    "l_quantity": "mfcc_1_mean",
    "l_extendedprice": "chroma_1_mean",
    "l_discount": "tempo",
    "l_tax": "spectral_centroid_mean",
}


def feature_weight(spark, sf):
    df = _read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *[F.col(a).alias(b) for a, b in _WEIGHTED.items()]
    )
    cols = prep.feature_columns(df, metadata=("l_orderkey", "l_linenumber"))
    space = prep.fit_feature_space(df, cols, n_components=None)
    values = [F.col("vector")[i].alias(c) for i, c in enumerate(cols)]
    return (
        space.transform(df)
        .select("l_orderkey", "l_linenumber", *values)
        .select("l_orderkey", "l_linenumber", *[_r(c) for c in cols])
    )


# --- similarity -------------------------------------------------------------


def knn_single(spark, sf):
    lib = _vectors(spark, sf)
    return knn.similar_to(lib, lib.where("id = 0"), 5).select("id", "rank", _r("similarity_score"))


def knn_join(spark, sf):
    lib = _vectors(spark, sf)
    return knn.knn_join(knn.build_index(lib, 5), lib, 5).select("query_id", "id", "rank", _r("score"))


def knn_join_cells(spark, sf):
    """:func:`knn_join` over many small cells."""
    lib = _vectors(spark, sf)
    return knn.knn_join(knn.build_index(lib, 5, rows_per_cell=100), lib, 5).select("query_id", "id", "rank", _r("score"))


def knn_approximate(spark, sf):
    """Whether the hashed search finds nine tenths of the exact neighbours of all vectors."""
    lib = _vectors(spark, sf)
    index = hashing.build_hash_index(lib, 5)
    return hashing.recall(index, lib, knn.knn_join(knn.build_index(lib, 5), lib, 5), 5).select(
        "n_queries", (F.col("found") >= 0.9 * F.col("wanted")).alias("recall_reached")
    )


def knn_euclidean(spark, sf):
    lib = _vectors(spark, sf)
    return knn.knn_join(knn.build_index(lib, 5, "euclidean"), lib, 5).select(
        "query_id", "id", "rank", _r("score")
    )


def _pca_neighbours(spark, sf, n_components):
    df = _feature_columns(spark, sf)
    cols = prep.feature_columns(df, metadata=("vec_id",))
    space = prep.fit_feature_space(df, cols, n_components=n_components)
    lib = space.transform(df).select(F.col("vec_id").alias("id"), "vector")
    return knn.knn_join(knn.build_index(lib, 5), lib, 5).select("query_id", "id", "rank", _r("score"))


def knn_pca_full(spark, sf):
    return _pca_neighbours(spark, sf, DIMS)


def knn_pca95(spark, sf):
    return _pca_neighbours(spark, sf, 0.95)


def pca_cut(spark, sf):
    """95 % of the variance of two columns that almost agree: one component, half the sum of both up to scale."""
    df = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") + 20 * F.col("l_discount")).alias("shifted"))
    space = prep.fit_feature_space(df, ["l_quantity", "shifted"], n_components=0.95)
    return space.transform(df).select(
        "l_orderkey", "l_linenumber", F.lit(space.n_components).alias("kept"), F.lit(round(space.explained, 6)).alias("explained"), (F.round(F.col("vector")[0], 6) + 0.0).alias("value")
    )


def knn_exclude(spark, sf):
    """Top 5 of 15 per song, without the last 50 songs of the user with the song's number."""
    lib = _vectors(spark, sf)
    near = knn.knn_join(knn.build_index(lib, 15), lib, 15)
    heard = history.recent_plays(_plays(spark, sf)).select(
        F.col("user_id").alias("query_id"), F.col("song").alias("id")
    )
    return knn.without_excluded(near, heard, 5).select("query_id", "id", "rank", _r("score"))


def resolve_song(spark, sf):
    key = F.col("p_partkey")
    part = _read(spark, sf, "part")
    text = (
        F.when(key % 5 == 0, F.concat_ws("", F.lit("/lib/"), "p_brand", F.lit("/"), "p_name", F.lit(" - "), "p_type", F.lit(" "), key, F.lit(".mp3")))
        .when(key % 5 == 1, F.concat_ws("", F.lit("/old/"), "p_name", F.lit(" - "), "p_type", F.lit(" "), key, F.lit(".mp3")))
        .when(key % 5 == 2, F.concat_ws("", F.lit("/x/"), "p_name", F.lit(" - unheard "), key, F.lit(".ogg")))
        .when(key % 5 == 3, F.concat_ws("", "p_type", F.lit(" "), key, F.lit(".flac")))
        .otherwise(F.concat_ws("", F.lit("nothing "), key, F.lit(".mp3")))
    )
    asked = part.select(key.alias("query_id"), text.alias("song_path"))
    return resolve.resolve_songs(asked, _tracks(spark, sf)).select("query_id", "song_path", "file_path", "tier")


# --- files ------------------------------------------------------------------


def incremental_antijoin(spark, sf):
    docs, done = _read(spark, sf, "documents").select("doc_id", "source", "n_chars"), _read(spark, sf, "labels")
    return incremental.pending(docs, done, "doc_id")


def ingest_counts(spark, sf):
    """Events of users known from an error-free first day are skipped; errors fail."""
    rows = _read(spark, sf, "events")
    return incremental.ingest_counts(
        rows, F.col("event_type") == "error", F.col("event_type") == "signup"
    )


def catalog_attrs(spark, sf):
    pages = _read(spark, sf, "pages").select("page_id", "url", F.octet_length("html").alias("length"))
    attrs = catalog.file_attributes(pages.select("url", "length"), "url", "length")
    return attrs.select(
        "file_path",
        "file_name",
        "file_extension",
        _r("file_size_mb", 9),
        paths.stem("file_path").alias("stem"),
        paths.path_key("file_path").alias("path_key"),
        paths.short_path_key("file_path").alias("short_key"),
        paths.needs_transcode("file_path").alias("transcode"),
    )


def parse_names(spark, sf):
    t = _tracks(spark, sf).select("id", "file_path")
    forms = t.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.col("file_path"))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("/n/"), F.col("id"), F.lit(" - "), paths.base_name("file_path")))
        .otherwise(F.concat(paths.stem("file_path"), F.lit(" (live) - "), F.col("id"), F.lit(".mp3")))
        .alias("file_path"),
    )
    return forms.select(
        "id", "file_path", names.parsed_name("file_path").alias("n"), names.parsed_name("file_path", True).alias("m")
    ).select(
        "id", "file_path", "n.filename", "n.title", "n.artist",
        F.col("m.artist").alias("numbered_artist"), F.col("m.title").alias("numbered_title"), F.col("m.track_num"),
    )


def tag_defaults(spark, sf):
    docs = _read(spark, sf, "documents").select(
        "doc_id", F.concat_ws("", F.lit("/docs/"), "source", F.lit("/"), "doc_id", F.lit(".mp3")).alias("file_path")
    )
    tags = (
        _read(spark, sf, "labels")
        .join(docs, "doc_id")
        .select(
            "file_path",
            F.when(F.col("quality") == 1, F.concat(F.lit("song "), F.col("doc_id"))).alias("title"),
            F.when(F.col("toxic") == 0, F.lit("clean")).alias("artist"),
            F.lit(None).cast("string").alias("album"),
        )
    )
    return names.with_tags(docs, tags)


def format_texts(spark, sf):
    return _read(spark, sf, "orders").select(
        "o_orderkey",
        formats.duration_text(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 100)).alias("duration"),
        formats.clock_text((F.col("o_totalprice") - 100000) / 100).alias("clock"),
        formats.percent_text(F.col("o_totalprice") / 500000).alias("percent"),
        formats.band(F.col("o_totalprice") / 300000).alias("band"),
    )


def text_cuts(spark, sf):
    return _read(spark, sf, "documents").select(
        "doc_id",
        formats.head("text", 50).alias("head50"),
        formats.head("text", 30).alias("head30"),
        formats.ellipsis("text", 50).alias("cut50"),
        formats.ellipsis("text", 35, 35).alias("cut35"),
    )


def format_report(spark, sf):
    """Report of the five nearest songs of every catalogued song."""
    lib = _vectors(spark, sf)
    tracks = _tracks(spark, sf).select("id", "file_path", "duration")
    asked = lib.select("id").join(tracks, "id").select(
        F.col("id").alias("query_id"), F.col("file_path").alias("song_path"), "file_path", "duration"
    )
    near = knn.knn_join(knn.build_index(lib, 5), lib, 5).join(tracks, "id", "left")
    similar = near.join(asked.select("query_id"), "query_id", "left_semi").withColumnRenamed("score", "similarity_score")
    return report.similarity_report(asked, similar)


# --- signals ----------------------------------------------------------------


def _measure(spark, sf, name, digits):
    stats = signals.track_moments(_chunks(spark, sf), (name,), GRID, chunk=CHUNK)
    return stats.select("track_id", _r(f"{name}_mean", digits), _r(f"{name}_std", digits))


def signal_rms(spark, sf):
    return _measure(spark, sf, "rms", 6)


def signal_zcr(spark, sf):
    return _measure(spark, sf, "zero_crossing_rate", 6)


def signal_centroid(spark, sf):
    return _measure(spark, sf, "spectral_centroid", 4)


def signal_bandwidth(spark, sf):
    return _measure(spark, sf, "spectral_bandwidth", 4)


def signal_mfcc(spark, sf):
    cols = [f"mfcc_{i}" for i in range(1, MEL.n_mfcc + 1)]
    stats = signals.track_moments(_chunks(spark, sf), (), GRID, MEL, CHUNK)
    return stats.select("track_id", *[_r(f"{c}_{s}", 4) for c in cols for s in ("mean", "std")])


def _document_files(spark, sf) -> DataFrame:
    """Documents as raw audio files: their bytes are 16-bit samples."""
    content = F.encode("text", "UTF-8")
    return _read(spark, sf, "documents").select(
        F.concat_ws("", F.lit("/docs/"), "doc_id", F.lit(".pcm")).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def pcm_ingest(spark, sf):
    chunk, pad = 1024, 256
    chunks = pcm.decode_files(widen(_document_files(spark, sf)), SR, pad, chunk)
    # A chunk also carries its surroundings; count every sample in the chunk it belongs to.
    own = F.slice(
        "samples",
        (F.col("start") - F.col("lead") + 1).cast("int"),
        F.least(F.lit(chunk), F.greatest(F.col("n_samples") - F.col("start"), F.lit(0))).cast("int"),
    )
    level = lambda x: (x * 32768).cast("bigint")
    return (
        chunks.select("file_path", "error", "sr", "n_samples", own.alias("own"))
        .groupBy("file_path", "error", "sr", "n_samples")
        .agg(
            F.sum(F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + level(x))).alias("total"),
            F.min(level(F.array_min("own"))).alias("low"),
            F.max(level(F.array_max("own"))).alias("high"),
        )
        .withColumn("duration", F.col("n_samples") / F.col("sr"))
        .select("file_path", "error", "n_samples", _r("duration"), "total", "low", "high")
    )


def track_features(spark, sf):
    """Full-size feature rows of all documents read as audio."""
    return extract.extract_files(_document_files(spark, sf), SR)


def track_basics(spark, sf):
    """The columns of :func:`track_features` that need no Fourier transform."""
    rows = extract.extract_files(_document_files(spark, sf), SR)
    stats = [_r(f"{m}_{s}") for m in ("rms", "zero_crossing_rate") for s in ("mean", "std")]
    return rows.select("file_path", "file_name", "file_extension", _r("file_size_mb", 9), "error", _r("duration"), *stats, "chroma_12_std", "tempo", "drone_likelihood")


# --- play log ---------------------------------------------------------------

SLICE_ROWS = 16  # for the queries that cut every busy key into slices


def history50(spark, sf):
    return history.recent_plays(_plays(spark, sf)).select("user_id", _micros(), "event_id", "song")


def history_rolling(spark, sf):
    rows = history.history_at_each_play(_plays(spark, sf))
    return rows.select("user_id", "event_id", F.concat_ws(",", F.col("history").cast("array<string>")).alias("history"))


def previous_track(spark, sf):
    plays = _plays(spark, sf)
    one = history.previous_track(plays)
    return history.previous_track(one, 3, out="third_last").select("user_id", "event_id", "song", "previous", "third_last")


def _queue_rows(spark, sf):
    queued = listening.user_queues(_plays(spark, sf), _vectors(spark, sf))
    return queue.queue_rows(queued, "user_id", "seed")


def history_rolling_sliced(spark, sf):
    rows = history.history_at_each_play(_plays(spark, sf), hot_rows=SLICE_ROWS)
    return rows.select("user_id", "event_id", F.concat_ws(",", F.col("history").cast("array<string>")).alias("history"))


def previous_track_sliced(spark, sf):
    one = history.previous_track(_plays(spark, sf), hot_rows=SLICE_ROWS)
    return history.previous_track(one, 3, out="third_last", hot_rows=SLICE_ROWS).select("user_id", "event_id", "song", "previous", "third_last")


def user_queue(spark, sf):
    tracks = _tracks(spark, sf)
    rows = _queue_rows(spark, sf).join(tracks.select("id", "file_path"), "id", "left")
    titled = names.with_tags(rows, tracks.select("file_path", "title", "artist", "album"))
    return titled.select("user_id", "seed", "pos", "id", "title", _r("score"))


def top5(spark, sf):
    return _queue_rows(spark, sf).where(F.col("pos") < TOP_RECOMMENDATIONS).select("user_id", "pos", "id", _r("score"))


def auto_advance(spark, sf):
    return playback.auto_advances(_plays(spark, sf)).select(
        "user_id", "event_id", "is_auto", "advance", "epoch", "slot", "refresh"
    )


def auto_advance_sliced(spark, sf):
    return playback.auto_advances(_plays(spark, sf), hot_rows=SLICE_ROWS).select(
        "user_id", "event_id", "is_auto", "advance", "epoch", "slot", "refresh"
    )


def next_from_queue(spark, sf):
    return listening.auto_played(_plays(spark, sf), _vectors(spark, sf)).select(
        "user_id", "event_id", "epoch", "slot", "next_id"
    )


def playlist_cycle(spark, sf):
    """Each user's log as a circular playlist."""
    items = _plays(spark, sf).select("user_id", F.col("event_id").alias("pos"), "song")
    return playlist.playlist_cycle(items, "user_id").select("user_id", "pos", "song", "next_song", "previous_song")


def playlist_cycle_sliced(spark, sf):
    items = _plays(spark, sf).select("user_id", F.col("event_id").alias("pos"), "song")
    return playlist.playlist_cycle(items, "user_id", hot_rows=SLICE_ROWS).select("user_id", "pos", "song", "next_song", "previous_song")


def playlist_first_steps(spark, sf):
    items = _plays(spark, sf).select("user_id", F.col("event_id").alias("pos"), "song")
    return playlist.first_steps(items, "user_id")


def song_end(spark, sf):
    return playback.song_ends(_samples(spark, sf)).select("device_id", _micros(), "event_id", "song")


def song_end_sliced(spark, sf):
    return playback.song_ends(_samples(spark, sf), hot_rows=SLICE_ROWS).select("device_id", _micros(), "event_id", "song")


def mode_islands_sliced(spark, sf):
    return playback.playback_modes(_toggles(spark, sf), hot_rows=SLICE_ROWS).select("user_id", "event_id", "kind", "mode")


def mode_islands(spark, sf):
    return playback.playback_modes(_toggles(spark, sf)).select("user_id", "event_id", "kind", "mode")


def mode_at_end(spark, sf):
    ends = (
        _read(spark, sf, "events")
        .where("event_type = 'purchase'")
        .select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    )
    return playback.mode_at(ends, playback.playback_modes(_toggles(spark, sf))).select(
        "user_id", "event_id", "mode", "action"
    )


_QUERIES = (
    column_stats, feature_standardize, feature_weight,
    knn_single, knn_join, knn_join_cells, knn_approximate, knn_euclidean, knn_pca_full, knn_pca95, pca_cut, knn_exclude, resolve_song,
    incremental_antijoin, ingest_counts, catalog_attrs, parse_names, tag_defaults,
    format_texts, text_cuts, format_report,
    signal_rms, signal_zcr, signal_centroid, signal_bandwidth, signal_mfcc, pcm_ingest, track_features, track_basics,
    history_rolling_sliced, previous_track_sliced, auto_advance_sliced, playlist_cycle_sliced, song_end_sliced, mode_islands_sliced,
    history50, history_rolling, previous_track, user_queue, top5, auto_advance, next_from_queue,
    playlist_cycle, playlist_first_steps, song_end, mode_islands, mode_at_end,
)


def entry(spark: SparkSession) -> DataFrame:
    """Next-song queue of every listener."""
    return user_queue(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {q.__name__: q for q in _QUERIES}
    if llm_queries is not None:
        found |= {q.__name__: q for q in llm_queries.QUERIES} | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    from oracle import ORACLE

    found = dict(ORACLE)
    if llm_queries is not None:
        found |= llm_queries.ORACLE
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
