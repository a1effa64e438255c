"""Folder of audio files -> feature table, incrementally."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackspark import schema as S
from trackspark.operators import moments, signals
from trackspark.session import keeping, materialise, materialise_table, releasing, widen
from trackspark.sources import catalog, features, incremental, pcm, progress, ranges

log = logging.getLogger(__name__)

PIECE_CHUNKS = 64  # chunks that are measured together: about 13 minutes at 44.1 kHz
_STATISTICS = [f"{m}_{s}" for m in (*S.FRAME_MEASURES, *signals.mfcc_names(signals.MelSettings())) for s in ("mean", "std")]
_ATTRIBUTES = [T.StructField(c, T.StringType()) for c in S.METADATA_COLUMNS[:3]] + [T.StructField(S.METADATA_COLUMNS[3], T.DoubleType())]
_TRACK = T.StructType(
    [*_ATTRIBUTES, T.StructField("error", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("duration", *_STATISTICS)]]
)
_PIECE = T.StructType(
    [T.StructField("file_path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("error", T.StringType()), *signals.PIECE_FIELDS]
)


@dataclass(frozen=True)
class Extraction:
    """Outcome of a run. ``features`` is the whole table, ``failed`` the dead letters."""

    features: DataFrame
    failed: DataFrame
    new: int
    skipped: int
    errors: int


def _meter(chunk: int) -> signals.Meter:
    return signals.Meter(signals.Grid(), signals.MelSettings(), chunk, S.FRAME_MEASURES)


def _tracks(signal_of, sr: int, chunk: int, piece_chunks: int):
    """Task body: a row per file in, a row of attributes, ``error``, duration and statistics out.

    ``signal_of(row)`` yields the file's signal. Any fault of a file stays with this file.
    """
    schema, meter = to_arrow_schema(_TRACK), _meter(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}
                made: list = [None] * (1 + len(_STATISTICS))
                try:
                    signal, error = signal_of(row), None
                    sets = meter.whole(signal, sr, S.N_FFT // 2, piece_chunks)
                    made = [signal.n / sr, *[float(x) for m in sets for pair in zip(m[1], moments.deviations(m)) for x in pair]]
                except Exception as e:
                    error = str(e) or type(e).__name__
                out.append([*[row[c] for c in S.METADATA_COLUMNS], error, *made])
            columns = [list(c) for c in zip(*out)] or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _pieces(sr: int, chunk: int):
    """Task body: pieces of files in, their moments out; ``loudest``, where it is known, is the file's loudest band."""
    schema, meter = to_arrow_schema(_PIECE), _meter(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                made, error = [None] * len(signals.PIECE_FIELDS), None
                try:
                    with ranges.opened(row["path"]) as read:
                        signal = pcm.Signal(read, ranges.layout_of(row), sr)
                        chunks = signal.chunks(S.N_FFT // 2, chunk, row["start"], min(row["stop"], signal.n + 1))
                        p = meter.piece(chunks, signal.n, sr, row.get("loudest"))
                    made = [*moments.packed(p.measures), *moments.packed(p.coefficients), p.peak, p.low]
                except Exception as e:  # any fault of this file stays with this file
                    error = str(e) or type(e).__name__
                values = [row["file_path"], row["start"], error, *made]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return run


def extract_files(files: DataFrame, sr: int = S.SAMPLE_RATE, chunk: int = signals.CHUNK_SAMPLES, piece_chunks: int = PIECE_CHUNKS) -> DataFrame:
    """Feature rows of files given with their bytes (``path, length, content``) with an ``error`` column.

    One pass and no shuffle: a file is decoded and measured where its bytes are, and one row per file leaves the task. Small
    files are listed many to a split; where that leaves cores idle they are spread first. A file without bytes (null) is an error.
    """

    def signal_of(row: dict) -> pcm.Signal:
        return pcm.signal(row["content"], row["file_extension"], sr)

    rows = pcm.named_files(widen(files)).mapInArrow(_tracks(signal_of, sr, chunk, piece_chunks), _TRACK)
    return _finished(rows)


def extract_ranges(files: DataFrame, sr: int = S.SAMPLE_RATE, chunk: int = signals.CHUNK_SAMPLES, piece_chunks: int = PIECE_CHUNKS) -> DataFrame:
    """:func:`extract_files` of listed files (``path, length``) that tasks open themselves.

    A file of up to a piece's bytes (``piece_chunks`` chunks of 16-bit samples) is one task's work. A longer one is cut into pieces, of
    which tasks read the bytes they need; only moments leave them. Pieces that the loudest band of the whole file would have cut off elsewhere are
    read a second time. Results don't depend on the cuts.
    """
    spark = files.sparkSession
    piece = chunk * piece_chunks
    listed = pcm.attributes(files).select(*S.METADATA_COLUMNS, "path", "length")
    counts = listed.agg(F.count("*").alias("n"), F.sum(F.ceil(F.col("length") / (2 * piece))).alias("pieces"), F.max("length").alias("most")).head()
    spread = min(max(counts.pieces or 1, 1), max(4 * spark.sparkContext.defaultParallelism, (counts.pieces or 0) // 16))

    def signal_of(row: dict) -> pcm.Signal:
        with ranges.opened(row["path"]) as read:
            return pcm.signal(read(0, row["length"]), row["file_extension"], sr)

    short = listed.where(F.col("length") <= 2 * piece).repartition(spread).mapInArrow(_tracks(signal_of, sr, chunk, piece_chunks), _TRACK)
    if (counts.most or 0) <= 2 * piece:
        return _finished(short)

    found = materialise(ranges.probed(listed.where(F.col("length") > 2 * piece), sr))
    cut = ranges.with_pieces(found, sr, piece).repartition(spread)
    pieces = materialise_table(cut.mapInArrow(_pieces(sr, chunk), _PIECE))
    again = signals.to_cut_again(pieces, signals.MelSettings().floor_db, ("file_path", "start"))
    redone = cut.join(again, ["file_path", "start"]).repartition(spread).mapInArrow(_pieces(sr, chunk), _PIECE)
    redone = redone.select("file_path", "start", F.col("error").alias("new_error"), *signals.renamed("mfcc"))
    whole = pieces.join(redone, ["file_path", "start"], "left").select(
        "file_path", "start", F.coalesce("new_error", "error").alias("error"), *[c for c in pieces.columns if c.startswith("measures")], *signals.newer("mfcc")
    )
    faults = whole.groupBy("file_path").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("start"))).alias("fault"))
    stats = signals.statistics_of(whole.where("error is null"), _meter(chunk), "file_path")
    long = (
        found.join(faults, "file_path", "left")
        .withColumn("error", F.coalesce("error", "fault"))
        .withColumn("duration", F.when(F.col("error").isNull(), ranges.length_at(sr) / sr))
        .join(stats, "file_path", "left")
        .select(*S.METADATA_COLUMNS, "error", "duration", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in _STATISTICS])
    )
    return _finished(short.unionByName(long))


def _finished(rows: DataFrame) -> DataFrame:
    fixed = {n: F.when(F.col("error").isNull(), c) for n, c in signals.placeholder_columns().items()}
    return rows.withColumns(fixed).select(*S.FEATURE_COLUMNS, *S.METADATA_COLUMNS, "error")


#: The longest file that Spark reads as one value.
MAX_CONTENT = (1 << 31) - 1 - 15


def opens_files(spark: SparkSession, source: str, reader: str = "auto") -> bool:
    """Whether tasks open the files below ``source`` themselves. ``reader``: ``ranges`` (they do), ``content`` (Spark reads files
    whole; those of 2 GB and more are errors), or ``auto``, by the folder's scheme."""
    if reader not in ("auto", "ranges", "content"):
        raise ValueError(f"unknown reader: {reader}")
    return reader == "ranges" or reader == "auto" and ranges.scheme(spark, source) in ranges.OPENED


def extract_listed(files: DataFrame, ranged: bool, sr: int = S.SAMPLE_RATE, chunk: int = signals.CHUNK_SAMPLES) -> DataFrame:
    """Feature rows of scanned files: by :func:`extract_ranges` without touching ``content``, or by :func:`extract_files`."""
    if ranged:
        return extract_ranges(files.select("path", "length"), sr, chunk)
    large = pcm.attributes(files.where(F.col("length") > MAX_CONTENT)).select(
        *S.METADATA_COLUMNS, F.lit("too long to be read as one value").alias("error"), *[F.lit(None).cast("double").alias(c) for c in ("duration", *_STATISTICS)]
    )
    return extract_files(files.where(F.col("length") <= MAX_CONTENT), sr, chunk).unionByName(_finished(large))


def process_directory(
    spark: SparkSession,
    input_dir: str,
    output: str | None = None,
    force: bool = False,
    suffixes=S.AUDIO_SUFFIXES,
    sr: int = S.SAMPLE_RATE,
    reader: str = "auto",
    files_per_part: int | None = None,
) -> Extraction:
    """Extract the files of a folder that the table at ``output`` does not hold yet.

    New rows are appended; ``force`` recomputes and replaces everything. An existing
    table that cannot be read is an error: it is never silently overwritten.

    With ``output``, the run goes part by part (``files_per_part``; as many as keep every core busy for a while), and a finished
    part is kept beside the table (:mod:`~trackspark.sources.progress`) until all are done. A run that starts after one that was killed takes
    finished parts over and extracts the other files only.
    """
    ranged = opens_files(spark, input_dir, reader)
    walk = ranged and ranges.scheme(spark, input_dir) == "file"
    files = (catalog.walk_files if walk else catalog.scan_files)(spark, input_dir, suffixes)
    listed = files.withColumn("file_path", catalog.local_path("path"))
    names = listed.select("file_path")
    existing = None
    if output is not None and not force:
        try:
            existing = features.load_features(spark, output)
        except FileNotFoundError:
            pass
    if output is None:
        with releasing():
            extracted = extract_listed(files, ranged, sr)
            with keeping():
                rows = materialise(extracted)
            counts = _counts(rows)
        good, failed = _split(rows)
        return Extraction(good, failed, counts.new, 0, counts.errors)

    kept = progress.ProgressLog(spark, output, f"{input_dir}|{sr}|{','.join(suffixes)}")
    if force:
        kept.clear()
    skipped = 0 if existing is None else names.join(existing.select("file_path"), "file_path", "left_semi").count()
    done = kept.finished()
    if done is not None and existing is not None:
        done = incremental.pending(done, existing)  # killed between saving the table and clearing the log
    todo = incremental.pending(incremental.pending(names, existing), done)
    total = todo.count()
    size = files_per_part or S.SAVE_EVERY * spark.sparkContext.defaultParallelism
    parts = -(-total // size)
    for k in range(parts):
        mine = todo.where(F.pmod(F.xxhash64("file_path"), F.lit(parts)) == k)
        with releasing():
            part = listed.join(mine, "file_path", "left_semi").drop("file_path")
            kept.commit(extract_listed(part, ranged, sr))
            log.info("part %d of %d is done", k + 1, parts)
    done = kept.finished()
    if done is None:
        nothing = spark.createDataFrame([], T.StructType([*S.FEATURE_SCHEMA.fields, T.StructField("error", T.StringType())]))
        good, failed = _split(nothing)
        return Extraction(nothing.drop("error") if existing is None else existing, failed, 0, skipped, 0)
    if existing is not None:
        done = incremental.pending(done, existing)
    counts = _counts(done)
    good, failed = _split(done)
    failed = materialise(failed)  # the log goes
    if counts.new:
        if existing is None:
            features.save_features(good, output)
        else:
            features.append_features(good, output)
    kept.clear()
    log.info("new: %d, skipped: %d, errors: %d", counts.new, skipped, counts.errors)
    table = features.load_features(spark, output) if counts.new or existing is not None else good.limit(0)
    return Extraction(table, failed, counts.new, skipped, counts.errors)


def _counts(rows: DataFrame):
    return rows.agg(F.count_if(F.col("error").isNull()).alias("new"), F.count_if(F.col("error").isNotNull()).alias("errors")).head()


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col("error").isNotNull()
    return rows.where(~bad).drop("error"), rows.where(bad).select("file_path", "error")
