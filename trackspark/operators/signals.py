"""Frame measures of audio signals and their per-track statistics.

A track is a set of chunk rows ``track_id, sr, n_samples, start, lead, samples``: the
chunk owns the frames centred in ``[start, start + chunk)`` and carries the samples
around them (``lead`` is the position of its first sample), so every chunk is processed
alone and a long track spreads over many tasks. What leaves a task are mergeable moments
(:mod:`~trackspark.operators.moments`), a few numbers per chunk; rows per frame are made only where they are asked for.

Frames are centred: the signal is padded by half a frame on both sides, with zeros for
spectra and energy and with the edge sample for zero crossings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trackspark import schema as S
from trackspark.operators import moments
from trackspark.operators.skew import HOT_ROWS, hot_join
from trackspark.session import materialise, materialise_table

CHUNK_SAMPLES = 1 << 19  # about 12 s at 44.1 kHz; a multiple of both hops
_BLOCK_FRAMES = 64  # frames transformed at once inside a task: stays in the CPU cache
_BATCH_FRAMES = 8192  # frames that leave a task together
_TINY = float(np.finfo(np.float32).tiny)

CHUNK_FIELDS = "sr int, n_samples bigint, start bigint, lead bigint, samples array<float>"


@dataclass(frozen=True)
class Grid:
    """Frame length and hop, in samples."""

    frame: int = S.DEFAULT_FRAME
    hop: int = S.DEFAULT_HOP


@dataclass(frozen=True)
class MelSettings:
    frame: int = S.N_FFT
    hop: int = S.HOP_LENGTH
    n_mels: int = S.N_MELS
    fmin: float = S.MEL_FMIN
    fmax: float = S.MEL_FMAX
    n_mfcc: int = S.N_MFCC
    floor_db: float = 80.0


def chunk_signals(
    signals: DataFrame,
    pad: int = S.N_FFT // 2,
    chunk: int = CHUNK_SAMPLES,
    track: str = "track_id",
) -> DataFrame:
    """Cut ``track_id, sr, samples`` into chunk rows with ``pad`` samples of overlap."""
    n = F.size("samples").cast("bigint")
    starts = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_samples") / chunk)), lambda c: c * chunk
    )
    lead = F.greatest(F.col("start") - pad, F.lit(0))
    stop = F.least(F.col("start") + chunk + pad, F.col("n_samples"))
    return (
        signals.where(n > 0)
        .select(track, F.col("sr").cast("int").alias("sr"), n.alias("n_samples"), "samples")
        .withColumn("start", F.explode(starts))
        .withColumn("lead", lead)
        .select(
            track,
            "sr",
            "n_samples",
            "start",
            "lead",
            F.slice("samples", (F.col("lead") + 1).cast("int"), (stop - F.col("lead")).cast("int"))
            .cast("array<float>")
            .alias("samples"),
        )
    )


# --- inside tasks -----------------------------------------------------------


def _padded(samples, n, start, lead, grid, chunk, edge: bool):
    """Samples under the frames of a chunk, with the first frame's number and their count."""
    half = grid.frame // 2
    first = -(-start // grid.hop)
    last = min((start + chunk - 1) // grid.hop, n // grid.hop)
    if last < first:
        return np.zeros(0), first, 0
    lo, hi = first * grid.hop - half, last * grid.hop + half
    a, b = max(lo, 0), min(hi, n)
    body = samples[a - lead : b - lead].astype(np.float64)
    before, after = a - lo, hi - b
    if before or after:
        body = np.pad(body, (before, after), mode="edge" if edge and len(body) else "constant")
    return body, first, last - first + 1


def _views(padded: np.ndarray, grid: Grid) -> np.ndarray:
    if len(padded) < grid.frame:
        return np.zeros((0, grid.frame))
    return np.lib.stride_tricks.sliding_window_view(padded, grid.frame)[:: grid.hop]


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _zero_crossings(padded: np.ndarray, count: int, grid: Grid) -> np.ndarray:
    """Share of samples per frame whose sign differs from the sample before."""
    negative = padded < -1e-10
    turns = np.concatenate([[0], np.cumsum(negative[1:] != negative[:-1])])
    at = np.arange(count) * grid.hop
    return (turns[at + grid.frame - 1] - turns[at]) / grid.frame


def _centroid_bandwidth(frames: np.ndarray, sr: int, window: np.ndarray):
    spec = np.fft.rfft(frames * window, axis=1)
    mag = np.sqrt(spec.real**2 + spec.imag**2)
    freq = np.fft.rfftfreq(frames.shape[1], 1.0 / sr)
    total, first, second = (mag @ np.stack([np.ones_like(freq), freq, freq**2], axis=1)).T
    total = np.where(total < _TINY, 1.0, total)
    centroid = first / total
    return centroid, np.sqrt(np.maximum(second / total - centroid**2, 0.0))


def mel_matrix(sr: int, m: MelSettings) -> np.ndarray:
    """Triangular filters, equally spaced on the HTK mel scale, with equal area."""
    to_mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    mels = np.linspace(to_mel(m.fmin), to_mel(m.fmax), m.n_mels + 2)
    hz = 700.0 * (10.0 ** (mels / 2595.0) - 1.0)
    freq = np.fft.rfftfreq(m.frame, 1.0 / sr)
    rise = (freq[None, :] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    fall = (hz[2:, None] - freq[None, :]) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(rise, fall)) * (2.0 / (hz[2:] - hz[:-2]))[:, None]


class MelBands:
    """The filters of :func:`mel_matrix`, applied without its zeros: a frequency lies under the falling side of one filter
    and the rising side of the next."""

    def __init__(self, sr: int, m: MelSettings):
        bank = mel_matrix(sr, m)
        held = np.flatnonzero(bank.any(axis=0))
        self.low, self.high = (int(held[0]), int(held[-1]) + 1) if len(held) else (0, 0)
        to_mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
        hz = 700.0 * (10.0 ** (np.linspace(to_mel(m.fmin), to_mel(m.fmax), m.n_mels + 2) / 2595.0) - 1.0)
        freq = np.fft.rfftfreq(m.frame, 1.0 / sr)[self.low : self.high]
        at = np.clip(np.searchsorted(hz, freq, side="right") - 1, 0, m.n_mels)  # between corners at and at + 1
        bins, cols = np.arange(self.low, self.high), len(bank)
        self.rising = np.where(at < cols, bank[np.minimum(at, cols - 1), bins], 0.0)
        self.falling = np.where(at > 0, bank[np.maximum(at - 1, 0), bins], 0.0)
        self.starts = np.flatnonzero(np.diff(at, prepend=-1))
        self.segments = at[self.starts]
        self.n = m.n_mels

    def power(self, spec: np.ndarray) -> np.ndarray:
        spec = spec[:, self.low : self.high]
        square = spec.real**2 + spec.imag**2
        out = np.zeros((len(spec), self.n + 1))
        if len(self.starts) == 0:
            return out[:, : self.n]
        rising = np.add.reduceat(square * self.rising, self.starts, axis=1)
        falling = np.add.reduceat(square * self.falling, self.starts, axis=1)
        out[:, self.segments] = rising
        inner = self.segments > 0
        out[:, self.segments[inner] - 1] += falling[:, inner]
        return out[:, : self.n]


def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    out = np.cos(np.pi * k * (2 * i + 1) / (2 * n_in)) * np.sqrt(2.0 / n_in)
    out[0] /= np.sqrt(2.0)
    return out


def _chunk_rows(batch: pa.RecordBatch, track: str):
    samples = batch.column("samples")
    flat = samples.flatten().to_numpy(zero_copy_only=False)
    offsets = samples.offsets.to_numpy() - samples.offsets[0].as_py()
    cols = [batch.column(c).to_pylist() for c in ("sr", "n_samples", "start", "lead")]
    for i, (sr, n, start, lead) in enumerate(zip(*cols)):
        yield i, sr, n, start, lead, flat[offsets[i] : offsets[i + 1]]


def packed(m: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values: they cross into the JVM as one copy each."""
    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * (8 * m.shape[1]))
    data = pa.py_buffer(np.ascontiguousarray(m, "<f8"))
    return pa.Array.from_buffers(pa.binary(), len(m), [None, offsets.buffers()[1], data])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Inverse of :func:`packed`."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def _blocks(frames: np.ndarray):
    for a in range(0, len(frames), _BLOCK_FRAMES):
        yield frames[a : a + _BLOCK_FRAMES]


def _per_frame(compute, names: Sequence[str], track: str):
    """Task body: chunk rows in, one row per frame out.

    ``compute(sr, n, start, lead, samples)`` returns the number of the first frame and
    the named columns. Rows of many short chunks leave the task together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held, size = b.column(track), [], 0

            def flush():
                rows = np.concatenate([np.full(c, i) for i, _, c, _ in held])
                numbers = np.concatenate([np.arange(f, f + c) for _, f, c, _ in held])
                columns = [
                    pa.concat_arrays([h[3][j] for h in held]) if isinstance(held[0][3][j], pa.Array)
                    else pa.array(np.concatenate([h[3][j] for h in held]))
                    for j in range(len(names))
                ]
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(numbers), *columns], [track, "frame_no", *names]
                )

            for i, sr, n, start, lead, y in _chunk_rows(b, track):
                first, columns = compute(sr, n, start, lead, y)
                count = len(columns[0])
                if count:
                    held.append((i, first, count, columns))
                    size += count
                if size >= _BATCH_FRAMES:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    return run


def measures_task(grid: Grid, chunk: int, measures: Sequence[str], track: str):
    """Task body computing the asked frame measures of chunk rows."""
    window = _hann(grid.frame)
    spectral = "spectral_centroid" in measures or "spectral_bandwidth" in measures

    def compute(sr, n, start, lead, y):
        padded, first, count = _padded(y, n, start, lead, grid, chunk, edge=False)
        frames, got = _views(padded, grid), {}
        if "rms" in measures:
            got["rms"] = np.sqrt(np.einsum("ij,ij->i", frames, frames) / grid.frame)
        if "zero_crossing_rate" in measures:
            edged = _padded(y, n, start, lead, grid, chunk, edge=True)[0]
            got["zero_crossing_rate"] = _zero_crossings(edged, count, grid) if count else np.zeros(0)
        if spectral:
            parts = [_centroid_bandwidth(f, sr, window) for f in _blocks(frames)]
            for j, m in enumerate(("spectral_centroid", "spectral_bandwidth")):
                got[m] = np.concatenate([p[j] for p in parts] or [np.zeros(0)])
        return first, [got[m] for m in measures]

    return _per_frame(compute, measures, track)


class Meter:
    """Measures pieces of tracks inside a task; what comes out are moments, never frames."""

    def __init__(self, grid: Grid, mel: MelSettings | None, chunk: int, measures: Sequence[str]):
        self.grid, self.mel, self.chunk, self.measures = grid, mel, chunk, tuple(measures)
        self.window = _hann(grid.frame)
        self.filters: dict[int, MelBands] = {}
        if mel is not None:
            self.mel_grid, self.mel_window = Grid(mel.frame, mel.hop), _hann(mel.frame)
            self.dct = dct_matrix(mel.n_mfcc, mel.n_mels).T

    def frames(self, sr: int, n: int, start: int, lead: int, y: np.ndarray) -> tuple[int, np.ndarray]:
        """First frame's number, and the measures as columns, of a chunk's own frames."""
        got: dict[str, np.ndarray] = {}
        padded, first, count = _padded(y, n, start, lead, self.grid, self.chunk, edge=False)
        frames = _views(padded, self.grid)
        if "rms" in self.measures:
            got["rms"] = np.sqrt(np.einsum("ij,ij->i", frames, frames) / self.grid.frame)
        if "zero_crossing_rate" in self.measures:
            edged = _padded(y, n, start, lead, self.grid, self.chunk, edge=True)[0]
            got["zero_crossing_rate"] = _zero_crossings(edged, count, self.grid) if count else np.zeros(0)
        if "spectral_centroid" in self.measures or "spectral_bandwidth" in self.measures:
            parts = [_centroid_bandwidth(f, sr, self.window) for f in _blocks(frames)]
            for j, m in enumerate(("spectral_centroid", "spectral_bandwidth")):
                got[m] = np.concatenate([p[j] for p in parts] or [np.zeros(0)])
        return first, np.stack([got[m] for m in self.measures], axis=1) if self.measures else np.zeros((count, 0))

    def bands(self, sr: int, n: int, start: int, lead: int, y: np.ndarray) -> tuple[int, np.ndarray]:
        """First frame's number, and the decibel mel bands, of a chunk's own frames."""
        bank = self.filters.get(sr) or self.filters.setdefault(sr, MelBands(sr, self.mel))
        padded, first, _ = _padded(y, n, start, lead, self.mel_grid, self.chunk, edge=False)
        parts = [
            10.0 * np.log10(np.maximum(bank.power(np.fft.rfft(f * self.mel_window, axis=1)), 1e-10))
            for f in _blocks(_views(padded, self.mel_grid))
        ]
        return first, np.concatenate(parts) if parts else np.zeros((0, self.mel.n_mels))

    def piece(self, chunks: Iterable[tuple[int, int, np.ndarray]], n: int, sr: int, peak: float | None = None) -> Piece:
        """Moments of consecutive chunks ``start, lead, samples`` of a track of ``n`` samples.

        Bands are cut off below ``peak`` or, where that isn't known yet, below the loudest band of the piece.
        """
        measured, bands = [], []
        for start, lead, y in chunks:
            if peak is None:
                measured.append(moments.of(self.frames(sr, n, start, lead, y)[1]))
            if self.mel is not None:
                bands.append(self.bands(sr, n, start, lead, y)[1])
        width = 0 if self.mel is None else self.mel.n_mfcc
        bands = [b for b in bands if len(b)]
        own = max((float(b.max()) for b in bands), default=None)
        low = min((float(b.min()) for b in bands), default=None)
        floor = None if own is None else (own if peak is None else peak) - self.mel.floor_db
        return Piece(
            moments.merged(measured or [moments.of(np.zeros((0, len(self.measures))))]),
            moments.merged([moments.of(np.maximum(b, floor) @ self.dct) for b in bands] or [moments.of(np.zeros((0, width)))]),
            own,
            low,
        )

    def whole(self, signal, sr: int, pad: int, piece_chunks: int) -> tuple[moments.Moments, moments.Moments]:
        """Moments of a track's measures and coefficients. ``signal`` has ``n`` and ``chunks(pad, chunk, start, stop)``.

        Pieces bound the memory; those that the track's loudest band would have cut elsewhere are gone over again.
        """
        step = self.chunk * piece_chunks
        spans = [(a, min(a + step, signal.n + 1)) for a in range(0, signal.n + 1, step)]
        pieces = [self.piece(signal.chunks(pad, self.chunk, *s), signal.n, sr) for s in spans]
        peak = max((p.peak for p in pieces if p.peak is not None), default=None)
        coefficients = [
            p.coefficients if self.mel is None or p.holds(peak, self.mel.floor_db) else self.piece(signal.chunks(pad, self.chunk, *s), signal.n, sr, peak).coefficients
            for s, p in zip(spans, pieces)
        ]
        return moments.merged([p.measures for p in pieces]), moments.merged(coefficients)


@dataclass(frozen=True)
class Piece:
    """Moments of a piece's measures and coefficients, its loudest and its weakest band."""

    measures: moments.Moments
    coefficients: moments.Moments
    peak: float | None
    low: float | None

    def holds(self, peak: float | None, floor_db: float) -> bool:
        """Whether bands were cut off as the whole track's loudest band demands."""
        return self.peak is None or self.peak == peak or self.low >= peak - floor_db


def measures_task(grid: Grid, chunk: int, measures: Sequence[str], track: str):
    """Task body computing the asked frame measures of chunk rows."""
    meter = Meter(grid, None, chunk, measures)

    def compute(sr, n, start, lead, y):
        first, values = meter.frames(sr, n, start, lead, y)
        return first, list(values.T.copy())

    return _per_frame(compute, measures, track)


def bands_task(mel: MelSettings, chunk: int, track: str):
    """Task body computing decibel mel bands of chunk rows."""
    meter = Meter(Grid(), mel, chunk, ())

    def compute(sr, n, start, lead, y):
        first, db = meter.bands(sr, n, start, lead, y)
        return first, [packed(db), db.max(axis=1) if len(db) else np.zeros(0)]

    return _per_frame(compute, ("bands", "peak"), track)


# --- frames and statistics --------------------------------------------------


def frame_measures(
    chunks: DataFrame,
    grid: Grid = Grid(),
    chunk: int = CHUNK_SAMPLES,
    measures: Sequence[str] = S.FRAME_MEASURES,
    track: str = "track_id",
) -> DataFrame:
    """One row per frame: ``track_id, frame_no`` and the asked measures."""
    out = T.StructType(
        [chunks.schema[track], T.StructField("frame_no", T.LongType())]
        + [T.StructField(m, T.DoubleType()) for m in measures]
    )
    return chunks.mapInArrow(measures_task(grid, chunk, tuple(measures), track), out)


def track_statistics(frames: DataFrame, measures: Sequence[str], track: str = "track_id") -> DataFrame:
    """``<measure>_mean`` and ``<measure>_std`` (population) per track."""
    aggs = []
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return frames.groupBy(track).agg(*aggs)


def mel_frames(
    chunks: DataFrame,
    mel: MelSettings = MelSettings(),
    chunk: int = CHUNK_SAMPLES,
    track: str = "track_id",
) -> DataFrame:
    """One row per frame: decibel mel bands (:func:`packed`), and the
    loudest of them as ``peak``."""
    out = T.StructType(
        [
            chunks.schema[track],
            T.StructField("frame_no", T.LongType()),
            T.StructField("bands", T.BinaryType()),
            T.StructField("peak", T.DoubleType()),
        ]
    )
    return chunks.mapInArrow(bands_task(mel, chunk, track), out)


def mfcc_of_bands(
    bands: DataFrame,
    mel: MelSettings = MelSettings(),
    track: str = "track_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per frame with ``mfcc_1 .. mfcc_n``.

    Bands are cut off ``floor_db`` below the loudest band of the whole track. The band
    rows are read for that maximum and for the transform: pass rows that are kept.
    """
    floors = bands.groupBy(track).agg((F.max("peak") - mel.floor_db).alias("floor"))
    names = [f"mfcc_{i}" for i in range(1, mel.n_mfcc + 1)]
    dct = dct_matrix(mel.n_mfcc, mel.n_mels).T

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            db = unpacked(b.column("bands"), mel.n_mels)
            floor = b.column("floor").to_numpy(zero_copy_only=False)
            c = np.maximum(db, floor[:, None]) @ dct
            yield pa.RecordBatch.from_arrays(
                [b.column(track), b.column("frame_no"), *[pa.array(c[:, i]) for i in range(mel.n_mfcc)]],
                [track, "frame_no", *names],
            )

    out = T.StructType(
        [bands.schema[track], bands.schema["frame_no"]]
        + [T.StructField(m, T.DoubleType()) for m in names]
    )
    with_floor = hot_join(
        bands.select(track, "frame_no", "bands"), floors, track, F.col("frame_no"), hot_rows=hot_rows
    )
    return with_floor.select(track, "frame_no", "bands", "floor").mapInArrow(transform, out)


def mfcc_frames(
    chunks: DataFrame,
    mel: MelSettings = MelSettings(),
    chunk: int = CHUNK_SAMPLES,
    track: str = "track_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """:func:`mfcc_of_bands` of chunk rows; the bands are kept so that the samples take
    the Fourier transform only once."""
    return mfcc_of_bands(materialise(mel_frames(chunks, mel, chunk, track)), mel, track, hot_rows)


def placeholder_columns() -> dict[str, Column]:
    """Constant columns that keep the table layout complete."""
    return {name: F.lit(value) for name, value in S.PLACEHOLDERS.items()}


PIECE_FIELDS = [*moments.fields(("measures", "mfcc")), T.StructField("peak", T.DoubleType()), T.StructField("low", T.DoubleType())]


def mfcc_names(mel: MelSettings) -> list[str]:
    return [f"mfcc_{i}" for i in range(1, mel.n_mfcc + 1)]


def chunk_moments(chunks: DataFrame, meter: Meter, track: str) -> DataFrame:
    """``track, start`` and the moments of each chunk row; a column ``loudest``, if there is one, is the track's known peak."""
    known = "loudest" in chunks.columns
    out = T.StructType([chunks.schema[track], T.StructField("start", T.LongType()), *PIECE_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            peaks = b.column("loudest").to_pylist() if known else [None] * b.num_rows
            rows = []
            for i, sr, n, start, lead, y in _chunk_rows(b, track):
                p = meter.piece([(start, lead, y)], n, sr, peaks[i])
                rows.append((start, *moments.packed(p.measures), *moments.packed(p.coefficients), p.peak, p.low))
            kinds = [pa.int64(), *[pa.int64(), pa.binary(), pa.binary()] * 2, pa.float64(), pa.float64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(track), *columns], names=out.names)

    return chunks.mapInArrow(run, out)


def to_cut_again(pieces: DataFrame, floor_db: float, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``loudest`` of pieces whose bands were cut off at another level than their track's loudest band demands.

    The first of ``keys`` is the track. Pieces are few numbers per megabyte of samples.
    """
    peaks = pieces.groupBy(keys[0]).agg(F.max("peak").alias("loudest"))
    wrong = (F.col("peak") < F.col("loudest")) & (F.col("low") < F.col("loudest") - floor_db)
    return pieces.join(peaks, keys[0]).where(wrong).select(*keys, "loudest")


def statistics_of(pieces: DataFrame, meter: Meter, track: str) -> DataFrame:
    """``<measure>_mean`` and ``<measure>_std`` (population) per track, of pieces with moments."""
    coefficients = [] if meter.mel is None else mfcc_names(meter.mel)
    sets = {"measures": meter.measures, "mfcc": coefficients}
    sets = {k: v for k, v in sets.items() if v}
    return moments.merge_by(pieces, track, {k: len(v) for k, v in sets.items()}, sets)


def track_moments(
    chunks: DataFrame,
    measures: Sequence[str] = S.FRAME_MEASURES,
    grid: Grid = Grid(),
    mel: MelSettings | None = None,
    chunk: int = CHUNK_SAMPLES,
    track: str = "track_id",
) -> DataFrame:
    """Means and population deviations per track of the asked measures and, with ``mel``, of the coefficients.

    A row per chunk leaves the tasks. With ``mel`` the rows are kept: chunks whose bands the track's loudest one
    cuts off elsewhere than their own does are gone over a second time, knowing it.
    """
    meter = Meter(grid, mel, chunk, measures)
    pieces = chunk_moments(chunks, meter, track)
    if mel is not None:
        pieces = materialise_table(pieces)
        again = to_cut_again(pieces, mel.floor_db, (track, "start"))
        redone = chunk_moments(chunks.join(again, [track, "start"]), meter, track).select(track, "start", *renamed("mfcc"))
        pieces = pieces.join(redone, [track, "start"], "left").select(track, "start", *[c for c in pieces.columns if c.startswith("measures")], *newer("mfcc"))
    return statistics_of(pieces, meter, track)


def renamed(name: str) -> list[Column]:
    return [F.col(f"{name}_{x}").alias(f"new_{x}") for x in ("n", "mean", "m2")]


def newer(name: str) -> list[Column]:
    return [F.coalesce(f"new_{x}", f"{name}_{x}").alias(f"{name}_{x}") for x in ("n", "mean", "m2")]


def track_features(
    chunks: DataFrame,
    grid: Grid = Grid(),
    mel: MelSettings = MelSettings(),
    chunk: int = CHUNK_SAMPLES,
    track: str = "track_id",
) -> DataFrame:
    """One row per track with all numeric features, in table order."""
    durations = chunks.groupBy(track).agg(F.max(F.col("n_samples") / F.col("sr")).alias("duration"))
    stats = track_moments(chunks, S.FRAME_MEASURES, grid, mel, chunk, track)
    rows = durations.join(stats, track).withColumns(placeholder_columns())
    order = (
        ["duration"]
        + [f"{m}_{s}" for m in S.FRAME_MEASURES for s in ("mean", "std")]
        + [f"{m}_{s}" for m in mfcc_names(mel) for s in ("mean", "std")]
        + list(S.PLACEHOLDERS)
    )
    return rows.select(track, *order)
