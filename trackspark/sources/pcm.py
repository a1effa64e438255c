"""Decoding uncompressed audio files into chunk rows at one sample rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackspark import schema as S
from trackspark.functions.paths import base_name, local_path, size_mib, suffix
from trackspark.operators.resample import resampler
from trackspark.operators.signals import CHUNK_SAMPLES
from trackspark.sources.wav import RAW_SUFFIXES, Layout, Read, layout  # noqa: F401

_BATCH_SAMPLES, _BATCH_ROWS = 1 << 21, 10_000  # a batch leaves the task at either size

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_extension", T.StringType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("sr", T.IntegerType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("lead", T.LongType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
    ]
)


def pcm16(content: bytes) -> np.ndarray:
    """Little-endian 16-bit samples as float32 in [-1, 1)."""
    return np.frombuffer(content, dtype="<i2").astype(np.float32) / np.float32(S.PCM_SCALE)


class Signal:
    """A file's samples at the rate ``sr``, read piece by piece."""

    def __init__(self, read: Read, found: Layout, sr: int):
        self.read, self.layout = read, found
        self.resampler = resampler(found.rate, sr)
        self.n = self.resampler.length(found.frames)

    def samples(self, a: int, b: int) -> np.ndarray:
        """Samples ``a .. b-1``: only the bytes they rest on are read."""
        s, t = self.resampler.span(a, b, self.layout.frames)
        return self.resampler.apply(self.layout.samples(self.read(*self.layout.span(s, t))), s, a, b)

    def chunks(self, pad: int, chunk: int, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """``start, lead, samples`` of the chunks from ``start`` up to ``stop`` (whole signal: with the frame at its end)."""
        for a in range(start, self.n + 1 if stop is None else stop, chunk):
            lead = max(a - pad, 0)
            yield a, lead, self.samples(lead, max(min(a + chunk + pad, self.n), lead))


def reader(content: bytes) -> Read:
    """Positioned reading of bytes that are at hand."""
    view = memoryview(content)
    return lambda offset, size: bytes(view[offset : offset + size])


def signal(content: bytes | None, extension: str, sr: int) -> Signal:
    """The signal of a whole file's bytes."""
    if content is None:
        raise ValueError("no content")
    read = reader(content)
    return Signal(read, layout(read, len(content), extension, sr), sr)


ATTRIBUTES = ("file_path", "file_name", "file_extension", "file_size_mb")


def attributes(files: DataFrame) -> DataFrame:
    """Listed files with their attributes beside the columns they come with."""
    p = local_path("path")
    return files.select("*", p.alias("file_path"), base_name(p).alias("file_name"), suffix(p).alias("file_extension"), size_mib("length").alias("file_size_mb"))


def named_files(files: DataFrame) -> DataFrame:
    """File attributes and ``content`` of listed files (``path, length, content``)."""
    return attributes(files).select(*ATTRIBUTES, "content")


def decode_task(sr: int, pad: int, chunk: int):
    """Task body: named files in, chunk rows out.

    A file that cannot be decoded yields one row with ``error`` and no samples, so that
    it fails alone. A file leaves its task in batches of chunks.
    """
    arrow = to_arrow_schema(CHUNK_SCHEMA)

    def batch(rows, arrays):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
        sizes = [0 if y is None else len(y) for y in arrays]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        flat = np.concatenate([y for y in arrays if y is not None] or [np.zeros(0, np.float32)])
        missing = pa.array([y is None for y in arrays])
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat), mask=missing))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, arrays, held = [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                attrs = [b.column(a)[i].as_py() for a in ATTRIBUTES]
                try:
                    found = signal(b.column("content")[i].as_py(), attrs[2], sr)
                    parts = list(found.chunks(pad, chunk))
                except Exception as e:  # any fault of this file stays with this file
                    rows.append((*attrs, str(e) or type(e).__name__, None, None, None, None))
                    arrays.append(None)
                    continue
                for start, lead, part in parts:
                    rows.append((*attrs, None, sr, found.n, start, lead))
                    arrays.append(part)
                    held += len(part)
                    if held >= _BATCH_SAMPLES or len(rows) >= _BATCH_ROWS:
                        yield batch(rows, arrays)
                        rows, arrays, held = [], [], 0
        if rows:
            yield batch(rows, arrays)

    return decode


def decode_files(
    files: DataFrame,
    sr: int = S.SAMPLE_RATE,
    pad: int = S.N_FFT // 2,
    chunk: int = CHUNK_SAMPLES,
) -> DataFrame:
    """Chunk rows of listed files (``path, length, content``), failures included."""
    return named_files(files).mapInArrow(decode_task(sr, pad, chunk), CHUNK_SCHEMA)
