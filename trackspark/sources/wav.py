"""Layout and samples of uncompressed audio files, read at given positions."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

RAW_SUFFIXES = (".pcm", ".raw")
#: ``read(offset, size)`` returns that many bytes, fewer at the end of the file.
Read = Callable[[int, int], bytes]

# Fixed values of the file format: sample encodings, and the tag that moves the encoding into the extension.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
MAX_RATE = 10_000_000


@dataclass(frozen=True)
class Layout:
    """Where and how a file's samples are stored. ``frames`` counts samples per channel."""

    floating: bool
    width: int  # bytes a sample
    channels: int
    rate: int
    offset: int
    frames: int

    @property
    def step(self) -> int:
        """Bytes from one sample of a channel to its next."""
        return self.width * self.channels

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Position and size in bytes of samples ``a .. b-1``."""
        return self.offset + a * self.step, (b - a) * self.step

    def samples(self, data: bytes) -> np.ndarray:
        """Bytes of whole samples as one channel of float32 in [-1, 1): channels are averaged."""
        if self.floating:
            y = np.frombuffer(data, f"<f{self.width}").astype(np.float32)
        elif self.width == 1:  # unsigned
            y = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / np.float32(128)
        elif self.width == 2:
            y = np.frombuffer(data, "<i2").astype(np.float32) / np.float32(32768)
        elif self.width == 3:
            parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            whole = parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24
            y = (whole / 2.0**31).astype(np.float32)
        else:
            y = (np.frombuffer(data, "<i4") / 2.0**31).astype(np.float32)
        if self.channels > 1:
            y = y.reshape(-1, self.channels).mean(axis=1, dtype=np.float32)
        if self.floating and not np.isfinite(y).all():
            raise ValueError("samples that aren't finite")
        return y


def layout(read: Read, size: int, extension: str, raw_rate: int) -> Layout:
    """Layout of a file by its suffix and header. Only the header's chunks are read.

    Raw files are 16-bit samples of one channel at ``raw_rate``; an odd last byte is no sample. A file that ends before its header says
    has the samples that are there.
    """
    if extension in RAW_SUFFIXES:
        return _checked(Layout(False, 2, 1, raw_rate, 0, size // 2))
    if extension == ".wav":
        return _checked(_wav(read, size))
    raise ValueError(f"no decoder for {extension or 'files without suffix'}")


def _checked(found: Layout) -> Layout:
    if found.frames <= 0:
        raise ValueError("empty signal")
    return found


def _wav(read: Read, size: int) -> Layout:
    head = read(0, 12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64", b"BW64") or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, long_data, found = 12, None, None
    while at + 8 <= size:
        kind, n = struct.unpack("<4sI", read(at, 8))
        if kind == b"ds64":  # sizes beyond 32 bits
            long_data = struct.unpack("<Q", read(at + 16, 8))[0]
        elif kind == b"fmt ":
            found = _encoding(read(at + 8, min(n, 40)))
        elif kind == b"data":
            if found is None:
                raise ValueError("samples before their format")
            floating, width, channels, rate = found
            n = long_data if n == 0xFFFFFFFF and long_data is not None else n
            return Layout(floating, width, channels, rate, at + 8, min(n, size - at - 8) // (width * channels))
        at += 8 + n + n % 2
    raise ValueError("no samples in the WAV file")


def _encoding(body: bytes) -> tuple[bool, int, int, int]:
    if len(body) < 16:
        raise ValueError("incomplete WAV format")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
    if tag == EXTENSIBLE and len(body) >= 26:
        tag = struct.unpack("<H", body[24:26])[0]
    if (tag, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
        raise ValueError(f"encoding {tag} with {bits}-bit samples is not supported")
    if not channels:
        raise ValueError("no channels")
    if not 0 < rate <= MAX_RATE:
        raise ValueError(f"sample rate {rate}")
    return tag == FLOAT, bits // 8, channels, rate
