"""Band-limited change of the sample rate.

Every output sample is the same weighted sum of its surroundings wherever the signal was cut, so pieces of a signal are resampled on
their own, given enough source samples around them, and put together to exactly the whole signal's result.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, gcd

import numpy as np

ZEROS = 32  # zero crossings of the kernel on each side
ROLLOFF = 0.95  # pass band, as a part of the lower of both Nyquist frequencies
BETA = 10.0  # of the Kaiser window: about 100 dB of stop band
_TABLE = 1 << 22  # weights that are tabulated; ratios with more of them compute theirs as they go
_BLOCK = 4096


class Resampler:
    """From ``source`` to ``target`` samples a second, by a polyphase filter."""

    def __init__(self, source: int, target: int):
        if source <= 0 or target <= 0:
            raise ValueError(f"sample rate {source}")
        self.up, self.down = target // gcd(source, target), source // gcd(source, target)
        self.cut = min(1.0, self.up / self.down) * ROLLOFF
        self.half = ceil(ZEROS / self.cut)
        self.taps = 2 * self.half
        self.table = self._weights(np.arange(self.up)) if self.up * self.taps <= _TABLE else None

    def _weights(self, phase: np.ndarray) -> np.ndarray:
        """A row of weights per phase, for source samples ``floor - half + 1 .. floor + half``; rows sum to 1."""
        t = (phase / self.up)[:, None] + (self.half - 1 - np.arange(self.taps))
        inside = np.clip(1.0 - (t / self.half) ** 2, 0.0, None)
        w = np.sinc(self.cut * t) * np.i0(BETA * np.sqrt(inside)) * (np.abs(t) < self.half)
        return w / w.sum(axis=1, keepdims=True)

    def length(self, n: int) -> int:
        """Output samples of ``n`` source samples."""
        return -(-n * self.up // self.down)

    def span(self, a: int, b: int, n: int) -> tuple[int, int]:
        """The source samples that outputs ``a .. b-1`` rest on."""
        if self.up == self.down:
            return max(a, 0), min(b, n)
        first, last = a * self.down // self.up, (b - 1) * self.down // self.up
        return max(first - self.half + 1, 0), min(last + self.half + 1, n)

    def apply(self, x: np.ndarray, lead: int, a: int, b: int) -> np.ndarray:
        """Outputs ``a .. b-1``; ``x`` holds source samples from ``lead`` on, at least their :meth:`span`."""
        if self.up == self.down:
            return x[a - lead : b - lead]
        out = np.empty(b - a, dtype=np.float32)
        for i in range(a, b, _BLOCK):
            at = np.arange(i, min(i + _BLOCK, b), dtype=np.int64) * self.down
            first = at // self.up - self.half + 1 - lead
            lo, hi = int(first[0]), int(first[-1]) + self.taps
            part = np.zeros(hi - lo)
            s, t = max(lo, 0), min(hi, len(x))
            if t > s:
                part[s - lo : t - lo] = x[s:t]
            phase = at % self.up
            weights = self._weights(phase) if self.table is None else self.table[phase]
            windows = np.lib.stride_tricks.sliding_window_view(part, self.taps)[first - lo]
            out[i - a : i - a + len(at)] = np.einsum("ij,ij->i", windows, weights)
        return out


@lru_cache(maxsize=16)
def resampler(source: int, target: int) -> Resampler:
    return Resampler(source, target)
