"""Number-theoretic transforms of many columns at once, in exact integers modulo a prime.

Arrays are ``(size, columns)``, so every step works on long contiguous rows. Products are reduced by Montgomery's
method; values are kept below a small multiple of the prime and reduced only where the next step needs it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: A prime 7 * 2^26 + 1: transforms of up to 2^26 items.
PRIME = 469762049
_GENERATOR = 3
_U = np.uint64
_P, _INV, _LOW, _SHIFT = _U(PRIME), _U(-pow(PRIME, -1, 1 << 32) % (1 << 32)), _U(0xFFFFFFFF), _U(32)
_R = (1 << 32) % PRIME
_NARROW = 64  # fewer columns than this are turned so that rows stay long


def redc(x: np.ndarray) -> np.ndarray:
    """``x / 2^32`` modulo the prime, below twice the prime, for ``x`` below the prime times 2^32."""
    t = x * _INV
    t &= _LOW
    t *= _P
    t += x
    t >>= _SHIFT
    return t


def lessen(x: np.ndarray) -> np.ndarray:
    """The same residues, below 2.2 times the prime, for ``x`` below 2^32; in place."""
    x -= (x >> _U(29)) * _P
    return x


@lru_cache(maxsize=128)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers of the root of unity of order ``2 * half``, times 2^32."""
    w = pow(_GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out, step = np.array([1], dtype=_U), w
    while len(out) < half:  # doubles: out, out * w^len
        out = np.concatenate([out, out * _U(step) % _P])
        step = step * step % PRIME
    return out * _U(_R) % _P


def _spread(half: int, columns: int, inverse: bool) -> np.ndarray:
    roots = _roots(half, inverse)
    return roots if columns == 1 else np.repeat(roots, columns)


def forward_padded(block: np.ndarray) -> np.ndarray:
    """Transforms, of twice the length, of columns followed by zeros; bit-reversed order, below 3 primes."""
    n, m = block.shape
    out = np.empty((2 * n, m), dtype=_U)
    out[:n] = block
    out[n:] = redc(block.reshape(-1) * _spread(n, m, False)).reshape(n, m)
    _fall(out, n)
    return out


def _fall(a: np.ndarray, size: int) -> None:
    """Decimation in frequency of every stretch of ``size`` rows, in place."""
    m, half = a.shape[1], size // 2
    while half:
        if m < _NARROW and half < _NARROW <= a.shape[0] // 2:
            turned = np.ascontiguousarray(a.reshape(-1, 2 * half, m).transpose(1, 0, 2)).reshape(2 * half, -1)
            _fall(turned, 2 * half)
            a[:] = turned.reshape(2 * half, -1, m).transpose(1, 0, 2).reshape(a.shape)
            return
        v = a.reshape(-1, 2, half * m)
        less = v[:, 0] + _U(3 * PRIME)
        less -= v[:, 1]
        v[:, 0] += v[:, 1]
        lessen(v[:, 0])
        less *= _spread(half, m, False)
        v[:, 1] = redc(less)
        half //= 2


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse transform of bit-reversed columns below 2 primes, times the size; in place, below 9 primes."""
    n, m = a.shape
    _rise(a, 1, n)
    return a


def _rise(a: np.ndarray, half: int, size: int) -> None:
    m, bound = a.shape[1], 3
    while half < size:
        if m < _NARROW and half < _NARROW <= size // 2:
            part = _NARROW
            turned = np.ascontiguousarray(a.reshape(-1, part, m).transpose(1, 0, 2)).reshape(part, -1)
            _rise(turned, half, part)
            a[:] = lessen(turned).reshape(part, -1, m).transpose(1, 0, 2).reshape(a.shape)
            half, bound = part, 3
            continue
        if bound > 7:
            lessen(a.reshape(-1))
            bound = 3
        v = a.reshape(-1, 2, half * m)
        t = redc(v[:, 1] * _spread(half, m, True))
        np.subtract(v[:, 0] + _U(2 * PRIME), t, out=v[:, 1])
        v[:, 0] += t
        half, bound = 2 * half, bound + 2


def negated(a: np.ndarray):
    """Pairs of slices of bit-reversed rows: ``(rows, the rows of the opposite frequencies)``."""
    yield slice(0, 1), slice(0, 1)
    low = 1
    while low < a.shape[0]:
        yield slice(low, 2 * low), slice(2 * low - 1, low - 1 if low else None, -1)
        low *= 2


def double_correlation(blocks: np.ndarray) -> np.ndarray:
    """Twice the sum of ``blocks[i, j] * following[i + d, j]`` over ``i``, over 2^64, modulo the prime, as ``(d, j)``.

    ``following`` is what comes after block ``j``: columns ``j + 1`` and ``j + 2``. Entries are below the prime. The result has two
    columns fewer, as many rows as a block, and is below twice the prime. (Applying :func:`redc` twice divides by 2^64 too.)
    """
    n, m = blocks.shape
    f = lessen(forward_padded(blocks).reshape(-1)).reshape(2 * n, m)
    after = f[:, 1:-1].copy()
    after[:n] += f[:n, 2:]
    after[n:] += _U(3 * PRIME)
    after[n:] -= f[n:, 2:]
    lessen(after)
    product = np.empty_like(after)
    for rows, opposite in negated(f):
        product[rows] = redc(after[rows] * f[opposite, :-2])
    inverse(product)
    scale = 2 * pow(2 * n, -1, PRIME) % PRIME
    return redc(lessen(product[:n].copy()) * _U(scale))
