"""Singular values and right singular vectors of a small square matrix through its bidiagonal form.

Householder reflections make the matrix bidiagonal, differential qd sweeps with shifts find the singular values to high relative
accuracy, and twisted factorisations of the shifted tridiagonal matrix give each vector by itself. Vectors of values that lie
close together are made orthogonal within their group.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
TINY = 1e-290
#: Squared singular values closer than this part of the larger one have their vectors made orthogonal.
CLOSE = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """``v, beta, alpha`` with ``(I - beta v v') x = alpha e1``."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    alpha = -norm if x[0] > 0 else norm
    v = x / norm
    v[0] -= alpha / norm
    return v, 2.0 / float(v @ v), alpha


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, p``: diagonal and upper diagonal of ``u' r p``; ``p`` is orthogonal."""
    m = np.array(r, dtype=np.float64)
    n = m.shape[0]
    p, a, b = np.eye(n), np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        v, beta, a[k] = _reflector(m[k:, k].copy())
        m[k:, k + 1 :] -= beta * np.outer(v, v @ m[k:, k + 1 :])
        if k + 1 < n:
            v, beta, b[k] = _reflector(m[k, k + 1 :].copy())
            m[k + 1 :, k + 1 :] -= beta * np.outer(m[k + 1 :, k + 1 :] @ v, v)
            p[:, k + 1 :] -= beta * np.outer(p[:, k + 1 :] @ v, v)
    return a, b, p


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int, float]:
    """One dqds transform; the place and size of the first negative pivot, or -1."""
    n, d = len(q), q[0] - shift
    qq, ee = [0.0] * n, [0.0] * (n - 1)
    for k in range(n - 1):
        if d < 0:
            return qq, ee, k, d
        qq[k] = d + e[k]
        if qq[k] == 0.0:
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / qq[k]
            ee[k] = e[k] * t
            d = d * t - shift
    qq[n - 1] = d
    return qq, ee, (n - 1 if d < 0 else -1), d


def _end_value(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows: an upper bound of the least one, close when nearly converged."""
    a, c, b2 = q[-2] + e[-1], q[-1], q[-1] * e[-1]
    half, gap = 0.5 * (a + c), 0.5 * (a - c)
    return (a * c - b2) / (half + np.hypot(gap, np.sqrt(b2))) if half > 0 else 0.0


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of ``B'B``, descending, from ``q = a^2`` and ``e = b^2``."""
    out: list[float] = []
    work = [(list(q), list(e), 0.0)]
    tol = (EPS * 0.5) ** 2
    while work:
        q, e, moved = work.pop()
        sweeps = 0
        while q:
            n = len(q)
            if n == 1:
                out.append(q[0] + moved)
                break
            if e[-1] <= tol * (moved + q[-1]) or e[-1] < TINY:
                out.append(q[-1] + moved)
                q, e, sweeps = q[:-1], e[:-1], 0
                continue
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= tol * (moved + min(q[k], q[k + 1])) or e[k] < TINY), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], moved))
                q, e, sweeps = q[cut + 1 :], e[cut + 1 :], 0
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift, tries = max(0.0, _end_value(q, e) * (1 - 4 * EPS)), 0
            while True:
                qq, ee, bad, d = _sweep(q, e, shift)
                if bad < 0:
                    break
                tries += 1
                shift = 0.0 if tries > 3 else max(0.0, shift + d) * (1 - 4 * EPS) if bad == n - 1 and tries == 1 else 0.25 * shift
            q, e, moved = qq, ee, moved + shift
            sweeps += 1
            if sweeps > 200 + 20 * n:
                raise ArithmeticError("dqds didn't converge")
    return sorted(out, reverse=True)


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit vector ``z`` of ``B'B z = value z``, from the twisted factorisation with the least pivot."""
    n = len(a)
    q, e, ab = (a * a).tolist(), (b * b).tolist(), (a[:-1] * b).tolist()
    s, p, lower, upper = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    s[0] = -value
    for k in range(n - 1):
        d = s[k] + q[k]
        d = d if abs(d) > TINY else EPS * EPS * value or TINY
        lower[k] = ab[k] / d
        s[k + 1] = e[k] * (s[k] / d) - value
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        d = p[k + 1] + e[k]
        d = d if abs(d) > TINY else EPS * EPS * value or TINY
        upper[k] = ab[k] / d
        p[k] = p[k + 1] * (q[k] / d) - value
    at = min(range(n), key=lambda k: abs(s[k] + p[k] + value))
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -lower[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -upper[k] * z[k]
    return z / np.linalg.norm(z)


def _vectors(a: np.ndarray, b: np.ndarray, values: list[float], most: float) -> list[np.ndarray]:
    """Vectors of the descending ``values`` of one unreduced block."""
    out: list[np.ndarray] = []
    tri = np.diag(a * a + np.concatenate([[0.0], b * b])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    rng = np.random.default_rng(len(a))
    group: list[np.ndarray] = []
    for i, v in enumerate(values):
        if i and values[i - 1] - v > CLOSE * values[i - 1]:
            group = []
        z = twisted(a, b, v)
        kept = _orthogonal(z, group)
        if np.linalg.norm(kept) < 0.7:  # too near the others of its group: inverse iteration beside them
            kept = _orthogonal(rng.standard_normal(len(a)), group)
            for _ in range(3):
                kept = np.linalg.solve(tri - (v + 2 * EPS * most) * np.eye(len(a)), kept / np.linalg.norm(kept))
                kept = _orthogonal(kept / np.linalg.norm(kept), group)
        z = kept / np.linalg.norm(kept)
        group.append(z)
        out.append(z)
    return out


def _orthogonal(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def right_singular(r: np.ndarray, part: float) -> tuple[np.ndarray, np.ndarray]:
    """``squares, vectors``: squared singular values above ``part`` squared times the largest, descending, and the right
    singular vectors as columns. Vectors point to where their largest entry is positive."""
    n = r.shape[0]
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(0), np.zeros((n, 0))
    a, b, p = bidiagonal(r / scale)
    sign = np.ones(n)  # B = (signs) |B| diag(sign)
    for k in range(n - 1):
        left = sign[k] if a[k] >= 0 else -sign[k]
        sign[k + 1] = left if b[k] >= 0 else -left
    a, b = np.abs(a), np.abs(b)
    b[b <= 0.5 * EPS * (a[:-1] + a[1:])] = 0.0
    found: list[tuple[float, int, np.ndarray]] = []
    ends = [*(np.flatnonzero(b == 0.0) + 1).tolist(), n]
    begin = 0
    blocks = []
    for end in ends:
        blocks.append((begin, end, dqds((a[begin:end] ** 2).tolist(), (b[begin : end - 1] ** 2).tolist())))
        begin = end
    most = max(v[0] for _, _, v in blocks)
    for begin, end, values in blocks:
        wanted = [v for v in values if v > part * part * most]
        for v, z in zip(wanted, _vectors(a[begin:end], b[begin : end - 1], wanted, most)):
            whole = np.zeros(n)
            whole[begin:end] = z
            found.append((v, begin, whole))
    found.sort(key=lambda f: (-f[0], f[1]))
    vectors = p @ (sign[:, None] * np.stack([f[2] for f in found], axis=1))
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    return np.array([f[0] for f in found]) * scale * scale, vectors
