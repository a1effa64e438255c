"""Whitening of embedding vectors on an exact integer grid.

An entry ``c`` counts as the integer ``floor(scale * c) + offset``, so sums, centring and deviations are exact. Centred rows are reduced
block by block to triangular factors (QR), which are merged in a tree; the last factor, as small as a vector is long, gives singular
values and directions through its bidiagonal form (:mod:`~trackspark.llm.qd`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trackspark.llm.qd import right_singular
from trackspark.llm.shared import write_table

FAN = 16  # partial results that are merged at a time
BLOCK_ROWS = 4096
#: Singular values below this part of the largest are rounding: their directions are no components.
NEGLIGIBLE = 1e-11
_FAR = float(1 << 61)
_PARTIAL = "key long, part binary"


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` rows, exact sums, eigenvalues (descending) and unit components as columns."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    scale: int
    offset: int

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.eigenvalues]


def _grid(column: pa.Array, dims: int | None, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: rows that count, the length of each, and (for ``dims`` given) their integers as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = column.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = ends - ends[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.asarray(column.is_valid()) & (sizes > 0) & (bad[at[1:]] == bad[at[:-1]])
    if dims is None:
        return np.flatnonzero(good), sizes, flat
    rows = np.flatnonzero(good & (sizes == dims))
    values = flat[at[rows][:, None] + np.arange(dims)]
    return rows, sizes, np.clip(np.floor(values * scale), -_FAR, _FAR).astype(np.int64) + offset


def _folded(parts: DataFrame, merge: Callable[[list[bytes]], bytes], name: str) -> bytes | None:
    """All ``key, part`` rows merged into one, :data:`FAN` neighbours at a time, each level written to the shared folder."""

    def run(key, table):
        rows = sorted(zip(table["key"].to_pylist(), table["part"].to_pylist()))
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([merge([p for _, p in rows])], pa.binary())})

    parts = write_table(parts, name)
    while parts.count() > 1:  # keys shrink to 0, so all meet in the end
        parts = write_table(parts.withColumn("to", F.floor(F.col("key") / FAN)).groupBy("to").applyInArrow(run, _PARTIAL), name)
    first = parts.head()
    return None if first is None else bytes(first.part)


def _vectors(table: DataFrame, vector_col: str) -> DataFrame:
    return table.select(F.col(vector_col).alias("vector"))


def _sums(table: DataFrame, vector_col: str, scale: int, offset: int) -> tuple[int, list[int]]:
    """Rows of the commonest length (ties: the longer) and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            rows, sizes, _ = _grid(b["vector"], None, scale, offset)
            for d in np.unique(sizes[rows]).tolist():
                _, _, x = _grid(b["vector"], d, scale, offset)
                high, low = (x >> 31).sum(axis=0).tolist(), (x & 0x7FFFFFFF).sum(axis=0).tolist()
                n, old = held.get(d, (0, [0] * d))
                held[d] = (n + len(x), [o + (h << 31) + l for o, h, l in zip(old, high, low)])
        for d, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
                names=["dims", "dim", "n", "total"],
            )

    parts = write_table(_vectors(table, vector_col).mapInArrow(run, "dims long, dim long, n long, total decimal(38,0)"), "sums")
    best = parts.where("dim = 0").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).head()
    if best is None:
        return 0, []
    rows = parts.where(F.col("dims") == best.dims).groupBy("dim").agg(F.sum("total").alias("total")).orderBy("dim").collect()
    return int(best.n), [int(r.total) for r in rows]


def _centred(x: np.ndarray, n: int, sums) -> np.ndarray:
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def _triangle(rows: list[np.ndarray], dims: int) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(rows), mode="r")
    return np.concatenate([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r


def _reduced(table: DataFrame, vector_col: str, n: int, sums: list[int], scale: int, offset: int) -> np.ndarray:
    dims = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, any_row = [], 0, False
        for b in batches:
            _, _, x = _grid(b["vector"], dims, scale, offset)
            for a in range(0, len(x), BLOCK_ROWS):
                held.append(_centred(x[a : a + BLOCK_ROWS], n, sums))
                size += len(held[-1])
                any_row = True
                if size >= max(BLOCK_ROWS, 4 * dims):
                    held = [_triangle(held, dims)]
                    size = dims
        if any_row:
            r = _triangle(held, dims)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["key", "part"])

    def merge(parts: list[bytes]) -> bytes:
        return _triangle([np.frombuffer(p).reshape(dims, dims) for p in parts], dims).tobytes()

    found = _folded(_vectors(table, vector_col).mapInArrow(run, _PARTIAL), merge, "triangles")
    return np.frombuffer(found).reshape(dims, dims)


def _moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _merged(a, b):
    """Counts, means and centred products of two sets of rows as one."""
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _identity_error(table: DataFrame, vector_col: str, n: int, sums, directions: np.ndarray, scale: int, offset: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    dims, k = directions.shape

    def packed(m) -> bytes:
        return np.concatenate([[float(m[0])], m[1], m[2].reshape(-1)]).tobytes()

    def unpacked(data: bytes):
        v = np.frombuffer(data)
        return int(v[0]), v[1 : 1 + k], v[1 + k :].reshape(k, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            _, _, x = _grid(b["vector"], dims, scale, offset)
            if len(x):
                m = _moments(_centred(x, n, sums) @ directions)
                held = m if held is None else _merged(held, m)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(held)], pa.binary())], names=["key", "part"])

    def merge(parts: list[bytes]) -> bytes:
        held = unpacked(parts[0])
        for p in parts[1:]:
            held = _merged(held, unpacked(p))
        return packed(held)

    count, _, products = unpacked(_folded(_vectors(table, vector_col).mapInArrow(run, _PARTIAL), merge, "moments"))
    return float(np.abs(products / count - np.eye(k)).max())


def fit(table: DataFrame, vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening:
    """The whitening of all rows that count: see :func:`whiten` for those that don't.

    Directions whose singular value is below :data:`NEGLIGIBLE` of the largest (constant or dependent entries, fewer
    rows than entries) are no components. Without a row, or when all rows are equal, there are none.
    Equal eigenvalues: any orthonormal set of their space, the same for all rows.
    """
    n, sums = _sums(table, vector_col, scale, offset)
    nothing = Whitening(n, tuple(sums), np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0.0, scale, offset)
    if n == 0:
        return nothing
    r = _reduced(table, vector_col, n, sums, scale, offset)
    squares, vectors = right_singular(r, NEGLIGIBLE)
    if len(squares) == 0:
        return nothing
    values, vectors = squares[:components] / n, vectors[:, :components]
    error = _identity_error(table, vector_col, n, sums, vectors / np.sqrt(values), scale, offset)
    return Whitening(n, tuple(sums), values, vectors, float((r * r).sum()) / n, error, scale, offset)


def _deviations(x: np.ndarray, n: int, sums) -> list[Decimal | None]:
    """``sum((n * x - sums)^2)`` by row, exactly; null beyond 38 digits."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    near = x - whole
    far = n * (int(np.abs(near).max(initial=0)) + 1)
    if far * far * len(rest) < 1 << 63:
        d = n * near - np.array(rest, dtype=np.int64)
        return [Decimal(v) for v in (d * d).sum(axis=1).tolist()]
    exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in near.tolist()]
    return [Decimal(v) if v < 10**38 else None for v in exact]


def whiten(table: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n, deviation, whitened``: a row for each row that counts; ``whitened`` has one entry per component.

    A row whose vector is null, empty or holds a null, NaN or infinite entry is dropped, and so is one of another length than the
    commonest (ties: the longest). Repeated rows and ids are rows of their own; a null id stays null. Integers are held to 62 bits:
    entries beyond count as the limit. ``deviation`` is exact, null beyond 38 digits. An empty table gives no rows. Vectors may be long, but
    a matrix of their length squared must fit in a task. Other columns aren't read.
    """
    n, sums, dims = model.n, model.sums, len(model.sums)
    k = len(model.eigenvalues)
    directions = model.components / np.sqrt(model.eigenvalues) if k else np.zeros((dims, 0))
    scale, offset = model.scale, model.offset
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, _, x = _grid(b["vector"], dims, scale, offset)
            if n == 0 or len(x) == 0:
                continue
            w = _centred(x, n, sums) @ directions
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"].take(pa.array(at)), pa.array(np.full(len(x), n)), pa.array(_deviations(x, n, sums), pa.decimal128(38, 0)), lists],
                names=["vec_id", "n", "deviation", "whitened"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, n bigint, deviation decimal(38,0), whitened array<double>")


def by_component(whitened: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component (from 1), with the component's share of the variance and the fit's error."""
    shares = F.array(*[F.lit(v) for v in model.explained]) if model.explained else F.array().cast("array<double>")
    return whitened.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
