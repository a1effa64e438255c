"""Feature-matrix preparation: column choice, population scaling, weights, PCA."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from trackspark.functions.paths import strip
from trackspark.schema import FEATURE_WEIGHTS, METADATA_COLUMNS, RETAINED_VARIANCE

#: A deviation below this part of the mean is rounding.
CONSTANT = 1e-13


def canonical_columns(df: DataFrame, required: Sequence[str] = ("file_path",)) -> DataFrame:
    """Make sure the required columns exist, renaming the first case-insensitive match."""
    for name in required:
        if name in df.columns:
            continue
        alike = [c for c in df.columns if c.lower() == name.lower()]
        if not alike:
            raise ValueError(f"the table has no column {name}")
        # By position: a rename by name is case-insensitive and would hit every match.
        at = df.columns.index(alike[0])
        df = df.toDF(*[name if i == at else c for i, c in enumerate(df.columns)])
    return df


def clean_key(df: DataFrame, key: str = "file_path") -> DataFrame:
    """Key as trimmed text; rows without a key fail when they are read."""
    text = strip(F.col(key).cast("string"))
    return df.withColumn(key, F.when(text.isNull(), F.raise_error(F.lit(f"null {key}"))).otherwise(text))


def feature_columns(df: DataFrame, metadata: Sequence[str] = METADATA_COLUMNS) -> list[str]:
    """Numeric and boolean columns in table order, without the metadata columns."""
    return [
        f.name
        for f in df.schema
        if f.name not in metadata and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def column_weights(columns: Sequence[str], weights: Mapping[str, float] | None = None) -> list[float]:
    """Weight per column by the group its name falls in; given weights override defaults."""
    w = {**FEATURE_WEIGHTS, **(weights or {})}
    groups = (
        ("mfcc", "mfcc"),
        ("chroma", "chroma"),
        ("tempo", "tempo"),
        ("spectral", "spectral"),
        ("centroid", "spectral"),
        ("bandwidth", "spectral"),
    )
    return [next((w[g] for part, g in groups if part in c.lower()), w["default"]) for c in columns]


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: ``feature, mean, std`` (population), from a single pass."""
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.stddev_pop(F.col(c).cast("double")).alias("std"),
            ).alias(f"_s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.inline(F.array(*[f"_s{i}" for i in range(len(columns))])))


@dataclass(frozen=True)
class FeatureSpace:
    """A fitted standardise -> weight -> PCA chain; ``transform`` adds ``vector``.

    It holds numbers only: d-long statistics and, with PCA, the kept d x k components.
    """

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]  # population; 0 for a constant column
    components: tuple[tuple[float, ...], ...] | None = None  # a row per column; None: no PCA
    explained: float | None = None
    fill_missing: float | None = None

    @property
    def n_components(self) -> int | None:
        return None if self.components is None else len(self.components[0])

    def transform(self, df: DataFrame, out: str = "vector") -> DataFrame:
        """Add ``out`` as ``array<double>``. A row with a missing value fails, unless
        missing values are filled."""
        values, missing = [], F.lit(False)
        for name, mean, std, w in zip(self.columns, self.mean, self.std, self.weights):
            c = F.col(f"`{name}`").cast("double")
            if self.fill_missing is not None:
                c = F.when(c.isNull() | F.isnan(c), F.lit(float(self.fill_missing))).otherwise(c)
            missing = missing | c.isNull() | F.isnan(c)
            values.append((c - mean) / std * w if std else F.lit(0.0))
        scaled = F.array(*values)
        if self.fill_missing is None:
            scaled = F.when(missing, F.raise_error(F.lit("missing value in a feature column"))).otherwise(scaled)
        return df.withColumn(out, scaled if self.components is None else _rotated(np.array(self.components))(scaled))


def _rotated(components: np.ndarray):
    k = components.shape[1]

    @F.arrow_udf("array<double>")
    def rotate(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        turned = flat.reshape(-1, len(components)) @ components
        return pa.ListArray.from_arrays(pa.array(np.arange(len(turned) + 1, dtype=np.int32) * k), pa.array(turned.ravel()))

    return rotate


@dataclass(frozen=True)
class CoMoments:
    """Of all rows: their number, how many values each column misses, means, and the sums of products of deviations."""

    n: int
    missing: tuple[int, ...]
    mean: np.ndarray
    products: np.ndarray

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.missing, self.mean, self.products.ravel()]).astype("<f8").tobytes()

    @staticmethod
    def unpacked(data: bytes, d: int) -> CoMoments:
        v = np.frombuffer(data, "<f8")
        return CoMoments(int(v[0]), tuple(v[1 : 1 + d].astype(int).tolist()), v[1 + d : 1 + 2 * d], v[1 + 2 * d :].reshape(d, d))

    def merged(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        if n == 0:
            return self
        apart = other.mean - self.mean
        return CoMoments(
            n,
            tuple(a + b for a, b in zip(self.missing, other.missing)),
            self.mean + apart * (other.n / n),
            self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n),
        )


_MERGED_IN = 256  # tasks that merge what the others found


def co_moments(df: DataFrame, columns: Sequence[str], fill_missing: float | None = None) -> CoMoments:
    """One scan of the table; a d x d matrix leaves each task. Missing values count, and as 0 in the sums."""
    d = len(columns)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = CoMoments(0, (0,) * d, np.zeros(d), np.zeros((d, d)))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], axis=1)
            if fill_missing is not None:
                x = np.where(np.isnan(x), fill_missing, x)
            holes = np.isnan(x)
            x = np.where(holes, 0.0, x)
            if len(x):
                mean = x.mean(axis=0)
                found = found.merged(CoMoments(len(x), tuple(holes.sum(axis=0).tolist()), mean, (x - mean).T @ (x - mean)))
        if found.n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part % _MERGED_IN], pa.int64()), pa.array([part], pa.int64()), pa.array([found.packed()], pa.binary())], names=["to", "part", "found"])

    def merge(key, table):
        ordered = sorted(zip(table["part"].to_pylist(), table["found"].to_pylist()))
        return pa.table({"to": pa.array([key[0].as_py()], pa.int64()), "found": pa.array([_all(ordered, d).packed()], pa.binary())})

    parts = rows.mapInArrow(scan, "to bigint, part bigint, found binary").groupBy("to").applyInArrow(merge, "to bigint, found binary").collect()
    return _all(sorted((r.to, bytes(r.found)) for r in parts), d)


def _all(parts: list[tuple[int, bytes]], d: int) -> CoMoments:
    found = CoMoments(0, (0,) * d, np.zeros(d), np.zeros((d, d)))
    for _, p in parts:
        found = found.merged(CoMoments.unpacked(p, d))
    return found


def retained_components(explained: Sequence[float], ratio: float) -> int:
    """Smallest k whose leading variance shares sum to more than ``ratio``."""
    total = 0.0
    for k, share in enumerate(explained, 1):
        total += share
        if total > ratio:
            return k
    return len(explained)


def fit_feature_space(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    weights: Mapping[str, float] | None = None,
    n_components: float | int | None = RETAINED_VARIANCE,
    fill_missing: float | None = None,
) -> FeatureSpace:
    """Fit the chain on the whole table, in one scan.

    ``n_components``: a share of variance in (0, 1), a number of components, or None to
    skip PCA. Constant columns standardise to zero. Columns with missing values are
    named in the error unless ``fill_missing`` gives a value for them. Components point to where their largest entry is positive.
    """
    columns = list(columns) if columns is not None else feature_columns(df)
    if not columns:
        raise ValueError("no numeric feature columns")
    found = co_moments(df, columns, fill_missing)
    if found.n == 0:
        raise ValueError("no rows to fit on")
    holes = [c for c, m in zip(columns, found.missing) if m]
    if holes:
        raise ValueError(f"missing values in feature columns: {', '.join(holes)}")
    n, d = found.n, len(columns)
    std = np.sqrt(np.diag(found.products) / n)
    # What rounding leaves of a constant column's deviations is no spread.
    std = np.where(std <= CONSTANT * np.abs(found.mean), 0.0, std)
    w = column_weights(columns, weights)
    components = explained = None
    # With all columns constant every row is the zero vector: nothing to rotate.
    if n_components is not None and std.any():
        by = np.divide(np.array(w), std, out=np.zeros(d), where=std > 0)
        values, vectors = np.linalg.eigh(found.products / n * np.outer(by, by))
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        shares = (values / values.sum()).tolist()
        k = retained_components(shares, n_components) if 0 < n_components < 1 else int(n_components)
        k = min(k, n, d)
        kept = vectors[:, :k]
        kept = kept * np.where(np.take_along_axis(kept, np.abs(kept).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        components, explained = tuple(map(tuple, kept.tolist())), sum(shares[:k])
    return FeatureSpace(tuple(columns), tuple(w), tuple(found.mean.tolist()), tuple(std.tolist()), components, explained, fill_missing)


def explode_array(df: DataFrame, array: str, prefix: str, n: int) -> DataFrame:
    """Array column as ``n`` double columns ``prefix0 .. prefix{n-1}``, in place of it."""
    return df.select(
        *[c for c in df.columns if c != array],
        *[F.expr(f"CAST(`{array}`[{i}] AS DOUBLE) AS {prefix}{i}") for i in range(n)],
    )
