"""Approximate top-k similarity search by hashing with several tables and several probes.

A table hashes a unit vector to the signs of its products with random directions, so vectors at a small angle often fall into one bucket.
A seed looks into its own bucket of every table and into those that differ in the signs it is least sure of. Seeds travel once, in chunks of
bounded size; the library is sent past each chunk once, whatever the number of tables, in blocks of bounded size, without the rows that are in no
parcel of buckets with neighbouring codes that the chunk looks into. Everything that meets in a bucket is scored exactly, so scores are those of the exact
search and only neighbours that never met a seed are missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trackspark.operators.knn import _Best, _lists, _matrix, _packed, _points, _top_k, chunk_count, pass_chunks
from trackspark.session import materialise

ROWS_PER_BUCKET = 512  # wanted; decides the number of signs
MAX_SIGNS = 24
BLOCK_ROWS = 65_536  # library rows in a task's memory, and per parcel on average
CHUNK_ROWS = 40_960  # seeds in a task's memory
CHUNK_CODES = 1 << 26  # codes in a task's memory, into which they look
ALL_ASKED = 1 << 14  # codes that a chunk's seeds look into for each parcel, from which on the library is sent whole
MANY_SIGNS = 10  # signs of the largest table for which FEW_PROBES are enough
FEW_PROBES = 64
_SLICE = 128  # seeds whose probes are in memory at once


@dataclass(frozen=True)
class HashIndex:
    """A library hashed for :func:`approximate_knn_join`. ``rows``: ``id, packed, codes`` (one code per table)."""

    rows: DataFrame
    k_max: int
    directions: np.ndarray  # tables x signs x dimensions
    probes: int
    parcel_signs: int = 0  # the uppermost signs, which buckets of a parcel share


def _codes(points: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row x table) and the products they are signs of (row x table x sign)."""
    products = np.einsum("nd,tsd->nts", points, directions)
    return (products > 0) @ (1 << np.arange(directions.shape[1])), products


def build_hash_index(
    library: DataFrame,
    k_max: int,
    tables: int = 8,
    probes: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    id_col: str = "id",
    vector: str = "vector",
    seed: int = 0,
) -> HashIndex:
    """Hash a library for cosine search. More ``tables`` and ``probes`` find more and cost more; by default a seed looks into half of
    the buckets of a small table, then into 64, and of more than 2^10 buckets into a number that grows with their number to the power of 2/3: among random
    vectors, 64 of 2^13 find three quarters of the neighbours only. Zero vectors have cosine 0 with everything and meet by chance."""
    lib = library.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    stats = lib.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).head()
    signs = int(min(MAX_SIGNS, max(1, np.ceil(np.log2(max(1, stats.n) / rows_per_bucket)) + 2)))
    if probes is None:
        probes = min(FEW_PROBES, 1 << (signs - 1)) if signs <= MANY_SIGNS else round(FEW_PROBES * 4 ** ((signs - MANY_SIGNS) / 3))
    directions = np.random.default_rng(seed).standard_normal((tables, signs, (stats.d or 0) + 2))
    schema = T.StructType([T.StructField("id", lib.schema["id"].dataType), T.StructField("packed", T.BinaryType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"))
                codes = _codes(_points(m, "cosine", 0), directions)[0]
                yield pa.RecordBatch.from_arrays([b.column("id"), _packed(m), _lists(codes.astype(np.int32))], ["id", "packed", "codes"])

    parcel_signs = min(signs, max(0, -(-stats.n // BLOCK_ROWS) - 1).bit_length())
    return HashIndex(lib.mapInArrow(run, schema), k_max, directions, max(1, probes), parcel_signs)


def probe_codes(codes: np.ndarray, products: np.ndarray, probes: int) -> np.ndarray:
    """The codes each row looks at in each table (row x table x probe): its own, then those that change the signs of the
    smallest products, in ascending order of the changed products' squares."""
    n, tables, signs = products.shape
    weak = np.argsort(np.abs(products), axis=2)  # least sure first
    width = min(signs, 12)
    sets = [c for r in range(min(4, width) + 1) for c in combinations(range(width), r)]
    cost = np.take_along_axis(products**2, weak, axis=2)[:, :, :width]
    member = np.array([[i in c for i in range(width)] for c in sets], dtype=np.float64)
    total, m = cost @ member.T, min(probes, len(sets))
    best = np.sort(np.argpartition(total, m - 1, axis=2)[:, :, :m], axis=2)
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(total, best, axis=2), axis=2, kind="stable"), axis=2)
    flips = (1 << weak[:, :, :width]) @ member.T.astype(np.int64)
    return codes[:, :, None] ^ np.take_along_axis(flips, best, axis=2)


def asked_parcels(index: HashIndex, q: DataFrame, places_only: bool = False) -> DataFrame:
    """A row for each seed (``query_id, v``) and parcel it looks into: ``query_id, point, hash_table, parcel, codes``; with
    ``places_only`` without point and codes."""
    directions, probes = index.directions, index.probes
    shift = directions.shape[1] - index.parcel_signs
    heavy = [] if places_only else [T.StructField("point", T.ArrayType(T.DoubleType())), T.StructField("codes", T.ArrayType(T.LongType()))]
    schema = T.StructType([q.schema["query_id"], T.StructField("hash_table", T.IntegerType()), T.StructField("parcel", T.LongType()), *heavy])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = _points(_matrix(b.column("v")), "cosine", 1) if b.num_rows else np.zeros((0, 0))
            for a in range(0, len(points), _SLICE):
                p = points[a : a + _SLICE]
                looked = np.sort(probe_codes(*_codes(p, directions), probes), axis=2)
                parcel, width = (looked >> shift).reshape(-1), looked.shape[2]
                begins = np.ones(len(parcel), bool)
                begins[1:] = parcel[1:] != parcel[:-1]
                begins[::width] = True
                at = np.nonzero(begins)[0]
                row, table = np.divmod(at // width, looked.shape[1])
                columns = [b.column("query_id").take(pa.array(row + a)), pa.array(table.astype(np.int32)), pa.array(parcel[at])]
                if not places_only:
                    columns += [_lists(p[row]), pa.ListArray.from_arrays(pa.array(np.append(at, len(parcel)).astype(np.int32)), pa.array(looked.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return q.mapInArrow(run, schema)


def approximate_knn_join(index: HashIndex, seeds: DataFrame, k: int, exclude_self: bool = True, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """Up to ``k`` near library rows of every seed: ``query_id, id, score, rank``, scores as in the exact search.

    A seed may have fewer rows than ``k`` where its buckets hold fewer. Buckets of any size are searched whole.
    """
    if k > index.k_max:
        raise ValueError(f"k={k} exceeds the index's k_max={index.k_max}")
    q = seeds.select(F.col(id_col).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    tables, signs = index.directions.shape[:2]
    shift = signs - index.parcel_signs
    n = q.count()
    chunks = chunk_count(n, k, q.sparkSession, min(CHUNK_ROWS, CHUNK_CODES // (tables * index.probes)))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk")
    # So many seeds look into every parcel, and there is nothing to leave out.
    every = n * index.probes > chunks * (ALL_ASKED << index.parcel_signs)
    wanted = np.full((chunks, tables, 1 << index.parcel_signs), every)
    if not every:
        for r in asked_parcels(index, q, places_only=True).select(chunk, "hash_table", "parcel").distinct().collect():
            wanted[r.chunk, r.hash_table, r.parcel] = True

    packed = T.StructField("packed", T.BinaryType())
    seed_schema = T.StructType([q.schema["query_id"], packed])
    row_schema = T.StructType([index.rows.schema["id"], packed, T.StructField("has", T.ArrayType(T.IntegerType())), T.StructField("chunk", T.IntegerType()), T.StructField("place", T.LongType())])

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("query_id"), _packed(_matrix(b.column("v")))], seed_schema.names)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = _codes_of(b.column("codes"))
                for c in range(chunks):
                    i = np.nonzero(wanted[c][np.arange(tables), codes >> shift].any(axis=1))[0]
                    there = b.take(pa.array(i))
                    columns = [there.column("id"), there.column("packed"), there.column("codes"), pa.array(np.full(len(i), c, np.int32)), pa.array(codes[i, 0].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, row_schema.names)

    asking = q.mapInArrow(compact, seed_schema).select("query_id", "packed", F.lit(float("-inf")).alias("floor"), F.lit(None).cast("binary").alias("asks"), chunk)
    held = index.rows.select("id", "packed", "codes").mapInArrow(sent, row_schema)
    met = pass_chunks(asking, held, index.directions.shape[2] - 2, chunks, k, "cosine", exclude_self, _by_bucket(index), BLOCK_ROWS, repeats=True)
    return _top_k(met.repartition("query_id").dropDuplicates(["query_id", "id"]), k)


def _codes_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _by_bucket(index: HashIndex):
    """The seeds that look into each bucket of a block, and the bucket's rows. A pair comes once for each table where it meets."""
    directions, probes = index.directions, index.probes

    def meetings(seeds: pa.Table, best: _Best):
        asked = []  # for each table the seeds in order of the codes they look into, the codes, and where they begin
        for one in directions:
            width = probe_codes(*_codes(best.q[:1], one[None]), probes).shape[2]
            code = np.empty((len(best.q), width), np.int32)
            for a in range(0, len(best.q), _SLICE):
                code[a : a + _SLICE] = probe_codes(*_codes(best.q[a : a + _SLICE], one[None]), probes)[:, 0]
            row = np.argsort(code, axis=None, kind="stable")
            row //= width
            row = row.astype(np.uint16 if len(code) <= 1 << 16 else np.int32)
            values, counts = np.unique(code, return_counts=True)
            asked.append((row, values, np.append(0, np.cumsum(counts))))

        def meet(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            codes = _codes_of(block.column("has"))
            for (row, values, first), own in zip(asked, codes.T):
                held = np.argsort(own, kind="stable")
                buckets, begins = np.unique(own[held], return_index=True)
                begins = np.append(begins, len(held))
                _, i, j = np.intersect1d(values, buckets, assume_unique=True, return_indices=True)
                for a, b, c, d in zip(first[i].tolist(), first[i + 1].tolist(), begins[j].tolist(), begins[j + 1].tolist()):
                    yield row[a:b].astype(np.int64), held[c:d]

        return meet

    return meetings


def recall(index: HashIndex, seeds: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row ``n_queries, wanted, found``: how many of the exact neighbours (``query_id, id``) the hashed search finds."""
    # One search at a time: what either shuffles is gone before the other begins.
    near = materialise(approximate_knn_join(index, seeds, k).select("query_id", "id", F.lit(1).alias("hit")))
    both = materialise(exact.select("query_id", "id")).join(near, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
