"""Exact top-k similarity search, for one seed or for many at once.

Many seeds against a large library is answered without comparing every pair of rows in
one place. The library is cut into cells around pivots (a bounded number of its own
rows, more of them the larger the library) and each cell into blocks of bounded size. A seed first meets the cell or cells
nearest to it, which gives it a k-th best distance; by the triangle inequality it then
needs only those further cells that could hold something closer. It meets the nearest of these next, which tightens that
distance, and then what is still open. Seeds travel once a round, in chunks of bounded size whose seeds have their nearest
cells in common, and the cells that a chunk asks for are sent past it in blocks of bounded size: (chunk) is an equi-join, a task holds one chunk and one
block, and leaves k rows per seed. So rows are shuffled once for every chunk that wants them, however many blocks there are. Pivot cells with triangle-inequality bounds are
the published approach of Lu et al., "Efficient Processing of k Nearest Neighbor Joins
using MapReduce" (VLDB 2012).

Cosine is searched as Euclidean distance between unit vectors, which orders the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from trackspark.functions.vectors import similarity_to
from trackspark.schema import OVERFETCH
from trackspark.session import materialise, materialise_table

METRICS = ("cosine", "euclidean")
ROWS_PER_CELL = 50_000
PIVOT_BYTES = 8 << 20  # pivots and cell statistics travel to every task: cells stop growing in number, not in size, there
MAX_CELLS = 16_384
NEAR_CELLS = 4  # cells of the second round
BLOCK_ROWS = 32_768  # library rows in a task's memory, and in a parcel of small cells
CHUNK_ROWS = 65_536  # seeds in a task's memory
_TILE = 256  # seeds of the smallest chunks
_AT_ONCE = 1 << 20  # distances in memory at once inside a group
_WIDE = 2048  # library rows of one product
_PENDING = 1 << 18  # candidates that wait at least before a chunk's best are sorted out
_RESCORED = 1 << 16  # pairs re-scored at once
_SLICE = 512  # rows whose distances to all pivots are in memory at once
_SLACK = 1e-9  # covers rounding in bounds and block products; candidates are re-scored


# --- one seed ---------------------------------------------------------------


def similar_to(
    library: DataFrame,
    seed: DataFrame,
    n: int,
    exclude: DataFrame | None = None,
    overfetch: int | None = OVERFETCH,
    metric: str = "cosine",
    id_col: str = "id",
    vector: str = "vector",
) -> DataFrame:
    """The ``n`` library rows most similar to the one row of ``seed``, best first.

    One scan with a projected score and a distributed top-k. The seed is fetched first (one
    row), so its vector is a constant of the compiled score and nothing is joined. ``exclude`` holds ids to leave out: with
    ``overfetch=m`` they are removed from the best ``m * n`` (fewer than ``n`` rows may
    remain), with ``overfetch=None`` before ranking.
    """
    one = seed.select(id_col, F.col(vector).cast("array<double>").alias("v")).head()
    if one is None:
        raise ValueError("the seed is not in the library")
    scored = library.where(F.col(id_col) != one[id_col]).withColumn(
        "similarity_score", similarity_to(vector, one.v, metric)
    ).select(id_col, "similarity_score")
    best = [F.desc("similarity_score"), F.asc(id_col)]
    if exclude is not None:
        gone = exclude.select(id_col).distinct()
        if overfetch is None:
            scored = scored.join(gone, id_col, "left_anti")
        else:
            scored = scored.orderBy(*best).limit(overfetch * n).join(gone, id_col, "left_anti")
    top = scored.orderBy(*best).limit(n)
    # At most n rows are left, so a single-partition window only numbers them.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*best))).orderBy("rank")


# --- many seeds -------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))


def _packed(m: np.ndarray) -> pa.Array:
    """Vectors as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = m.astype(np.float32)
    m = np.ascontiguousarray(single if np.array_equal(single, m) else m)
    ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1] * m.itemsize))
    return pa.Array.from_buffers(pa.binary(), len(m), [None, ends.buffers()[1], pa.py_buffer(m)])


def _unpacked(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    single = np.array([len(r) == 4 * dims for r in rows], bool)
    out = np.empty((len(rows), dims))
    for kind, mine in ((np.float32, single), (np.float64, ~single)):
        if mine.any():
            out[mine] = np.frombuffer(b"".join(r for r, x in zip(rows, mine) if x), kind).reshape(-1, dims)
    return out


def _points(m: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Search points. For cosine: unit vectors, and a zero vector becomes a unit vector
    on an axis of its own (one per side), so that it has cosine 0 with everything."""
    if metric != "cosine":
        return m
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    zero = length == 0
    out = np.zeros((m.shape[0], m.shape[1] + 2))
    out[:, :-2] = m / np.where(zero, 1.0, length)[:, None]
    out[zero, m.shape[1] + side] = 1.0
    return out


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (
        np.einsum("ij,ij->i", points, points)[:, None]
        + np.einsum("ij,ij->i", pivots, pivots)[None, :]
        - 2.0 * points @ pivots.T
    )
    return np.sqrt(np.maximum(sq, 0.0))


@dataclass(frozen=True)
class NeighbourIndex:
    """A library ready for :func:`knn_join`.

    ``rows``: ``id, packed, cell``. ``pivots`` and the per-cell ``count, nearest,
    farthest`` are bounded by ``MAX_CELLS`` and ``PIVOT_BYTES``.
    """

    rows: DataFrame
    metric: str
    k_max: int
    pivots: np.ndarray
    count: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    dims: int


def build_index(
    library: DataFrame,
    k_max: int,
    metric: str = "cosine",
    id_col: str = "id",
    vector: str = "vector",
    rows_per_cell: int = ROWS_PER_CELL,
) -> NeighbourIndex:
    """Normalise the library, fold copies, and assign cells.

    Exact copies are interchangeable apart from their ids, and a seed can use at most
    ``k_max`` of them besides itself, so the ``k_max + 1`` smallest ids of each copy
    group stand for the group without changing any answer.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    lib = library.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    same = Window.partitionBy("_h", "v").orderBy("id")
    lib = (
        lib.withColumn("_h", F.xxhash64("v"))
        .withColumn("_rn", F.row_number().over(same))
        .where(F.col("_rn") <= k_max + 1)
        .select("id", "v")
    )
    size = lib.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).head()
    n = size.n
    cells = int(min(MAX_CELLS, PIVOT_BYTES // (8 * ((size.d or 0) + 2)), max(1, -(-n // rows_per_cell))))
    id_type = lib.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("packed", T.BinaryType()),
            T.StructField("cell", T.IntegerType()),
            T.StructField("dist", T.DoubleType()),
        ]
    )
    if cells == 1:
        pivots = None
    else:
        sample = lib.orderBy(F.xxhash64("id"), "id").select("v").limit(cells).collect()
        pivots = np.unique(_points(np.array([r.v for r in sample]), metric, 0), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            m = _matrix(b.column("v"))
            p = _points(m, metric, 0)
            if pivots is None:
                cell, dist = np.zeros(len(p), np.int32), np.zeros(len(p))
            else:
                parts = [_distances(p[a : a + _SLICE], pivots) for a in range(0, len(p), _SLICE)]
                cell = np.concatenate([d.argmin(axis=1) for d in parts]).astype(np.int32)
                dist = np.concatenate([d.min(axis=1) for d in parts])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), _packed(m), pa.array(cell), pa.array(dist)],
                ["id", "packed", "cell", "dist"],
            )

    rows = lib.mapInArrow(assign, schema)
    if pivots is None:
        one = np.zeros(1)
        return NeighbourIndex(rows.drop("dist"), metric, k_max, np.zeros((1, 0)), np.array([n]), one, one, size.d or 0)
    rows = materialise(rows)
    stats = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")
    )
    count, lo, hi = np.zeros(len(pivots), int), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in stats.collect():  # at most MAX_CELLS rows
        count[r.cell], lo[r.cell], hi[r.cell] = r.n, r.lo, r.hi
    return NeighbourIndex(rows.drop("dist"), metric, k_max, pivots, count, lo, hi, size.d or 0)


def _home_cells(d: np.ndarray, count: np.ndarray, need: int) -> np.ndarray:
    """Mask of each seed's nearest non-empty cells that together hold ``need`` rows."""
    order = np.argsort(np.where(count[None, :] > 0, d, np.inf), axis=1, kind="stable")
    held = np.cumsum(count[order], axis=1)
    take = held - count[order] < need
    mask = np.zeros(d.shape, bool)
    np.put_along_axis(mask, order, take, axis=1)
    return mask & (count > 0)[None, :]


def _least_distances(d: np.ndarray, index_arrays) -> np.ndarray:
    """What every cell's points are away from each seed at least; infinite for empty cells."""
    pivots, count, nearest, farthest = index_arrays
    low = np.maximum(d - farthest[None, :], nearest[None, :] - d)
    # Points of cell j are nearer to pivot j than to the seed's own pivot i.
    own = d.argmin(axis=1)
    gap = _distances(pivots[own], pivots)
    own_d = d[np.arange(len(d)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (d**2 - own_d**2) / (2 * gap), 0.0)
    return np.where((count > 0)[None, :], np.maximum(low, plane), np.inf)


def _asked_cells(points: np.ndarray, index_arrays, need: int, done: list[np.ndarray], last: bool) -> np.ndarray:
    """Mask of the cells a seed meets in this round. ``done`` has the k-th best distance after each round before.

    Round one takes the nearest cells, round two the ``NEAR_CELLS`` most promising of those that are open, and the last all that
    are still open. The cells of earlier rounds follow from the distances known then, so they needn't be kept.
    """
    pivots, count = index_arrays[:2]
    d = _distances(points, pivots)
    mask = _home_cells(d, count, need)
    if not done:
        return mask
    low = np.where(mask, np.inf, _least_distances(d, index_arrays))
    order = np.argsort(low, axis=1, kind="stable")[:, :NEAR_CELLS]
    near = np.zeros(d.shape, bool)
    np.put_along_axis(near, order, True, axis=1)
    second = near & (low <= done[0][:, None] + _SLACK)
    return second if not last else (low <= done[1][:, None] + _SLACK) & ~second


def _scores(q: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Scores pair by pair: equal pairs get equal scores whatever the group's shape was."""
    out = np.empty(len(i))
    for a in range(0, len(i), _RESCORED):
        t, r = q[i[a : a + _RESCORED]], s[j[a : a + _RESCORED]]
        if metric == "cosine":
            out[a : a + _RESCORED] = np.einsum("ij,ij->i", t, r)
        else:
            out[a : a + _RESCORED] = 1.0 - np.sqrt(np.einsum("ij,ij->i", t - r, t - r))
    return out


class _Best:
    """The best ``k`` library rows of every seed of a chunk, while blocks of the library come by.

    A product that can't be among a seed's best any more, with room for rounding, is dropped; the rest are scored exactly. For cosine the products
    are made in single precision, whose rounding the room covers as well. ``floor`` is a score that a seed's rows needn't be below. ``repeats``
    says that a pair may come more than once.
    """

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, metric: str, drop_self: bool, floor: np.ndarray | None = None, repeats: bool = False):
        self.qid, self.q, self.k, self.metric, self.drop_self, self.repeats = qid, q, k, metric, drop_self, repeats
        self.fast, self.sq = self._prepared(q)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.bound = self._near(self.floor).copy()
        self.found, self.size, self.kept = [], 0, 0

    def _prepared(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (m.astype(np.float32) if self.metric == "cosine" else m), np.einsum("ij,ij->i", m, m)

    def _near(self, score: np.ndarray) -> np.ndarray:
        """What a score is among the products."""
        return score if self.metric == "cosine" else -((1.0 - score) ** 2)

    def meet(self, sid: np.ndarray, s: np.ndarray, meetings) -> None:
        """``meetings`` yields which seeds meet which rows of a block, as two arrays of positions."""
        fast, sq = self._prepared(s)
        if self.metric == "cosine":
            slack = (s.shape[1] + 8) * 2.0**-22
        else:
            slack = _SLACK * (1.0 + self.sq.max() + sq.max()) if len(s) and len(self.q) else 0.0
        likely, waiting = [], 0
        for rows, cols in meetings:
            library = fast[cols]
            for c in range(0, len(cols), _WIDE):
                there = cols[c : c + _WIDE]
                tile, step = library[c : c + _WIDE].T, max(1, _AT_ONCE // len(there))
                for a in range(0, len(rows), step):
                    r = rows[a : a + step]
                    near = self.fast[r] @ tile
                    if self.metric == "euclidean":
                        near = 2 * near - self.sq[r][:, None] - sq[there][None, :]
                    least = self.bound[r]
                    if len(there) > self.k and (fresh := np.nonzero(np.isneginf(least))[0]).size:
                        first = near[fresh]
                        if self.drop_self:
                            first[self.qid[r[fresh]][:, None] == sid[there][None, :]] = -np.inf
                        least[fresh] = np.partition(first, len(there) - self.k, axis=1)[:, len(there) - self.k]
                    at = _places(near >= (least - slack).astype(near.dtype)[:, None])
                    if at.size:
                        i, j = np.divmod(at, len(there))
                        likely.append((r[i], there[j]))
                        waiting += at.size
                        if waiting >= _RESCORED // 4:
                            self._add(likely, sid, s)
                            likely, waiting = [], 0
        self._add(likely, sid, s)

    def _add(self, pairs: list[tuple[np.ndarray, np.ndarray]], sid: np.ndarray, s: np.ndarray) -> None:
        if not pairs:
            return
        i, j = (np.concatenate(c) for c in zip(*pairs))
        if self.drop_self:
            other = self.qid[i] != sid[j]
            i, j = i[other], j[other]
        score = _scores(self.q, s, i, j, self.metric)
        fit = (score >= self.floor[i] - _SLACK) & np.isfinite(score)
        self.found.append((i[fit], sid[j[fit]], score[fit]))
        self.size += int(fit.sum())
        if self.size - self.kept > max(_PENDING, self.kept):
            self._sort_out()

    def _sort_out(self) -> None:
        """Keep the best of what was found, and know what a better one must exceed."""
        if not self.found:
            return
        i, ids, score = (np.concatenate(c) for c in zip(*self.found))
        o = np.lexsort((ids, -score, i))
        i, ids, score = i[o], ids[o], score[o]
        if self.repeats and len(i):
            new = np.append(True, (i[1:] != i[:-1]) | (ids[1:] != ids[:-1]))
            i, ids, score = i[new], ids[new], score[new]
        begins = np.searchsorted(i, np.arange(len(self.q) + 1))
        keep = np.arange(len(i)) - begins[i] < self.k
        full = np.nonzero(np.diff(begins) >= self.k)[0]
        self.bound[full] = np.maximum(self.bound[full], self._near(score[begins[full] + self.k - 1]))
        self.found = [(i[keep], ids[keep], score[keep])]
        self.size = self.kept = int(keep.sum())

    def table(self, fields) -> pa.Table:
        self._sort_out()
        i, ids, score = self.found[0] if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(
            [pa.array(self.qid[i].tolist(), fields[0]), pa.array(ids.tolist(), fields[1]), pa.array(score)],
            names=["query_id", "id", "score"],
        )


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a mask with few true values is true; eight of its values are looked at in one."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = np.flatnonzero(flat.view(np.uint64))
    row, place = np.nonzero(flat.reshape(-1, 8)[at])
    return at[row] * 8 + place


def _group_top_k(seeds: pa.Table, block: pa.Table, meetings, k: int, metric: str, drop_self: bool, fields) -> pa.Table:
    """Best ``k`` of one block for every seed of one chunk; a pair of ``meetings`` comes once."""
    best = _Best(_ids(seeds.column("query_id")), _matrix(seeds.column("point")), k, metric, drop_self)
    best.meet(_ids(block.column("id")), _matrix(block.column("point")), meetings)
    return best.table(fields)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return np.array(column.to_pylist())


def pass_chunks(seeds: DataFrame, library: DataFrame, dims: int, chunks: int, k: int, metric: str, drop_self: bool, meetings, block_rows: int, repeats: bool = False) -> DataFrame:
    """``query_id, id, score``: the best ``k`` rows of every seed among the library rows sent past its chunk.

    ``seeds``: ``query_id, packed, chunk`` and a ``floor`` for scores; ``library``: ``id, packed, chunk`` and ``place`` (from 0), by which a chunk's rows come in order.
    Either has one column more, ``asks`` and ``has``. ``meetings(seeds, best)`` is called once a chunk and gives a function that says for a block
    which seeds meet which of its rows. A task holds one chunk of seeds and ``block_rows`` library rows.
    """
    qt, st = seeds.schema["query_id"].dataType, library.schema["id"].dataType
    fields = (to_arrow_type(qt), to_arrow_type(st))
    out = T.StructType([T.StructField("query_id", qt), T.StructField("id", st), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, held, rows = [], [], 0  # batches of seeds; ids and places of a block
        chunk, best, meet, points = None, None, None, None

        def sent_past() -> None:
            nonlocal best, meet, held, rows
            if best is None:
                if not asking:
                    return
                t = pa.Table.from_batches(asking)
                asking.clear()
                best = _Best(_ids(t.column("query_id")), _points(_unpacked(t.column("packed"), dims), metric, 1), k, metric, drop_self, t.column("floor").to_numpy(), repeats)
                meet = meetings(t, best)
            if rows:
                block = pa.concat_tables(held)
                best.meet(_ids(block.column("id")), points[:rows], meet(block))
            held, rows = [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal best
            sent_past()
            if best is not None:
                yield from best.table(fields).to_batches(max_chunksize=65_536)
            best = None

        for b in batches:
            if b.num_rows == 0:
                continue
            at, asks = b.column("chunk").to_numpy(), b.column("place").to_numpy() < 0
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if at[x] != chunk:
                    yield from ended()
                    chunk = at[x]
                if asks[x]:
                    asking.append(b.slice(x, y - x))
                    continue
                while x < y:
                    z = min(y, x + max(1, block_rows - rows))
                    part = b.slice(x, z - x)
                    m = _points(_unpacked(part.column("packed"), dims), metric, 0)
                    if points is None:
                        points = np.empty((block_rows, m.shape[1]))
                    points[rows : rows + z - x] = m
                    held.append(pa.table({c: part.column(c) for c in ("id", "has")}))
                    rows += z - x
                    if rows >= block_rows:
                        sent_past()
                    x = z
        yield from ended()

    seeds = seeds.select("query_id", "packed", "floor", "asks", F.col("chunk").cast("int").alias("chunk"), F.lit(-1).cast("bigint").alias("place"))
    library = library.select("id", "packed", "has", F.col("chunk").cast("int").alias("chunk"), F.col("place").cast("bigint").alias("place"))
    both = seeds.unionByName(library, allowMissingColumns=True)
    return both.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "place").mapInArrow(run, out)


def chunk_count(seeds: int, k: int, spark, chunk_rows: int) -> int:
    """Chunks for a number of seeds: none larger than ``chunk_rows``, as many for each core, and no core without one where seeds are enough."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    least = -(-seeds // max(1, min(chunk_rows, (1 << 22) // k)))
    return max(1, -(-least // cores) * cores if least > 1 else min(cores, -(-seeds // _TILE)))


def _top_k(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _parcels(count: np.ndarray) -> np.ndarray:
    """The parcel of each cell: consecutive cells with at most ``BLOCK_ROWS`` rows together; a larger cell is alone."""
    parcel, held = np.zeros(len(count), int), 0
    for c, n in enumerate(count):
        start = c > 0 and held + n > BLOCK_ROWS
        parcel[c] = (parcel[c - 1] if c else 0) + start
        held = n if start else held + n
    return parcel


def _by_cell(seeds: pa.Table, best: _Best):
    """The seeds that ask for each cell of a block, and the cell's rows."""
    asked = np.frombuffer(b"".join(seeds.column("asks").to_pylist()), np.uint8).reshape(seeds.num_rows, -1)

    def meet(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell = block.column("has").to_numpy()
        order = np.argsort(cell, kind="stable")
        cells, begins = np.unique(cell[order], return_index=True)
        for c, cols in zip(cells, np.split(order, begins[1:])):
            rows = np.nonzero(asked[:, c >> 3] >> (7 - (c & 7)) & 1)[0]
            if len(rows):
                yield rows, cols

    return meet


def _meet(index: NeighbourIndex, probes: DataFrame, k: int, drop_self: bool) -> DataFrame:
    """Send the cells that seeds ask for past these seeds; at most k rows per seed.

    Seeds of neighbouring home parcels share a chunk; a large parcel's seeds are dealt over several.
    """
    parcel = _parcels(index.count)
    held = np.zeros(parcel[-1] + 1, int)
    for r in probes.groupBy("home").count().collect():  # at most MAX_CELLS rows
        held[r.home] = r["count"]
    chunk_rows = -(-int(held.sum()) // chunk_count(int(held.sum()), k, probes.sparkSession, CHUNK_ROWS))
    first, parts, chunks, last = [], [], 0, 0
    for n in held.tolist():
        if chunks and last + n <= chunk_rows:  # it joins the chunk before
            first, parts, last = [*first, chunks - 1], [*parts, 1], last + n
        else:
            more = max(1, -(-n // max(1, chunk_rows)))
            first, parts, chunks, last = [*first, chunks], [*parts, more], chunks + more, chunk_rows if more > 1 else n

    def of(values: Sequence[str], place: str) -> Column:
        return F.get(F.expr(f"array({', '.join(values)})"), F.col(place))  # one parse, not a call for each

    dealt = F.pmod(F.xxhash64("query_id"), of([str(p) for p in parts], "home")).cast("int")
    seeds = probes.withColumn("chunk", of([str(f) for f in first], "home") + dealt)
    wanted: list[list[str]] = [[] for _ in held]
    for r in seeds.select("chunk", F.explode("parcels").alias("parcel")).distinct().collect():
        wanted[r.parcel].append(str(r.chunk))
    lists = [f"cast(array({', '.join(w)}) as array<int>)" for w in wanted]
    library = index.rows.withColumn("parcel", of([str(p) for p in parcel], "cell"))
    library = library.withColumn("chunk", F.explode(of(lists, "parcel"))).select("id", "packed", "chunk", F.col("cell").alias("place"), F.col("cell").alias("has"))
    seeds = seeds.select("query_id", "packed", "floor", F.col("cells").alias("asks"), "chunk")
    return pass_chunks(seeds, library, index.dims, max(1, chunks), k, index.metric, drop_self, _by_cell, BLOCK_ROWS)


def knn_join(
    index: NeighbourIndex,
    seeds: DataFrame,
    k: int,
    exclude_self: bool = True,
    id_col: str = "id",
    vector: str = "vector",
    report: list[int] | None = None,
) -> DataFrame:
    """The ``k`` nearest library rows of every seed: ``query_id, id, score, rank``.

    Exact, with ties broken by id. Seed ids must be distinct. ``exclude_self`` drops the
    library row whose id is the seed's id. ``report`` gets the number of pairs that each round compares.
    """
    if k > index.k_max:
        raise ValueError(f"k={k} exceeds the index's k_max={index.k_max}")
    metric, pivots, count = index.metric, index.pivots, index.count
    arrays = (index.pivots, index.count, index.nearest, index.farthest)
    q = seeds.select(
        F.col(id_col).alias("query_id"), F.col(vector).cast("array<double>").alias("v")
    )
    probe_schema = T.StructType(
        [
            q.schema["query_id"],
            T.StructField("packed", T.BinaryType()),
            T.StructField("home", T.IntegerType()),
            T.StructField("parcels", T.ArrayType(T.IntegerType())),
            T.StructField("cells", T.BinaryType()),
            T.StructField("floor", T.DoubleType()),
            T.StructField("pairs", T.LongType()),
        ]
    )
    need = k + 1
    parcel = _parcels(count)
    edges = np.searchsorted(parcel, np.arange(parcel[-1] + 2))
    thetas = [f"theta{i}" for i in range(2)]

    def probes(rounds: int):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows == 0:
                    continue
                m = _matrix(b.column("v"))
                p = _points(m, metric, 1)
                known = [b.column(t).to_numpy(zero_copy_only=False) for t in thetas[:rounds]]
                for a in range(0, len(p), _SLICE):
                    part = slice(a, a + _SLICE)
                    if len(count) == 1:
                        mask, home = np.ones((len(p[part]), 1), bool), np.zeros(len(p[part]), int)
                    else:
                        mask = _asked_cells(p[part], arrays, need, [t[part] for t in known], rounds == 2)
                        home = parcel[np.where(count > 0, _distances(p[part], pivots), np.inf).argmin(axis=1)]
                    i = np.nonzero(mask.any(axis=1))[0]
                    if not len(i):
                        continue
                    mask = mask[i]
                    theta = known[-1][part][i] if rounds else np.full(len(i), np.inf)
                    floor = (1 - theta**2 / 2 if metric == "cosine" else 1 - theta) - _SLACK * (1 + theta)
                    at, there = np.nonzero(np.logical_or.reduceat(mask, edges[:-1], axis=1))
                    parcels = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(i) + 1)).astype(np.int32)), pa.array(there.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("query_id").take(pa.array(i + a)), _packed(m[i + a]), pa.array(home[i].astype(np.int32)), parcels,
                            pa.array([c.tobytes() for c in np.packbits(mask, axis=1)], pa.binary()), pa.array(np.where(np.isfinite(theta), floor, -np.inf)),
                            pa.array(mask @ count),
                        ],
                        probe_schema.names,
                    )

        return emit

    reach = (
        F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))
        if metric == "cosine"
        else 1 - F.col("score")
    )
    best, asking = None, q
    for rounds in range(1 if len(count) == 1 else 3):
        asked = asking.mapInArrow(probes(rounds), probe_schema)
        asked = asked if rounds == 0 else materialise(asked)
        if report is not None:
            report.append(asked.agg(F.coalesce(F.sum("pairs"), F.lit(0))).head()[0])
        met = _meet(index, asked, k, exclude_self)
        best = _top_k(met if best is None else best.unionByName(met), k)
        if len(count) == 1 or rounds == 2:
            return best
        best = materialise_table(best.drop("rank"))
        theta = best.groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= k, F.max(reach)).otherwise(F.lit(float("inf"))).alias(thetas[rounds])
        )
        asking = asking.join(theta, "query_id", "left").withColumn(thetas[rounds], F.coalesce(thetas[rounds], F.lit(float("inf"))))
    return best


def without_excluded(
    neighbours: DataFrame, exclusions: DataFrame, n: int, overfetch: int = OVERFETCH
) -> DataFrame:
    """Drop excluded ``(query_id, id)`` pairs from the best ``overfetch * n``, keep ``n``."""
    fresh = neighbours.where(F.col("rank") <= overfetch * n).join(
        exclusions.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti"
    )
    return _top_k(fresh.drop("rank"), n)
