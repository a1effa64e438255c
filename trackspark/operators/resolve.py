"""Resolving loosely given track names to catalogue paths.

Four tiers, the first that matches wins, then the first path in table order:

1. the path itself;
2. the path ends with the given base name;
3. if the base name has `` - ``, the path contains the trimmed text before it;
4. the path contains the base name without suffix.

Matches are literal and case-sensitive; an empty text matches nothing.

Tiers 2 to 4 look for text inside text. Names of up to ``AUTOMATON_BYTES`` together travel to the tasks as one automaton, and every path runs
through it once; a task sends each name's first path only. Beyond that size names and paths are cut into grams of up to eight bytes; each
name is looked up by its least common gram only, as a table of bounded size has counted them. Paths send the grams that
pass a filter of those looked up, an equi-join, and the few candidates are verified with the tier's own condition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trackspark.functions.paths import base_name, stem, strip
from trackspark.operators.skew import HOT_ROWS, hot_join
from trackspark.session import materialise

GRAM_LENGTHS = (8, 4, 2, 1)
SLICE_BITS = 8  # tables by the top bits of gram keys are made in 2^8 slices
COMMONNESS_BITS = 24  # of a byte each
FILTER_BITS = 22  # of eight bytes each
COUNTING_TASKS = 32
#: Distinct names, in bytes, up to which they are matched by an automaton in every worker: some fifty times that in memory.
AUTOMATON_BYTES = 8 << 20

_built: dict[str, object] = {}  # the last automaton of this worker, by the run it belongs to


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all stretches of ``length`` bytes, text after text, and the number of each one's text. Text in text is
    bytes in bytes in UTF-8; stretches of different lengths may share a key, so what is found is verified."""
    if not len(texts):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    n = max(0, len(raw) - length + 1)
    code = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        code = code << np.uint64(8) | raw[i : i + n]
    row = np.repeat(np.arange(len(texts)), np.diff(ends))[:n]
    inside = np.arange(n) + length <= ends[1:][row]
    return _mixed(code[inside] + np.uint64(8 - length) * np.uint64(0x9E3779B97F4A7C15)), row[inside]


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _bits_for(entries: int, most: int) -> int:
    """Binary logarithm of a table size for so many entries: not less than one entry a slice."""
    return min(max(int(entries).bit_length(), SLICE_BITS), most)


def _whole(slices: DataFrame, bits: int, kind) -> np.ndarray:
    """The table of ``slice, part`` whose slices were made in Spark, for the tasks; a missing slice is zero."""
    out = np.zeros((1 << SLICE_BITS, 1 << bits - SLICE_BITS), dtype=kind)
    for r in slices.collect():  # 2^24 bytes or 2^25 at most
        out[r.slice] = np.frombuffer(r.part, dtype=kind)
    return out.ravel()


def _commonness(paths: DataFrame, lengths: list[int]) -> np.ndarray:
    """How common the grams of the paths are, in eighths of a binary logarithm, in a table by the top bits of their keys; 0 where no
    path has one. It only says which gram a name is looked up by: any choice finds the same."""
    size = paths.agg(F.sum(F.octet_length("file_path"))).head()[0] or 0
    bits = _bits_for(size * len(lengths) // 16, COMMONNESS_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=np.uint32)
        for b in batches:
            for g in lengths:
                np.add.at(seen, _top(_grams(b.column("file_path"), g)[0], bits), np.uint32(1))
        parts = np.split(seen, 1 << SLICE_BITS)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(parts)), pa.int32()), "seen": pa.array([p.tobytes() for p in parts], pa.binary())})

    def merge(key, table):
        n = sum(np.frombuffer(v.as_buffer(), dtype=np.uint32).astype(np.int64) for v in table["seen"])
        levels = np.minimum(np.ceil(8 * np.log2(1 + n)), 255).astype(np.uint8)
        return pa.table({"slice": table["slice"].slice(0, 1).combine_chunks(), "part": pa.array([levels.tobytes()], pa.binary())})

    tasks = min(paths.sparkSession.sparkContext.defaultParallelism, COUNTING_TASKS)
    counted = paths.select("file_path").coalesce(tasks).mapInArrow(count, "slice int, seen binary")
    return _whole(counted.groupBy("slice").applyInArrow(merge, "slice int, part binary"), bits, np.uint8)


def _anchors(wanted: DataFrame, levels: np.ndarray) -> DataFrame:
    """``needle, at_end, gram``: each name's least common gram, by which it is looked up. A name with a gram that no path has is left out."""
    shared, bits = wanted.sparkSession.sparkContext.broadcast(levels), len(levels).bit_length() - 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(v) for v in b.column("needle").cast(pa.large_binary()).to_pylist()])
            taken = np.zeros(len(size), dtype=bool)
            for g in GRAM_LENGTHS:
                own = b.filter(pa.array((size >= g) & ~taken))
                taken |= size >= g
                if own.num_rows:
                    keys, row = _grams(own.column("needle"), g)
                    level = shared.value[_top(keys, bits)]
                    by = np.lexsort((keys, level, row))
                    first = by[np.searchsorted(row, np.arange(own.num_rows))]
                    made = pa.RecordBatch.from_arrays([*own.columns, pa.array(keys[first].view(np.int64))], names=["needle", "at_end", "gram"])
                    yield made.filter(pa.array(level[first] > 0))

    return wanted.select("needle", "at_end").mapInArrow(pick, "needle string, at_end boolean, gram long")


def _marks(keys: np.ndarray) -> np.ndarray:
    """Three bits of a word for each key."""
    one, six = np.uint64(1), np.uint64(63)
    return one << (keys & six) | one << (keys >> np.uint64(6) & six) | one << (keys >> np.uint64(12) & six)


def _filter(anchors: DataFrame) -> np.ndarray:
    """A Bloom filter of the anchors' grams: words by the top bits of the keys, some 16 bits a name while that fits."""
    bits = _bits_for(anchors.count() // 4, FILTER_BITS)

    def mark(key, table):
        words = np.zeros(1 << bits - SLICE_BITS, dtype=np.uint64)
        keys = table["gram"].to_numpy().view(np.uint64)
        np.bitwise_or.at(words, _top(keys, bits) & len(words) - 1, _marks(keys))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([words.tobytes()], pa.binary())})

    top = F.shiftrightunsigned("gram", 64 - SLICE_BITS).cast("int").alias("slice")
    return _whole(anchors.select(top, "gram").groupBy("slice").applyInArrow(mark, "slice int, part binary"), bits, np.uint64)


def _path_grams(paths: DataFrame, lengths: list[int], words: np.ndarray) -> DataFrame:
    """``gram, _first, file_path``: of each path the grams that some name is looked up by, and few others."""
    shared, bits = paths.sparkSession.sparkContext.broadcast(words), len(words).bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in lengths:
                keys, row = _grams(b.column("file_path"), g)
                marks = _marks(keys)
                asked = shared.value[_top(keys, bits)] & marks == marks
                keys, row = keys[asked], row[asked]
                by = np.lexsort((keys, row))
                keys, row = keys[by], row[by]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                at = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), b.column("_first").take(at), b.column("file_path").take(at)], names=["gram", "_first", "file_path"])

    schema = T.StructType([T.StructField("gram", T.LongType()), paths.schema["_first"], paths.schema["file_path"]])
    return paths.select("_first", "file_path").mapInArrow(send, schema)


def _look() -> Column:
    """One key for a needle and where it must be."""
    return F.concat(F.when(F.col("at_end"), "$").otherwise("*"), F.col("needle"))


def _needles(texts: DataFrame, tiers: Sequence[int]) -> DataFrame:
    base = base_name("song_path")
    wanted = {
        2: base,
        3: F.when(F.contains(base, F.lit(" - ")), strip(F.substring_index(base, " - ", 1))),
        4: stem("song_path"),
    }
    forms = F.array(
        *[F.struct(F.lit(t).alias("tier"), wanted[t].alias("needle")) for t in (2, 3, 4) if t in tiers]
    )
    return (
        texts.select("song_path", F.inline(forms))
        .where(F.col("needle") != "")
        .withColumn("at_end", F.col("tier") == 2)
        .withColumn("look", _look())
    )


def _text_matches(needles: DataFrame, paths: DataFrame, hot_rows: int) -> DataFrame:
    """First path per distinct ``look``."""
    wanted = needles.select("needle", "at_end").distinct()
    n = F.octet_length("needle")
    length = F.coalesce(*[F.when(n >= g, g) for g in GRAM_LENGTHS])
    lengths = [r[0] for r in wanted.select(length).distinct().collect()]  # at most 4 numbers
    paths = paths.where(F.col("file_path").isNotNull())
    anchors = materialise(_anchors(wanted, _commonness(paths, lengths)))
    path_grams = materialise(_path_grams(paths, lengths, _filter(anchors)))
    fits = F.when(F.col("at_end"), F.endswith("file_path", "needle")).otherwise(
        F.contains("file_path", "needle")
    )
    return (
        hot_join(path_grams, anchors, "gram", F.col("file_path"), "inner", hot_rows)
        .where(fits)
        .groupBy("needle", "at_end")
        .agg(F.min(F.struct("_first", "file_path")).alias("_hit"))
        .select(_look().alias("look"), "_hit")
    )


def _automaton(run: str, names: list[str]):
    if run not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for n in names:
            made.add_word(n, n)
        made.make_automaton()
        _built[run] = made
    return _built[run]


def _automaton_matches(needles: DataFrame, paths: DataFrame) -> DataFrame:
    """:func:`_text_matches` of a bounded set of names: every path is read once and shuffled never."""
    spark, run = paths.sparkSession, uuid.uuid4().hex
    rows = needles.select("needle", "at_end").distinct().collect()  # AUTOMATON_BYTES at most
    inside = frozenset(r.needle for r in rows if not r.at_end)
    ends = frozenset(r.needle for r in rows if r.at_end)
    shared = spark.sparkContext.broadcast((sorted(inside | ends), inside, ends))
    schema = T.StructType([T.StructField("look", T.StringType()), paths.schema["_first"], paths.schema["file_path"]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, anywhere, at_end = shared.value
        best: dict[str, tuple] = {}
        kinds = None
        for b in batches:
            kinds = [b.schema.field(c).type for c in ("_first", "file_path")]
            for first, path in zip(b.column("_first").to_pylist(), b.column("file_path").to_pylist()):
                if not path or not names:
                    continue
                rank = (first is not None, first, path)  # nulls come first
                last = len(path) - 1
                for at, name in _automaton(run, names).iter(path):
                    for key in (["*" + name] if name in anywhere else []) + (["$" + name] if at == last and name in at_end else []):
                        if key not in best or rank < best[key]:
                            best[key] = rank
        if best:
            columns = [pa.array(list(best)), pa.array([r[1] for r in best.values()], kinds[0]), pa.array([r[2] for r in best.values()], kinds[1])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = paths.select("_first", "file_path").mapInArrow(search, schema)
    return found.groupBy("look").agg(F.min(F.struct("_first", "file_path")).alias("_hit"))


def resolve_songs(
    queries: DataFrame,
    catalog: DataFrame,
    order: str = "file_path",
    tiers: Sequence[int] = (1, 2, 3, 4),
    query_id: str = "query_id",
    hot_rows: int = HOT_ROWS,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """``queries`` with ``file_path`` and ``tier``, both null where nothing matches.

    ``order`` is the catalogue column that defines "first"; paths are listed sorted, so
    the path itself is the default.
    """
    paths = catalog.select("file_path", F.col(order).alias("_first"))
    texts = queries.select("song_path").distinct()
    if 1 in tiers:
        known = paths.select("file_path").distinct()
        exact = texts.join(known, F.col("song_path") == F.col("file_path"), "left")
        done = exact.where(F.col("file_path").isNotNull()).select(
            "song_path", "file_path", F.lit(1).alias("tier")
        )
        rest = exact.where(F.col("file_path").isNull()).select("song_path")
    else:
        done, rest = None, texts
    needles = materialise(_needles(rest, tiers))
    size = needles.select("needle", "at_end").distinct().agg(F.sum(F.octet_length("needle"))).head()[0] or 0
    if size <= automaton_bytes:
        met = needles.join(_automaton_matches(needles, paths), "look")
    else:
        parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Paths are cut into grams twice: spread them whatever their size.
        hits = _text_matches(needles, paths.repartition(parts, "file_path"), hot_rows)
        met = hot_join(needles, hits, "look", F.col("song_path"), "inner", hot_rows)
    found = (
        met.groupBy("song_path")
        .agg(F.min(F.struct("tier", "_hit")).alias("_best"))
        .select("song_path", F.col("_best._hit.file_path").alias("file_path"), F.col("_best.tier").alias("tier"))
    )
    resolved = found if done is None else done.unionByName(found)
    return hot_join(queries, resolved, "song_path", F.col(query_id), "left", hot_rows)


def resolve_one(catalog: DataFrame, text: str, order: str = "file_path", tiers: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Resolve a single name in one scan: ``file_path, tier`` (no row if nothing matches)."""
    q = F.lit(text)
    base = base_name(q)
    part = F.when(F.contains(base, F.lit(" - ")), strip(F.substring_index(base, " - ", 1)))
    path = F.col("file_path")
    tests = {
        1: path == q,
        2: (base != "") & F.endswith(path, base),
        3: (part != "") & F.contains(path, part),
        4: (stem(q) != "") & F.contains(path, stem(q)),
    }
    tier = F.coalesce(*[F.when(tests[t], t) for t in sorted(tiers)])
    return (
        catalog.select("file_path", F.col(order).alias("_first"), tier.alias("tier"))
        .where(F.col("tier").isNotNull())
        .agg(F.min(F.struct("tier", "_first", "file_path")).alias("_best"))
        .where(F.col("_best").isNotNull())
        .select("_best.file_path", "_best.tier")
    )
