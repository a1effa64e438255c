"""Ordered per-key scans that do not put a hot key into one task.

A plain window function orders all rows of a key in one task. Here the rows of a hot
key are cut into consecutive slices of its ordering column, each slice is an own
window partition, and what earlier slices contribute (a last value, a running count,
the last n rows) is computed from small per-slice summaries and put in front of the
slice as carry rows. Cold keys form a single slice and need no carry rows, so the
main pass is one shuffle on ``(key, slice)`` in both cases; a table without hot keys gets
exactly the plain window plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from trackspark.operators.skew import HOT_ROWS, hot_keys, small_table
from trackspark.session import materialise

SLICE = "_slice"
HOT = "_hot"
SEQ = "_seq"  # 0: carry row in front of a slice, 1: real row, 2: row after a slice
_INTERNAL = (SLICE, HOT, SEQ)


#: Rows a slice's cuts are estimated from: slices stay within twice the wanted size.
SAMPLES = 64
#: Slices of all hot keys together, whose cut points are broadcast. A log with more rows than this many slices hold gets larger slices.
MAX_SLICES = 100_000


@dataclass(frozen=True)
class Slices:
    """How the hot keys of a log are cut: a small table ``_hot_key, _cuts``, or None without hot keys.

    ``_cuts`` are ascending values of the whole order (time and tie-break); a row belongs to the slice numbered by
    how many cuts are not after it.
    """

    key: str
    order: tuple[str, ...]
    cuts: DataFrame | None

    def apply(self, df: DataFrame) -> DataFrame:
        """Add ``_slice`` (0 for cold keys) and ``_hot``."""
        if self.cuts is None:
            return df.withColumn(SLICE, F.lit(0)).withColumn(HOT, F.lit(False))
        here = F.struct(*[F.col(o) for o in self.order])
        cuts = F.broadcast(self.cuts)
        return (
            df.join(cuts, df[self.key].eqNullSafe(F.col("_hot_key")), "left")
            .withColumn(HOT, F.col("_cuts").isNotNull())
            .withColumn(SLICE, F.when(F.col(HOT), _cuts_upto(F.col("_cuts"), here)).otherwise(0))
            .drop("_hot_key", "_cuts")
        )

    def between_scans(self, df: DataFrame) -> DataFrame:
        """Keep a scan's result for the next one. Only hot keys make a scan read its input
        twice, so without them the scans stay one plan."""
        return df if self.cuts is None else materialise(df)


def _cuts_upto(cuts: Column, here: Column) -> Column:
    """How many of the ascending ``cuts`` are at or before ``here``: bisection by powers of two."""
    steps = F.array(*[F.lit(1 << b) for b in range(MAX_SLICES.bit_length() - 1, -1, -1)])

    def step(found: Column, more: Column) -> Column:
        at = found + more
        return F.when((at <= F.size(cuts)) & (F.get(cuts, at - 1) <= here), at).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def find_slices(df: DataFrame, key: str, order: Sequence[str], hot_rows: int = HOT_ROWS) -> Slices:
    """Look for hot keys and cut each into slices of about ``hot_rows`` rows, however its rows lie in time.

    Cuts are quantiles of the whole order, from a sample of the hot keys' rows that is drawn by the rows' hash, so it is the same every
    time. Bursts and equal times make slices no larger. Slices found on a log stay valid for any subset of it.
    """
    fields = [df[o] for o in order]
    rows = df.select(df[key].alias("_hot_key"), F.struct(*fields).alias("_at"))
    hot = hot_keys(rows, "_hot_key", hot_rows)
    if not hot:
        return Slices(key, tuple(order), None)
    size = max(hot_rows, -(-sum(r.n for r in hot) // MAX_SLICES))
    kind = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_slices", T.LongType())])
    wanted = small_table(df.sparkSession, [(r.key, max(1, -(-r.n // size))) for r in hot], kind)
    one_in = max(1, size // SAMPLES)
    drawn = rows.where(F.pmod(F.xxhash64("_hot_key", "_at"), F.lit(one_in)) == 0)
    drawn = drawn.join(wanted, F.col("_hot_key").eqNullSafe(F.col("_key")))
    held = drawn.groupBy("_hot_key").agg(F.sort_array(F.collect_list("_at")).alias("_all"), F.first("_slices").alias("_slices"))
    place = lambda i: F.floor(i * F.size("_all") / F.col("_slices")).cast("int")
    inner = F.when(F.col("_slices") > 1, F.sequence(F.lit(1).cast("bigint"), F.col("_slices") - 1)).otherwise(F.array().cast("array<bigint>"))
    cuts = held.select("_hot_key", F.array_distinct(F.transform(inner, lambda i: F.get("_all", place(i)))).alias("_cuts"))
    return Slices(key, tuple(order), materialise(cuts))  # at most MAX_SLICES values


def window(key: str, order: Sequence[str]):
    """Window over one slice, carry rows first."""
    return Window.partitionBy(key, SLICE).orderBy(SEQ, *order)


def with_carry(sliced: DataFrame, *carries: DataFrame) -> DataFrame:
    """Real rows plus carry rows (which bring their own ``_seq``)."""
    out = sliced.withColumn(SEQ, F.lit(1))
    for c in carries:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def real_rows(df: DataFrame, *drop: str) -> DataFrame:
    return df.where(F.col(SEQ) == 1).drop(*_INTERNAL, *drop)


def last_known(df: DataFrame, slices: Slices, value: Column, out: str) -> DataFrame:
    """Per row, the last non-null ``value`` of its key up to and including the row.

    ``value`` may be a struct, so that null fields inside a known value are kept.
    """
    key, order = slices.key, slices.order
    rows = slices.apply(df.withColumn("_value", value))
    carries = []
    if slices.cuts is not None:
        per_slice = (
            rows.where(HOT)
            .groupBy(key, SLICE)
            .agg(
                F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_value")
            )
        )
        before = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carries = [
            per_slice.select(
                key,
                SLICE,
                F.last("_value", ignorenulls=True).over(before).alias("_value"),
                F.lit(0).alias(SEQ),
            ).where(F.col("_value").isNotNull())
        ]
    upto = window(key, order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = with_carry(rows, *carries).withColumn(out, F.last("_value", ignorenulls=True).over(upto))
    return real_rows(scanned, "_value")


def count_since(df: DataFrame, slices: Slices, event: Column, reset: Column, out: str) -> DataFrame:
    """Per row, how many ``event`` rows came after the last ``reset`` row, itself included."""
    key, order = slices.key, slices.order
    rows = slices.apply(
        df.withColumn("_weight", F.coalesce(event, F.lit(False)).cast("bigint")).withColumn(
            "_reset", F.coalesce(reset, F.lit(False))
        )
    )
    upto = window(key, order).rowsBetween(Window.unboundedPreceding, 0)
    at_reset = F.max(F.when(F.col("_reset"), F.col("_total"))).over(upto)

    def scan(sliced: DataFrame) -> DataFrame:
        return sliced.withColumn("_total", F.sum("_weight").over(upto)).withColumn(
            out, F.col("_total") - F.coalesce(at_reset, F.lit(0))
        )

    carries = []
    if slices.cuts is not None:
        # What a hot slice hands on: its own trailing count, and whether it was reset.
        handed = (
            scan(with_carry(rows.where(HOT).select(key, SLICE, *order, "_weight", "_reset")))
            .groupBy(key, SLICE)
            .agg(
                F.max_by(out, F.struct(*order)).alias("_tail"),
                F.max(F.col("_reset").cast("int")).alias("_was_reset"),
            )
        )
        by_slice = Window.partitionBy(key).orderBy(SLICE)
        era = F.sum("_was_reset").over(by_slice.rowsBetween(Window.unboundedPreceding, 0))
        since = Window.partitionBy(key, "_era").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
        carries = [
            handed.withColumn("_era", era)
            .withColumn("_handed", F.sum("_tail").over(since))
            .select(
                key,
                SLICE,
                F.lag("_handed").over(by_slice).alias("_weight"),
                F.lit(False).alias("_reset"),
                F.lit(0).alias(SEQ),
            )
            .where(F.col("_weight").isNotNull())
        ]
    return real_rows(scan(with_carry(rows, *carries)), "_weight", "_reset", "_total")


def with_preceding(df: DataFrame, slices: Slices, columns: Sequence[str], n: int) -> DataFrame:
    """Sliced rows, each slice led by the last ``n`` rows of its key before the slice.

    Windows over :func:`window` that look back at most ``n`` rows then see what they
    would see over the whole key. Finish with :func:`real_rows`.
    """
    key, order = slices.key, slices.order
    rows = slices.apply(df)
    if slices.cuts is None:
        return with_carry(rows)
    backwards = Window.partitionBy(key, SLICE).orderBy(*[F.desc(o) for o in order])
    fields = list(dict.fromkeys([*order, *columns]))
    tails = (
        rows.where(HOT)
        .select(key, SLICE, F.struct(*fields).alias("_row"), *order)
        .withColumn("_rn", F.row_number().over(backwards))
        .where(F.col("_rn") <= n)
        .groupBy(key, SLICE)
        .agg(F.sort_array(F.collect_list("_row")).alias("_tail"))
    )
    # A slice in the summary is never empty, so n earlier slices hold n rows.
    earlier = Window.partitionBy(key).orderBy(SLICE).rowsBetween(-n, -1)
    carry = (
        tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(earlier)))
        .select(
            key,
            SLICE,
            F.explode(
                F.slice("_all", F.greatest(F.size("_all") - n + 1, F.lit(1)), F.lit(n))
            ).alias("_row"),
        )
        .select(key, SLICE, "_row.*", F.lit(0).alias(SEQ))
    )
    return with_carry(rows, carry)


def last_n_per_key(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` latest rows per key.

    The rank filter becomes a group limit below the shuffle, so each map task sends at
    most ``n`` rows per key however hot the key is.
    """
    latest = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return (
        df.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= n).drop("_rn")
    )
