"""Finding hot keys and joining on them.

Every operator that groups by user, device, playlist, track or seed assumes that one
key may own a large share of all rows. Hot keys are found with one map-side combined
count and handled apart; all other keys take the ordinary route.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows of one key that a single task may order or join comfortably.
HOT_ROWS = 1_000_000

# Hot keys are looked up before the real plan is built, so that tables without any get
# the plain plan. The list is broadcast; it holds at most this many keys by construction.
# A key left out of it is smaller than the 10,000 largest ones, hence has at most
# 1/10,000 of all rows, and goes through the ordinary (spilling) shuffle.
MAX_HOT_KEYS = 10_000


def hot_keys(df: DataFrame, key: str, hot_rows: int, *aggs: Column) -> list[Row]:
    """Keys with more than ``hot_rows`` rows: rows ``key, n`` and the given aggregates."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return _largest(counts, hot_rows)


def _largest(counts: DataFrame, hot_rows: int) -> list[Row]:
    return (
        counts.where(F.col("n") > hot_rows).orderBy(F.desc("n"), "key").limit(MAX_HOT_KEYS).collect()
    )


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A broadcast table of at most ``MAX_HOT_KEYS`` rows. Sent as Arrow, which needs no Python worker to be read."""
    assert len(rows) <= MAX_HOT_KEYS
    kinds = to_arrow_schema(schema)
    table = pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)
    return F.broadcast(spark.createDataFrame(table, schema))


def hot_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose left side may be skewed and whose right side is near unique.

    Rows of a hot key on the left are spread over ``ceil(n / hot_rows)`` salts by the
    deterministic expression ``spread_by``; only the right rows of those keys are
    copied once per salt. ``how`` is ``inner`` or ``left``. ``counts`` (``key, n``) spares
    counting the left side where that was done before.
    """
    found = hot_keys(left, key, hot_rows) if counts is None else _largest(counts, hot_rows)
    hot = [r for r in found if r.key is not None]
    if not hot:
        return left.join(right, key, how)
    schema = T.StructType(
        [T.StructField("_hot_key", left.schema[key].dataType), T.StructField("_salts", T.LongType())]
    )
    salts = small_table(
        left.sparkSession, [(r.key, -(-r.n // hot_rows)) for r in hot], schema
    )
    n = F.coalesce("_salts", F.lit(1).cast("bigint"))
    salted_left = (
        left.join(salts, left[key] == F.col("_hot_key"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), n))
        .drop("_hot_key", "_salts")
    )
    salted_right = (
        right.join(salts, right[key] == F.col("_hot_key"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
        .drop("_hot_key", "_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
