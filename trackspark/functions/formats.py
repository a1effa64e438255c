"""Display formats of durations, similarities and long texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trackspark.functions.paths import col


def _minutes_seconds(seconds: Column) -> Column:
    whole = seconds.cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def duration_text(seconds: Column | str) -> Column:
    """``M:SS`` with unbounded minutes; ``--:--`` where unknown."""
    s = col(seconds).cast("double")
    return F.when(s.isNull() | F.isnan(s), "--:--").otherwise(_minutes_seconds(s))


def clock_text(seconds: Column | str) -> Column:
    """``M:SS``, ``0:00`` from zero down and where unknown."""
    s = col(seconds).cast("double")
    return F.when((s > 0) & ~F.isnan(s), _minutes_seconds(s)).otherwise("0:00")


def percent_text(similarity: Column | str) -> Column:
    """Percent without decimals, halves to even."""
    return F.concat(F.bround(col(similarity) * 100, 0).cast("int").cast("string"), F.lit("%"))


def band(similarity: Column | str) -> Column:
    s = col(similarity)
    return F.when(s > 0.7, "green").when(s > 0.5, "yellow").otherwise("red")


def head(text: Column | str, n: int) -> Column:
    return F.substring(col(text), 1, n)


def ellipsis(text: Column | str, limit: int, keep: int | None = None) -> Column:
    """Texts over ``limit`` characters become their first ``keep`` plus three dots.

    ``keep`` defaults to ``limit - 3``; menu entries use ``limit=keep=35``.
    """
    t = col(text)
    keep = limit - 3 if keep is None else keep
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, keep), F.lit("..."))).otherwise(t)
