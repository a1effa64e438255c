"""Path and file-name expressions. All are JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trackspark.schema import TRANSCODE_SUFFIXES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_path(c: Column | str) -> Column:
    """Drop the ``file:`` scheme a local file listing carries; keep other schemes."""
    return F.regexp_replace(col(c), r"^file:(?://)?(?=/)", "")


def base_name(c: Column | str) -> Column:
    """Text after the last slash."""
    return F.substring_index(col(c), "/", -1)


def stem(c: Column | str) -> Column:
    """Base name without its last suffix; leading dots never start a suffix."""
    return F.regexp_replace(base_name(c), r"(?s)^(\.*[^.].*)\.[^.]*\z", "$1")


def suffix(c: Column | str) -> Column:
    """Lower-case last suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(base_name(c), r"(?s)^.+(\.[^.]+)\z", 1))


def size_mib(length: Column | str) -> Column:
    return col(length) / F.lit(1048576.0)


def path_key(c: Column | str) -> Column:
    """Stable 32-digit key of a path."""
    return F.md5(col(c))


def short_path_key(c: Column | str) -> Column:
    """First 12 digits of :func:`path_key`."""
    return F.substring(path_key(c), 1, 12)


def needs_transcode(c: Column | str) -> Column:
    """True where a path has one of the suffixes that take the transcoding route."""
    return suffix(c).isin(*TRANSCODE_SUFFIXES)


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space on both ends (``trim`` alone drops only blanks)."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+\z", "")
