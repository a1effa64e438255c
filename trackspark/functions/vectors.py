"""Vector arithmetic on ``array<double>`` columns of known length.

Sums are written out term by term, so they compile to plain arithmetic instead of
interpreted lambdas. They are built as SQL text: one parse instead of hundreds of
column objects.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _terms(left: Sequence[str], right: Sequence[str]) -> str:
    return " + ".join(f"{a} * {b}" for a, b in zip(left, right))


def _items(column: str, n: int) -> list[str]:
    return [f"`{column}`[{i}]" for i in range(n)]


def dot(a: str, b: str, n: int) -> Column:
    """Inner product of two array columns."""
    return F.expr(_terms(_items(a, n), _items(b, n)))


def norm(a: str, n: int) -> Column:
    return F.sqrt(dot(a, a, n))


def cosine(a: str, b: str, n: int) -> Column:
    """Cosine similarity of two array columns; 0 where either is zero."""
    d = norm(a, n) * norm(b, n)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b, n) / d)


def similarity_to(column: str, target: Sequence[float], metric: str = "cosine") -> Column:
    """``1 - distance`` to a constant vector, which is a similarity proper only for cosine."""
    n = len(target)
    numbers = [f"{float(x)!r}D" for x in target]
    if metric == "cosine":
        length = math.sqrt(sum(x * x for x in target))
        if length == 0:
            return F.lit(0.0)
        own = norm(column, n)
        return F.when(own == 0, F.lit(0.0)).otherwise(
            F.expr(_terms(_items(column, n), numbers)) / (own * length)
        )
    if metric == "euclidean":
        gaps = [f"({a} - {b})" for a, b in zip(_items(column, n), numbers)]
        return 1 - F.sqrt(F.expr(_terms(gaps, gaps)))
    raise ValueError(f"unknown metric: {metric}")
