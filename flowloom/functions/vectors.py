"""Arrays of class scores and features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def argmax(scores: Column) -> Column:
    """0-based position of the largest score; the first one wins ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _with(value: Column, extra: Column, use) -> Column:
    """``use(value, extra)`` with both computed once, not once per array element."""
    bound = F.array(F.struct(value.alias("value"), extra.alias("extra")))
    return F.transform(bound, lambda b: use(b["value"], b["extra"]))[0]


def softmax(scores: Column) -> Column:
    powers = _with(scores, F.array_max(scores), lambda s, top: F.transform(s, lambda x: F.exp(x - top)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return _with(powers, total, lambda p, t: F.transform(p, lambda x: x / t))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))
