"""Reproducible pseudo-random order, the same in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def random_key(seed: int, *keys: str | Column) -> Column:
    """md5 of ``seed|key|...``: sorting by it shuffles, whatever the partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in keys]))


def _text(key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def hash_share(seed: int, *keys: str | Column) -> Column:
    """Uniform number in [0, 10000) for splits, from the first seven hex digits of the key."""
    return F.pmod(F.conv(F.substring(random_key(seed, *keys), 1, 7), 16, 10).cast("long"), F.lit(10000))
