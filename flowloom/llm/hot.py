"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.rows import free_name

#: Rows of one key that a task takes at once.
SPREAD = 4096


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, by: list[str]) -> DataFrame:
    """Inner join; ``keyed`` has the number of ``rows`` that a key meets in ``count``, and every key once or a few times.

    Where a key meets more than ``SPREAD`` rows, rows are dealt into parts by their columns ``by`` (which should differ
    within a key). Each key's rows are copied to the parts in which the key occurs, so no copy is idle and, with one row a key, the table
    stays below ``rows``. Nothing is broadcast; a part holds about ``SPREAD`` rows of the largest key, and fewer of every other.
    """
    most = keyed.agg(F.max(count)).first()[0] or 0
    parts = -(-most // SPREAD)
    if parts <= 1:
        return rows.join(keyed, keys)
    part = free_name(rows, "_part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*by), F.lit(parts)))
    copies = dealt.groupBy(*keys, part).agg(F.count(F.lit(1))).select(*keys, part).join(keyed, keys)
    return dealt.join(copies, [*keys, part]).drop(part)
