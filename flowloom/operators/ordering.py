"""Global order without a global sort task.

Rows are range-partitioned on the full ordering key, sorted inside their
partition and written once; each row carries its partition and its offset in
it. Positions and running totals then need only one small row per partition.
A key held by many rows is spread because the tie-break columns are part of
the range key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.scratch import stage

_PART, _OFFSET = "_part", "_offset"
_OFFSET_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id


@dataclass(frozen=True)
class Indexed:
    """Rows with their dense 0-based position, and the number of rows."""

    df: DataFrame
    n: int
    index: str = "i"


def _sort_keys(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys]


def stage_ordered(df: DataFrame, order_by: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` written in ``order_by`` order, with partition number and offset inside it."""
    keys = _sort_keys(order_by)
    ordered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns(
            {
                _PART: F.spark_partition_id(),
                _OFFSET: F.monotonically_increasing_id().bitwiseAND(F.lit(_OFFSET_MASK)),
            }
        )
    )
    return stage(ordered, name)


def dense_index(
    df: DataFrame, order_by: Sequence[str | Column], index: str = "i", name: str = "dense-index"
) -> Indexed:
    """Position 0..n-1 of every row in ``order_by`` order; the key must be unique."""
    staged = stage_ordered(df, order_by, name)
    # One row per written partition reaches the driver.
    sizes = sorted(staged.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = list(accumulate([r["n"] for r in sizes], initial=0))
    offsets = df.sparkSession.createDataFrame(
        pa.table(
            {
                _PART: pa.array([r[_PART] for r in sizes], pa.int32()),
                "_start": pa.array(starts[:-1], pa.int64()),
            }
        )
    )
    placed = staged.join(F.broadcast(offsets), _PART).select(
        (F.col("_start") + F.col(_OFFSET)).alias(index), *df.columns
    )
    return Indexed(placed, starts[-1], index)


def running_totals(
    df: DataFrame,
    order_by: Sequence[str | Column],
    totals: dict[str, str],
    restart_by: str | None = None,
    name: str = "running-totals",
    xor: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums of ``totals`` (value column -> result column) in key order.

    Whole-number columns named in ``xor`` are folded by exclusive or instead of addition.

    With ``restart_by`` the sums start again at each of its values; it leads
    the ordering. Sums are taken inside each range partition and shifted by
    the totals of the partitions before it.
    """
    keys = ([F.col(restart_by).asc_nulls_last()] if restart_by else []) + _sort_keys(order_by)
    staged = stage_ordered(df, keys, name)
    groups = [restart_by] if restart_by else []
    inside = Window.partitionBy(_PART, *groups).orderBy(_OFFSET).rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition and group boundary: both are bounded by partitions + groups.
    before = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    fold = {v: F.bit_xor if v in xor else F.sum for v in totals}
    part_totals = staged.groupBy(_PART, *groups).agg(*[fold[v](v).alias(v) for v in totals])
    shifts = part_totals.select(
        F.col(_PART).alias("_p"),
        *[F.col(g).alias("_g") for g in groups],
        *[F.coalesce(fold[v](v).over(before), F.lit(0)).alias(f"_before_{v}") for v in totals],
    )
    on = F.col(_PART) == F.col("_p")
    if restart_by:
        on = on & F.col(restart_by).eqNullSafe(F.col("_g"))
    return (
        staged.withColumns({out: fold[v](v).over(inside) for v, out in totals.items()})
        .join(shifts, on)
        .select(
            *[c for c in df.columns if c not in totals.values()],
            *[
                (F.col(out).bitwiseXOR(F.col(f"_before_{v}")) if v in xor else F.col(out) + F.col(f"_before_{v}")).alias(out)
                for v, out in totals.items()
            ],
        )
    )
