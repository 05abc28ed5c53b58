"""Pairwise-complete sums of many columns in one scan.

Every task keeps one matrix of sums per kind - rows in which both columns are present, their values, squares and products - and
adds whole Arrow batches to it by matrix products with null masks. What is shuffled is one row per pair of columns and task, pre-aggregated
on the way, so 80 columns cost one scan instead of one per few hundred pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.functions.values import named

#: Rows whose means stand for the columns' size; sums are taken around them, so large values lose no digits.
HEAD = 256
_SUMS = ("n", "sum_a", "sum_b", "square_a", "square_b", "product")
#: Below this share of the squares a sum of squared deviations is rounding: the column is constant there.
CONSTANT = 1e-13


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, n, sum_a, sum_b, square_a, square_b, product)`` of every pair of columns, over rows where both are present.

    Sums are of the values less a fixed number per column. An empty table gives no rows.
    """
    columns = list(columns)
    numbers = df.select(*[named(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    head = numbers.limit(HEAD).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in numbers.columns]).first()
    centre = np.nan_to_num(np.array(head, float), nan=0.0, posinf=0.0, neginf=0.0)
    left, right = np.triu_indices(len(columns), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            there = np.stack([pc.is_valid(c).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            x = np.stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x = np.where(there > 0, x - centre, 0.0)
            with np.errstate(invalid="ignore", over="ignore"):
                part = np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
            total = part if total is None else total + part
        if total is None:
            return
        n, s, q, p = total
        values = [n[left, right].astype(np.int64), s[left, right], s[right, left], q[left, right], q[right, left], p[left, right]]
        yield pa.RecordBatch.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *map(pa.array, values)], names=["i", "j", *_SUMS])

    schema = "i int, j int, n long, " + ", ".join(f"{c} double" for c in _SUMS[1:])
    names = F.array(*[F.lit(c) for c in columns])
    merged = numbers.mapInArrow(sums, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return merged.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), *_SUMS)


def pair_correlation() -> Column:
    """Pearson correlation from ``pair_sums``; null when a column is constant over the common rows or there are none."""
    spread = {}
    for side in "ab":
        squares = F.col(f"square_{side}")
        deviation = squares - F.col(f"sum_{side}") * F.col(f"sum_{side}") / F.col("n")
        spread[side] = F.when(deviation > CONSTANT * squares, deviation)
    shared = F.col("product") - F.col("sum_a") * F.col("sum_b") / F.col("n")
    return F.when(F.col("n") > 0, shared / F.sqrt(spread["a"]) / F.sqrt(spread["b"]))
