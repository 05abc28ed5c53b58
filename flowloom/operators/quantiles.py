"""Exact quantiles at scale.

A sketch brackets each wanted quantile; one more scan counts the rows below
the bracket and the values inside it. Only the values inside are ranked, a
share of about ``4 / accuracy`` of the rows, so no column is sorted or held in
memory as a whole. A bracket that misses is replaced by the full value counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.functions.values import named
from flowloom.operators.ordering import running_totals

ACCURACY = 10_000
# In-bracket rows per quantile up to which one window task ranks them.
LOCAL_RANK_ROWS = 2_000_000

Item = tuple[str, float]


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,), accuracy: int = ACCURACY
) -> dict[Item, float | None]:
    """Sketch quantiles of all columns in one pass; an actual value of the column each."""
    row = df.agg(*[F.percentile_approx(named(c), list(probs), accuracy).alias(c) for c in columns]).first()
    return {(c, p): row[c][k] if row[c] else None for c in columns for k, p in enumerate(probs)}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,), accuracy: int = ACCURACY
) -> dict[Item, float | None]:
    """Quantiles with linear interpolation between neighbours, nulls ignored."""
    slack = 2.0 / accuracy
    edges = [b for p in probs for b in (max(0.0, p - slack), min(1.0, p + slack))]
    head = df.agg(
        *[F.percentile_approx(named(c), edges, accuracy).alias(f"b{k}") for k, c in enumerate(columns)],
        *[F.count(named(c)).alias(f"n{k}") for k, c in enumerate(columns)],
    ).first()
    sizes = {c: head[f"n{k}"] for k, c in enumerate(columns)}
    brackets = {
        (c, p): (head[f"b{k}"][2 * j], head[f"b{k}"][2 * j + 1])
        for k, c in enumerate(columns)
        for j, p in enumerate(probs)
        if sizes[c]
    }
    found = _resolve(df, brackets, sizes, accuracy)
    missed = {item: (None, None) for item in brackets if found.get(item) is None}
    if missed:
        found |= _resolve(df, missed, sizes, 1)
    return {(c, p): found.get((c, p)) for c in columns for p in probs}


def _resolve(
    df: DataFrame, brackets: dict[Item, tuple], sizes: dict[str, int], accuracy: int
) -> dict[Item, float | None]:
    if not brackets:
        return {}
    items = list(brackets)

    def inside(column: Column, low, high) -> Column:
        return column.isNotNull() if low is None else column.between(low, high)

    values = [named(c).cast("double") for c, _ in items]
    below = [F.lit(0) if brackets[item][0] is None else F.count_if(v < brackets[item][0]) for v, item in zip(values, items)]
    below = list(df.agg(*[b.alias(f"n{k}") for k, b in enumerate(below)]).first())
    entries = [
        F.when(inside(v, *brackets[item]), F.struct(F.lit(k).alias("item"), v.alias("value")))
        for k, (v, item) in enumerate(zip(values, items))
    ]
    counts = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.item", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # With the rows below an item's bracket added, running counts are global ranks.
    largest = max(sizes[c] for c, _ in items)
    keys = [F.col("value").asc()]
    if largest * 4 / accuracy <= LOCAL_RANK_ROWS:
        w = Window.partitionBy("item").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("upto", F.sum("n").over(w))
    else:
        ranked = running_totals(counts, keys, {"n": "upto"}, restart_by="item", name="quantile-ranks")
    ranked = ranked.withColumn("upto", F.col("upto") + F.element_at(F.array(*[F.lit(n) for n in below]), F.col("item") + 1))
    positions = [(sizes[c] - 1) * p for c, p in items]
    low = F.element_at(F.array(*[F.lit(int(x)) for x in positions]), F.col("item") + 1)
    high = F.element_at(F.array(*[F.lit(int(-(-x // 1))) for x in positions]), F.col("item") + 1)
    before = F.col("upto") - F.col("n")
    rows = (
        ranked.groupBy("item")
        .agg(
            F.min(F.when((F.col("upto") > low) & (before <= low), F.col("value"))).alias("lo"),
            F.min(F.when((F.col("upto") > high) & (before <= high), F.col("value"))).alias("hi"),
        )
        .collect()  # one row per column and probability
    )
    found: dict[Item, float | None] = {}
    for r in rows:
        if r["lo"] is not None and r["hi"] is not None:
            fraction = positions[r["item"]] - int(positions[r["item"]])
            found[items[r["item"]]] = r["lo"] + (r["hi"] - r["lo"]) * fraction
    return found
