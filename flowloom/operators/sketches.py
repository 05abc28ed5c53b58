"""Profiles from mergeable sketches: one small row per file and column, merged without reading the files again.

Counts, extremes, means and deviations merge exactly; distinct counts come from HyperLogLog sketches and quantiles from KLL sketches,
each within its stated error. ``profile.describe`` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowloom.functions.values import named

LG_K = 12  # HyperLogLog: 2^12 registers
QUANTILE_K = 200  # KLL
# Bounds that hold with 99 % probability or more, for the sizes above.
DISTINCT_ERROR = 0.05  # of the distinct count
RANK_ERROR = 0.0166  # of the rank, for one quantile


def file_sketches(df: DataFrame, file: str, numeric: Sequence[str] = (), text: Sequence[str] = ()) -> DataFrame:
    """``(file, column, rows, count, mean, m2, min, max, distinct, quantiles)``: one row per file and column, from one scan.

    ``m2`` is the sum of squared deviations. Text columns have no moments, extremes or quantiles. Rows of one file merge map side,
    so that a large file is sketched by all tasks that read it.
    """
    none = F.lit(None)

    def one(c: str, is_number: bool):
        x = named(c).cast("double") if is_number else named(c).cast("string")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count(x).alias("count"),
            (F.avg(x) if is_number else none.cast("double")).alias("mean"),
            (F.var_pop(x) * F.count(x) if is_number else none.cast("double")).alias("m2"),
            (F.min(x) if is_number else none.cast("double")).alias("min"),
            (F.max(x) if is_number else none.cast("double")).alias("max"),
            # distinct values are counted by their text, so that all columns share one kind of sketch
            F.hll_sketch_agg(named(c).cast("string"), LG_K).alias("distinct"),
            (F.kll_sketch_agg_double(x, QUANTILE_K) if is_number else none.cast("binary")).alias("quantiles"),
        )

    columns = [(c, True) for c in numeric] + [(c, False) for c in text]
    if not columns:
        raise ValueError("no columns to sketch")
    rows = df.groupBy(named(file).alias(file)).agg(*[one(c, n).alias(f"_{k}") for k, (c, n) in enumerate(columns)])
    return rows.select(named(file), F.inline(F.array(*[F.col(f"_{k}") for k in range(len(columns))])))


def merged_profile(sketches: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(column, rows, count, missing, mean, std, min, max, distinct, quantiles)`` over all files.

    ``quantiles`` has one value per probability, null for text and for columns without a value.
    """
    totals = sketches.groupBy("column").agg((F.sum(F.col("mean") * F.col("count")) / F.nullif(F.sum("count"), F.lit(0))).alias("_mean"))
    shift = F.col("mean") - F.col("_mean")
    merged = (
        sketches.join(totals, "column")  # one row per column
        .groupBy("column")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("count").alias("count"),
            F.first("_mean").alias("mean"),
            F.sum(F.col("m2") + F.col("count") * shift * shift).alias("_m2"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
            F.kll_merge_agg_double(F.when(F.col("count") > 0, F.col("quantiles"))).alias("_quantiles"),
        )
    )
    # an empty sketch has no quantiles
    has_values = F.col("mean").isNotNull()
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    return merged.select(
        "column",
        "rows",
        "count",
        (F.col("rows") - F.col("count")).alias("missing"),
        "mean",
        F.when(F.col("count") > 1, F.sqrt(F.col("_m2") / (F.col("count") - 1))).alias("std"),
        "min",
        "max",
        "distinct",
        F.when(has_values, F.kll_sketch_get_quantile_double("_quantiles", at)).alias("quantiles"),
    )
