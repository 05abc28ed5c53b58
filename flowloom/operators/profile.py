"""Exploratory profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowloom.fixed_values import BENIGN, LABEL
from flowloom.functions.labels import label_key, label_key_text
from flowloom.functions.values import named
from flowloom.operators.artifacts import numeric_columns
from flowloom.operators.quantiles import exact_quantiles


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``duplicate_rows``: rows beyond the first of each group of equal rows."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def missing_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """``(column, missing_count)`` by falling count."""
    row = df.agg(*[F.count_if(named(c).isNull()).alias(c) for c in df.columns])
    long = row.unpivot([], [named(c) for c in df.columns], "column", "missing_count")
    ordered = long.orderBy(F.desc("missing_count"), "column")
    return ordered.limit(top) if top else ordered


def label_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """``(label, count)`` by falling count, missing labels included."""
    return (
        df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col(label).asc_nulls_last())
    )


def benign_attack_totals(df: DataFrame, label: str = LABEL, benign: str = BENIGN) -> DataFrame:
    """``total``, ``benign``, ``attack``; a missing label counts as an attack."""
    hit = F.coalesce(label_key(label) == label_key_text(benign), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("benign"), F.count_if(~hit).alias("attack")
    )


def target_counts(df: DataFrame, targets: Sequence[str], label: str = LABEL) -> DataFrame:
    """``(target, count)`` under normalised keys, with a zero for absent targets."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(t, label_key_text(t)) for t in targets], "target string, key string")
    counts = df.groupBy(label_key(label).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "key", "left").select("target", F.coalesce("n", F.lit(0)).alias("count"))


def top_values(df: DataFrame, column: str, k: int = 30, rest: str = "more") -> DataFrame:
    """``(value, count)`` of the ``k`` most frequent values and one row ``... (N rest)`` for the others."""
    counts = df.filter(named(column).isNotNull()).groupBy(named(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    top = counts.orderBy(F.desc("count"), "value").limit(k)
    others = (
        counts.agg(F.count(F.lit(1)).alias("values"))
        .filter(F.col("values") > k)
        .select(
            F.concat(F.lit("... ("), (F.col("values") - k).cast("string"), F.lit(f" {rest})")).alias("value"),
            (F.col("values") - k).alias("count"),
        )
    )
    return top.unionByName(others)


def schema_profile(df: DataFrame) -> DataFrame:
    """``(ord, column, type, non_null)`` of every column."""
    counts = df.agg(*[F.count(named(c)).alias(f"c{k}") for k, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(k).alias("ord"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"c{k}").alias("non_null"))
        for k, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)).cast("long"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` of all columns at once, values as text, nulls left out."""
    return (
        df.select(*[named(c).cast("string").alias(c) for c in columns])
        .unpivot([], [named(c) for c in columns], "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def describe(df: DataFrame, numeric: Sequence[str] | None = None, text: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count, unique/top/freq for text, moments and exact quartiles for numbers.

    Text statistics come from value counts, so no aggregate holds a column's values in memory.
    """
    numeric = list(numeric if numeric is not None else numeric_columns(df))
    text = list(text if text is not None else [c for c, t in df.dtypes if t == "string"])
    none = F.lit(None)
    parts = []
    if text:
        best = F.min_by("value", F.struct(-F.col("count"), F.col("value")))
        parts.append(
            value_counts(df, text)
            .groupBy("column")
            .agg(
                F.sum("count").alias("count"),
                F.count(F.lit(1)).alias("unique"),
                best.alias("top"),
                F.max("count").alias("freq"),
            )
            .withColumns({c: none.cast("double") for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})
        )
    if numeric:
        q = exact_quantiles(df, numeric, (0.25, 0.5, 0.75))
        stats = df.agg(
            *[
                F.struct(
                    F.count(named(c)).alias("count"),
                    F.avg(named(c)).alias("mean"),
                    F.stddev_samp(named(c)).alias("std"),
                    F.min(named(c)).cast("double").alias("min"),
                    F.max(named(c)).cast("double").alias("max"),
                ).alias(f"s{k}")
                for k, c in enumerate(numeric)
            ]
        )
        rows = []
        for k, c in enumerate(numeric):
            quart = {f"p{int(p * 100)}": F.lit(q[c, p]).cast("double") for p in (0.25, 0.5, 0.75)}
            s = F.col(f"s{k}")
            rows.append(
                F.struct(
                    F.lit(c).alias("column"),
                    s["count"].alias("count"),
                    none.cast("long").alias("unique"),
                    none.cast("string").alias("top"),
                    none.cast("long").alias("freq"),
                    *[s[x].alias(x) for x in ("mean", "std", "min")],
                    *[v.alias(x) for x, v in quart.items()],
                    s["max"].alias("max"),
                )
            )
        parts.append(stats.select(F.inline(F.array(*rows))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def profile_document(df: DataFrame, label: str = LABEL, top: int = 20) -> DataFrame:
    """The profile as one JSON text: shape, columns, duplicates, missing values, what else is available."""
    numeric = numeric_columns(df)
    missing = missing_counts(df)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("missing_count")).alias("k"), "column")))
    worst = missing.limit(top).agg(
        F.transform(ranked, lambda w: F.struct(w["column"].alias("column"), (-w["k"]).alias("missing_count")))
    )
    document = shape(df).select(
        F.struct("rows", "cols").alias("shape"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        duplicate_count(df).scalar().alias("duplicate_rows"),
        missing.agg(F.count_if(F.col("missing_count") > 0)).scalar().alias("num_missing_columns"),
        worst.scalar().alias("top_missing_columns"),
        F.lit(label in df.columns).alias("label_distribution_available"),
        F.struct(F.lit(len(numeric)).alias("rows"), F.lit(len(numeric)).alias("cols")).alias("correlation_shape"),
        F.lit(len(numeric) if label in df.columns else 0).alias("feature_importance_rows"),
    )
    return document.select(F.to_json(F.struct("*")).alias("profile"))
