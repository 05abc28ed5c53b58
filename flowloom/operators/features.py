"""Feature selection, standardisation and alignment to a fitted feature space."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.fixed_values import (
    CORR_THRESHOLD,
    CORRELATION_REASON,
    LABEL,
    META_COLUMNS,
    SEED,
    STD_THRESHOLD,
    VARIANCE_REASON,
)
from flowloom.functions.values import named
from flowloom.operators.artifacts import Artifacts, numeric_columns, require_features
from flowloom.operators.cleaning import fit_medians, impute
from flowloom.operators.columns import ensure_features, keep_columns
from flowloom.operators.gram import pair_correlation, pair_sums

def near_zero_variance(stds: dict[str, float | None], threshold: float = STD_THRESHOLD) -> dict[str, str]:
    """Columns to drop for lack of variation, with the reason."""
    return {c: VARIANCE_REASON for c, s in stds.items() if s is None or s <= threshold}


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for each pair of columns, nulls left out pair by pair; one scan for all pairs.

    Null where a column is constant over the rows in which both are present, or there are no such rows.
    """
    columns = list(columns)
    names = F.array(*[F.lit(c) for c in columns])
    pairs = [(k, m) for k in range(len(columns)) for m in range(k + 1, len(columns))]
    every = df.sparkSession.createDataFrame(pairs, "i int, j int").select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"))
    found = pair_sums(df, columns).select("a", "b", pair_correlation().alias("corr"))
    return every.join(found, ["a", "b"], "left")  # an empty table has no sums


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float]:
    """Pair -> correlation of columns without nulls; the matrix is features x features."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(
        df.select(*[named(c).cast("double").alias(c) for c in columns])
    )
    cells = Correlation.corr(vectors, "_v").first()[0].toArray()
    return {(a, b): float(cells[i, j]) for i, a in enumerate(columns) for j, b in enumerate(columns)}


def redundant_features(
    columns: Sequence[str],
    corr: dict[tuple[str, str], float | None],
    stds: dict[str, float | None],
    threshold: float = CORR_THRESHOLD,
) -> dict[str, str]:
    """Greedy upper-triangle pass: of two correlated columns the one with the smaller spread goes.

    The left column of a pair keeps being compared after it was dropped itself
    within its own row; that is part of the rule.
    """
    dropped: dict[str, str] = {}
    spread = {c: stds[c] or 0.0 for c in columns}
    for i, left in enumerate(columns):
        if left in dropped:
            continue
        for right in columns[i + 1 :]:
            value = corr.get((left, right))
            if right in dropped or value is None or not abs(value) > threshold:
                continue
            loser = left if spread[left] <= spread[right] else right
            dropped.setdefault(loser, CORRELATION_REASON)
    return dropped


@dataclass(frozen=True)
class Moments:
    mean: float | None
    std_samp: float | None
    std_pop: float | None


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    """Mean and both standard deviations of every column in one pass."""
    row = df.agg(
        *[
            F.struct(
                F.avg(named(c)).alias("mean"),
                F.stddev_samp(named(c)).alias("std_samp"),
                F.stddev_pop(named(c)).alias("std_pop"),
            ).alias(f"m{k}")
            for k, c in enumerate(columns)
        ]
    ).first()
    return {c: Moments(**row[f"m{k}"].asDict()) for k, c in enumerate(columns)}


def scaler_of(stats: dict[str, Moments]) -> tuple[dict[str, float], dict[str, float]]:
    """Means and population standard deviations; a zero deviation scales by 1."""
    return {c: m.mean or 0.0 for c, m in stats.items()}, {c: m.std_pop or 1.0 for c, m in stats.items()}


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float], dict[str, float]]:
    return scaler_of(moments(df, columns))


def scale(df: DataFrame, art: Artifacts) -> DataFrame:
    """Standardise with stored statistics."""
    return df.withColumns({f: (named(f) - F.lit(art.means[f])) / F.lit(art.stds[f]) for f in art.features})


def fit_features(
    df: DataFrame, exact_medians: bool | None = None, select: bool = True, exclude: Sequence[str] = META_COLUMNS
) -> Artifacts:
    """Medians, variance and correlation drops and scaling statistics of a coerced table.

    Persist the table first when it is expensive: each statistic is one pass.
    """
    columns = numeric_columns(df, tuple(exclude))
    medians = fit_medians(df, columns, exact_medians)
    filled = impute(df.select(*[named(c) for c in columns]), medians)
    stats = moments(filled, columns)
    dropped: dict[str, str] = {}
    if select:
        stds = {c: m.std_samp for c, m in stats.items()}
        dropped = near_zero_variance(stds)
        kept = [c for c in columns if c not in dropped]
        if len(kept) > 1:
            dropped |= redundant_features(kept, correlation_matrix(filled, kept), stds)
    features = [c for c in columns if c not in dropped]
    means, deviations = scaler_of({c: stats[c] for c in features})
    return Artifacts(features, medians, means, deviations, dropped)


def align(
    df: DataFrame, art: Artifacts, missing_as: float | None = None, meta: Sequence[str] = META_COLUMNS
) -> DataFrame:
    """Bring a foreign table into the fitted space: complete, select, impute, scale.

    A feature the table lacks is filled with its median, or with ``missing_as`` before scaling.
    """
    df = ensure_features(df, art.features, missing_as)
    require_features(art.features, df.columns)
    df = keep_columns(df, art.features, meta)
    return scale(impute(df, art.medians, art.features), art)


def balanced_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """Weight rows so that every class counts the same; the class counts are few rows."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    pairs = [F.lit(x) for k, n in counts.items() for x in (k, total / (len(counts) * n))]
    return df.withColumn(out, F.element_at(F.create_map(*pairs), F.col(label)))


def feature_importance(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, trees: int = 200, depth: int = 5, seed: int = SEED
) -> DataFrame:
    """``(feature, importance)`` of a class-balanced random forest on median-filled features."""
    filled = impute(df.select(label, *[named(c) for c in columns]).dropna(subset=[label]), fit_medians(df, columns))
    data = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(balanced_weights(filled, label))
    data = StringIndexer(inputCol=label, outputCol="_y").fit(data).transform(data)
    forest = RandomForestClassifier(
        featuresCol="_v", labelCol="_y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    ).fit(data)
    rows = [(c, float(w)) for c, w in zip(columns, forest.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
