"""Risk summary of predicted windows, and the choice of the run to score with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowloom.fixed_values import (
    BENIGN,
    GAUGE_HIGH_FROM,
    GAUGE_LOW_BELOW,
    RISK_ADVICE,
    RISK_SAFE_BELOW,
    RISK_SUSPICIOUS_BELOW,
)


def prediction_counts(df: DataFrame, label: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, label, count)``."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("count"))


def risk_summary(df: DataFrame, label: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """Totals, risk score in percent, level, gauge band, advice, most common class and top attack.

    Works on the label counts, so rows collapse before anything else happens.
    """
    counts = prediction_counts(df, label, by)
    attack = F.upper(F.col(label)) != BENIGN
    rank = F.struct(-F.col("count"), F.col(label))
    out = counts.groupBy(*by).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_windows"),
        F.coalesce(F.sum(F.when(attack, F.col("count"))), F.lit(0)).alias("attack_windows"),
        F.coalesce(F.min_by(label, rank), F.lit("Unknown")).alias("most_common"),
        F.coalesce(F.min_by(F.when(attack, F.col(label)), F.when(attack, rank)), F.lit("None")).alias("top_attack"),
    )
    score = F.coalesce(F.col("attack_windows") * 100 / F.nullif(F.col("total_windows"), F.lit(0)), F.lit(0.0))
    level = (
        F.when(F.col("risk_score") < RISK_SAFE_BELOW, "safe")
        .when(F.col("risk_score") < RISK_SUSPICIOUS_BELOW, "suspicious")
        .otherwise("high")
    )
    gauge = (
        F.when(F.col("risk_score") < GAUGE_LOW_BELOW, "low")
        .when(F.col("risk_score") < GAUGE_HIGH_FROM, "medium")
        .otherwise("high")
    )
    advice = F.create_map(*[F.lit(x) for pair in RISK_ADVICE.items() for x in pair])
    return (
        out.withColumn("risk_score", score)
        .withColumn("risk_level", level)
        .withColumn("gauge_band", gauge)
        .withColumn("recommendation", F.element_at(advice, F.col("risk_level")))
    )


def attack_timeline(df: DataFrame, window: str = "window_id", label: str = "pred_label") -> DataFrame:
    """``(window_id, attack_flag)`` in window order."""
    flag = (F.upper(F.col(label)) != BENIGN).cast("int")
    return df.select(window, flag.alias("attack_flag")).orderBy(window)


def benign_first(df: DataFrame, label: str, then: str | None = None) -> DataFrame:
    """Class order of reports: the benign class first, the others in their own order."""
    return df.orderBy(F.when(F.col(label) == BENIGN, 0).otherwise(1), F.col(then or label))


def with_mode(runs: DataFrame, run: str = "run_id", classes: str = "num_classes") -> DataFrame:
    """``binary`` for two classes or a ``_binary`` suffix, else ``multi``."""
    binary = F.coalesce(F.col(classes) == 2, F.lit(False)) | F.col(run).endswith("_binary")
    return runs.withColumn("mode", F.when(binary, "binary").otherwise("multi"))


def latest_runs(runs: DataFrame, by: Sequence[str] = ("mode",), run: str = "run_id") -> DataFrame:
    """The run with the largest id per mode; an aggregate, so no group is sorted."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(run)).alias("_r")).select(*by, "_r.*")
