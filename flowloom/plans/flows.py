"""End-to-end jobs: training table, window dataset, scoring, cross-dataset evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from flowloom.fixed_values import (
    DESTINATION_IP,
    LABEL,
    LABEL_ORIGINAL,
    META_COLUMNS,
    SOURCE_IP,
    TIMESTAMP,
    TRAIN_ATTACK_LABELS,
)
from flowloom.operators import cleaning, columns, evaluation, features, graphs, rows, windows
from flowloom.operators.artifacts import Artifacts, require_features
from flowloom.operators.lookup import label_index
from flowloom.operators.models import score_windows
from flowloom.operators.ordering import Indexed, dense_index
from flowloom.operators.sampling import cap_benign
from flowloom.operators.windows import Geometry
from flowloom.scratch import stage
from flowloom.sources.writers import preprocessing_report


@dataclass
class TrainingTable:
    """Scaled table, fitted artifacts and the report of what was removed."""

    df: DataFrame
    artifacts: Artifacts
    report: DataFrame


def _checked_roles(df: DataFrame) -> dict[str, str | None]:
    roles = {"label": LABEL, "source": SOURCE_IP, "destination": DESTINATION_IP, "timestamp": TIMESTAMP}
    return {role: c if c in df.columns else None for role, c in roles.items()}


def build_training_table(
    raw: DataFrame,
    repeats: Sequence[str] = (),
    keep: Sequence[str] | None = TRAIN_ATTACK_LABELS,
    binary: bool = False,
    exact_medians: bool | None = None,
    text_features: Sequence[str] = (),
) -> TrainingTable:
    """Raw flows to the scaled training table.

    ``keep`` are the attack classes to train on; with ``binary`` every attack
    is one class and no column is dropped by variance or correlation.
    ``text_features`` are encoded by frequency instead of read as numbers.
    """
    df = columns.clean_column_names(raw)
    df = cleaning.normalize_labels(columns.apply_aliases(df))
    df, dropped = columns.drop_designated(df, repeats=repeats)
    if TIMESTAMP in df.columns:
        # Deduplication compares the raw text, so the parsed value is added beside it.
        df = cleaning.parse_timestamps(df.withColumn("_ts", F.col(TIMESTAMP)), "_ts")
    roles = _checked_roles(df) | {"timestamp": "_ts" if "_ts" in df.columns else None}
    row_report = rows.row_clean_report(df, **roles)
    clean = rows.clean_rows(df, **roles)
    if "_ts" in clean.columns:
        clean = clean.withColumn(TIMESTAMP, F.col("_ts")).drop("_ts")
    low, other = rows.dropped_class_counts(clean), rows.other_class_counts(rows.drop_classes(clean), keep or ())
    if binary:
        typed = cleaning.to_binary(clean)
        low, other = low.limit(0), other.limit(0)
    else:
        typed = rows.drop_classes(clean)
        if keep is not None:
            typed = rows.keep_classes(typed, keep)
        else:
            other = other.limit(0)
    meta = (*META_COLUMNS, LABEL_ORIGINAL)
    numbers, encoded = cleaning.encode_by_frequency(cleaning.coerce_numbers(typed, meta, text_features), text_features)
    coerced = stage(numbers, "coerced-flows")
    art = features.fit_features(coerced, exact_medians, select=not binary, exclude=meta)
    art.dropped = dropped | art.dropped
    scaled = features.align(coerced, art, meta=[c for c in meta if c in coerced.columns])
    return TrainingTable(scaled, art, preprocessing_report(row_report, low, other, art, encoded))


def build_window_vectors(
    ix: Indexed,
    feature_names: Sequence[str],
    src: str,
    dst: str,
    label: str,
    g: Geometry = Geometry(),
    cap: int | None = None,
) -> DataFrame:
    """``(window_id, label, features)``: sequence means and two-hop graph read-out of each window."""
    return graphs.block_vectors(ix, src, dst, label, list(feature_names), g, cap)


def index_flows(df: DataFrame, tie_break: Sequence[str], timestamp: str = TIMESTAMP) -> Indexed:
    """Time order with a tie-break that makes the key unique."""
    return dense_index(df, [timestamp, *tie_break], name="flows")


def prepare_for_scoring(raw: DataFrame, art: Artifacts, order_by: Sequence[str], now: str) -> DataFrame:
    """A new table in the training space, with endpoints, label, file and time filled in."""
    df = columns.apply_aliases(columns.clean_column_names(raw))
    df, _ = columns.drop_designated(df)
    if LABEL in df.columns:
        df = cleaning.normalize_labels(df)
    if TIMESTAMP in df.columns:
        df = cleaning.parse_timestamps(df)
    df = cleaning.coerce_numbers(df, (*META_COLUMNS, *order_by))
    df = columns.ensure_meta(df, now, source_file="uploaded_sample.csv")
    df = cleaning.assign_endpoints(df, order_by)
    return features.align(df, art, meta=(*META_COLUMNS, *[c for c in order_by if c not in META_COLUMNS]))


@dataclass
class Scored:
    """Predicted windows and the numbers reported with them."""

    windows: DataFrame
    n_rows: int
    n_windows_available: int
    n_windows_scored: int


def score_table(
    raw: DataFrame,
    art: Artifacts,
    model: PipelineModel,
    model_features: Sequence[str],
    label2idx: Mapping[str, int],
    order_by: Sequence[str],
    now: str,
    g: Geometry = Geometry(),
    max_windows: int | None = None,
) -> Scored:
    """Clean, align, window and classify a new table."""
    require_features(list(model_features), art.features)
    ready = prepare_for_scoring(raw, art, order_by, now)
    ix = index_flows(ready, order_by)
    vectors = build_window_vectors(ix, model_features, SOURCE_IP, DESTINATION_IP, LABEL, g, max_windows)
    return Scored(score_windows(vectors, model, label2idx), ix.n, g.count(ix.n), g.count(ix.n, max_windows))


def evaluate_across(
    raw: DataFrame,
    art: Artifacts,
    model: PipelineModel,
    model_features: Sequence[str],
    label2idx: Mapping[str, int],
    order_by: Sequence[str],
    now: str,
    taxonomy: Mapping[str, str] | None = None,
    binary: bool = False,
    benign_rows: int | None = None,
    key: Sequence[str] = (),
    max_windows: int | None = None,
) -> DataFrame:
    """Classification report of a model on another capture.

    Labels go to the training classes first, then the benign class may be
    capped, then the table is scored and compared with its own labels.
    """
    df = columns.apply_aliases(columns.clean_column_names(raw))
    df = cleaning.to_binary(cleaning.normalize_labels(df)) if binary else cleaning.to_training_taxonomy(df, taxonomy)
    if benign_rows is not None:
        df = cap_benign(df, benign_rows, list(key))
    scored = score_table(df, art, model, model_features, label2idx, order_by, now, max_windows=max_windows)
    pairs = scored.windows.withColumn("true_idx", label_index(F.col("label"), label2idx))
    matrix = evaluation.confusion(pairs, "true_idx", "pred_idx", sorted(label2idx.values()))
    return evaluation.classification_report(matrix)

