"""Row filters and the row-clean report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from flowloom.fixed_values import BENIGN, DESTINATION_IP, LABEL, LOW_SUPPORT_LABELS, SOURCE_IP, TIMESTAMP
from flowloom.functions.labels import label_key, label_key_text, label_keys
from flowloom.functions.values import is_filled

KEPT = "kept"
DUPLICATE = "duplicate_rows_removed"
NULL_LABEL = "null_label_rows_removed"
NO_SOURCE = "missing_source_ip_rows_removed"
NO_DESTINATION = "missing_destination_ip_rows_removed"
NO_TIMESTAMP = "missing_timestamp_rows_removed"
REASONS = (DUPLICATE, NULL_LABEL, NO_SOURCE, NO_DESTINATION, NO_TIMESTAMP)


def first_failing_check(
    label: str | None = LABEL,
    source: str | None = SOURCE_IP,
    destination: str | None = DESTINATION_IP,
    timestamp: str | None = TIMESTAMP,
) -> Column:
    """The first check a row fails, in the fixed order of the report; ``kept`` if none.

    One CASE replaces one pass per check: a row is counted where a sequence of
    filters would have removed it. The timestamp column is already parsed.
    """
    checks = []
    if label:
        checks.append((~is_filled(F.col(label)), NULL_LABEL))
    if source:
        checks.append((~is_filled(F.col(source)), NO_SOURCE))
    if destination:
        checks.append((~is_filled(F.col(destination)), NO_DESTINATION))
    if timestamp:
        checks.append((F.col(timestamp).isNull(), NO_TIMESTAMP))
    reason = F.lit(KEPT)
    for failed, name in reversed(checks):
        reason = F.when(failed, name).otherwise(reason)
    return reason


def filled_only(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named text columns are neither null nor blank."""
    for c in columns:
        df = df.filter(is_filled(F.col(c)))
    return df


def clean_rows(df: DataFrame, **roles: str | None) -> DataFrame:
    """Deduplicate whole rows, then drop rows failing any check."""
    return df.dropDuplicates().filter(first_failing_check(**roles) == KEPT)


def row_clean_report(df: DataFrame, **roles: str | None) -> DataFrame:
    """``(item, rows)``: rows before, rows removed per reason, rows kept.

    Grouping by the whole row finds duplicates and carries their number, so a
    single shuffle answers all counters; copies collapse before it.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    reason = first_failing_check(**roles)
    totals = rows.agg(
        F.sum("_copies").alias("rows_before"),
        F.sum(F.col("_copies") - 1).alias(DUPLICATE),
        *[F.count_if(reason == r).alias(r) for r in REASONS[1:]],
        F.count_if(reason == KEPT).alias("rows_after"),
    )
    items = ["rows_before", *REASONS, "rows_after"]
    return totals.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in items]).unpivot(
        [], items, "item", "rows"
    )


def drop_classes(df: DataFrame, labels: Iterable[str] = LOW_SUPPORT_LABELS, label: str = LABEL) -> DataFrame:
    """Remove the listed classes; the list is short, so it becomes an IN filter."""
    return df.filter(~F.coalesce(label_key(label).isin(label_keys(labels)), F.lit(False)))


def keep_classes(
    df: DataFrame, labels: Iterable[str], benign: str | None = BENIGN, label: str = LABEL
) -> DataFrame:
    """Keep the benign class and the listed ones."""
    keys = set(label_keys(labels)) | ({label_key_text(benign)} if benign else set())
    return df.filter(label_key(label).isin(sorted(keys)))


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def dropped_class_counts(
    df: DataFrame, labels: Iterable[str] = LOW_SUPPORT_LABELS, label: str = LABEL
) -> DataFrame:
    """Rows per label that ``drop_classes`` removes."""
    return class_counts(df.filter(label_key(label).isin(label_keys(labels))), label)


def other_class_counts(
    df: DataFrame, labels: Iterable[str], benign: str | None = BENIGN, label: str = LABEL
) -> DataFrame:
    """Rows per label that ``keep_classes`` removes."""
    keys = set(label_keys(labels)) | ({label_key_text(benign)} if benign else set())
    return class_counts(df.filter(~F.coalesce(label_key(label).isin(sorted(keys)), F.lit(False))), label)


def attacks_only(df: DataFrame, benign: str = BENIGN, label: str = LABEL) -> DataFrame:
    """Labelled rows of any class but the benign one."""
    return df.filter(label_key(label) != label_key_text(benign))


def scan_report(df: DataFrame, benign: str = BENIGN, label: str = LABEL, file: str = "SourceFile") -> DataFrame:
    """Rows scanned and attack rows kept per file."""
    return df.groupBy(file).agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(label_key(label) != label_key_text(benign)).alias("kept"),
    )


def observe_attacks(df: DataFrame, name: str = "scan", benign: str = BENIGN, label: str = LABEL) -> tuple[DataFrame, Observation]:
    """``attacks_only`` and the counts ``scanned``, ``kept``, ``dropped`` of the very job that writes the rows.

    The counts are ready when that job has ended, without a second scan.
    """
    seen = Observation(name)
    return attacks_only(df.observe(seen, *attack_counts(benign, label)), benign, label), seen


def attack_counts(benign: str = BENIGN, label: str = LABEL) -> list[Column]:
    """Aggregates of ``observe_attacks``, also for streams (``df.observe(name, *attack_counts())``)."""
    attack = F.coalesce(label_key(label) != label_key_text(benign), F.lit(False))
    return [F.count(F.lit(1)).alias("scanned"), F.count_if(attack).alias("kept"), F.count_if(~attack).alias("dropped")]


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without any null, in all columns or in ``subset``."""
    return df.dropna("any", subset=list(subset) if subset else None)
