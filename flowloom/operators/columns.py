"""Schema operators: rename, alias, complete, drop and reorder columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.fixed_values import (
    BENIGN,
    COLUMN_ALIASES,
    DROP_REASONS,
    DUPLICATE_REASON,
    META_COLUMNS,
    PLACEHOLDER_IP,
)

from flowloom.functions.values import named


def clean_name(name: str) -> str:
    """Trim and collapse blanks in a header."""
    return " ".join(name.split())


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def unique_names(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Position names for a header with repeats: the first copy keeps its name.

    Returns the names to read with and the later copies among them, to be dropped.
    """
    seen: dict[str, int] = {}
    read_as, repeats = [], []
    for name in map(clean_name, names):
        copy = seen.get(name, 0)
        seen[name] = copy + 1
        read_as.append(name if copy == 0 else f"{name}#{copy}")
        if copy:
            repeats.append(read_as[-1])
    return read_as, repeats


def apply_aliases(df: DataFrame, aliases: Mapping[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Copy ``old`` to ``new`` where ``new`` is missing; an existing target is never touched."""
    present = set(df.columns)
    added: dict[str, Column] = {}
    for old, new in aliases.items():
        if old in present and new not in present and new not in added:
            added[new] = named(old)
    return df.withColumns(added) if added else df


def ensure_features(df: DataFrame, features: Iterable[str], fill: float | None = None) -> DataFrame:
    """Add missing feature columns, as null (imputed later) or as a constant."""
    missing = [c for c in features if c not in df.columns]
    return df.withColumns({c: F.lit(fill).cast("double") for c in missing}) if missing else df


def ensure_meta(
    df: DataFrame,
    now: str,
    source_file: str = "unknown",
    ip: str = PLACEHOLDER_IP,
    label: str = BENIGN,
) -> DataFrame:
    """Add missing metadata columns with placeholders; ``now`` is the caller's fixed clock."""
    defaults = {
        "Source IP": F.lit(ip),
        "Destination IP": F.lit(ip),
        "Timestamp": F.lit(now).cast("timestamp_ntz"),
        "SourceFile": F.lit(source_file),
        "Label": F.lit(label),
    }
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def designated_drops(
    columns: Iterable[str],
    reasons: Mapping[str, str] = DROP_REASONS,
    repeats: Iterable[str] = (),
) -> dict[str, str]:
    """Column -> reason, for identifiers, redundant columns and repeated headers."""
    dropped = {c: DUPLICATE_REASON for c in repeats}
    for c in columns:
        key = c.strip().lower().replace(" ", "")
        if key in reasons:
            dropped[c] = reasons[key]
    return dropped


def drop_designated(
    df: DataFrame,
    reasons: Mapping[str, str] = DROP_REASONS,
    repeats: Iterable[str] = (),
) -> tuple[DataFrame, dict[str, str]]:
    dropped = designated_drops(df.columns, reasons, repeats)
    return df.drop(*dropped), dropped


def drop_listed(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns by exact name; names that are absent are ignored."""
    return df.drop(*names)


def keep_columns(df: DataFrame, features: Sequence[str], meta: Sequence[str] = META_COLUMNS) -> DataFrame:
    """Features in artifact order, then the metadata present; everything else goes."""
    kept = list(features) + [c for c in meta if c in df.columns]
    return df.select(*[named(c) for c in kept])


def select_existing(df: DataFrame, wanted: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Wanted columns that exist, and the names that do not."""
    wanted = list(wanted)
    missing = [c for c in wanted if c not in df.columns]
    return df.select(*[named(c) for c in wanted if c in df.columns]), missing


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def map_to_rows(df: DataFrame, entries: str, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per entry of a ``map<string, struct>`` column, struct fields as columns."""
    return df.select(F.explode(entries).alias(key, "_value")).select(
        key, *[F.col(f"_value.{f}").alias(f) for f in fields]
    )
