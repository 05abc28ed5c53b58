"""Lookup joins against small tables, with a checked size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.fixed_values import BENIGN, UNKNOWN_LABEL
from flowloom.operators.ordering import dense_index

# Rows up to which a lookup table is sent to every executor.
BROADCAST_ROWS = 1_000_000


def join_counted(df: DataFrame, lookup: DataFrame, rows: int, on: str | list[str], how: str = "left") -> DataFrame:
    """Join a lookup of known row count: broadcast when small, else shuffled with AQE skew handling."""
    return df.join(F.broadcast(lookup) if rows <= BROADCAST_ROWS else lookup, on, how)


def label_map(labels: Sequence[str]) -> dict[str, int]:
    """Label -> index in sorted order."""
    return {label: k for k, label in enumerate(sorted(labels))}


def lookup_literal(value: Column, mapping: Mapping, default: Column) -> Column:
    """Value through a literal map, or ``default``; for mappings given in code, such as label sets."""
    if not mapping:
        return default
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), value), default)


def label_index(label: Column, label2idx: Mapping[str, int]) -> Column:
    """Class index of a label; unknown and missing labels become the benign class."""
    return lookup_literal(label, label2idx, F.lit(label2idx.get(BENIGN, 0)))


def index_label(index: Column, label2idx: Mapping[str, int]) -> Column:
    """Label of a class index, ``UNK`` when there is none."""
    return lookup_literal(index, {k: label for label, k in label2idx.items()}, F.lit(UNKNOWN_LABEL))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.select(column).dropna().distinct().orderBy(column)


def label_index_table(df: DataFrame, label: str) -> DataFrame:
    """``(label, idx)`` over the labels present, in sorted order."""
    labels = df.select(label).dropna().distinct()
    return dense_index(labels, [label], index="idx", name="labels").df.select(
        F.col(label).alias("label"), F.col("idx").cast("int").alias("idx")
    )


def compare_on(left: DataFrame, right: DataFrame | None, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join of two metric tables on ``key`` with suffixed columns; nulls when ``right`` is absent."""
    values = [c for c in left.columns if c != key]
    renamed = left.select(key, *[F.col(c).alias(c + suffixes[0]) for c in values])
    if right is None:
        return renamed.withColumns({c + suffixes[1]: F.lit(None).cast(left.schema[c].dataType) for c in values})
    return renamed.join(right.select(key, *[F.col(c).alias(c + suffixes[1]) for c in values]), key)
