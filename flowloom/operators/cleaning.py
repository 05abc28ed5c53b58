"""Value cleaning: labels, numbers, timestamps, imputation, encodings, endpoints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from flowloom.fixed_values import (
    DESTINATION_IP,
    LABEL,
    LABEL_ORIGINAL,
    META_COLUMNS,
    PLACEHOLDER_IP,
    SOURCE_FILE,
    SOURCE_IP,
    TIMESTAMP,
    TIMESTAMP_FORMATS,
)
from flowloom.functions.labels import binary_label, canonical_label, mapped_label, nfkc
from flowloom.functions.values import finite, named, pseudo_endpoints, stripped, to_number, to_timestamp
from flowloom.operators.artifacts import numeric_columns
from flowloom.operators.lookup import join_counted
from flowloom.operators.ordering import dense_index
from flowloom.operators.quantiles import approx_quantiles, exact_quantiles

MISSING = "__MISSING__"
_NON_ASCII = r"[^\x00-\x7F]"


def normalize_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Canonical labels, NFKC included.

    ASCII text is its own NFKC form and never leaves the JVM; only the distinct
    labels with other characters visit Python, and come back by a join.
    """
    odd = df.select(F.col(label).alias("_raw")).filter(F.col("_raw").rlike(_NON_ASCII)).distinct()
    n_odd = odd.count()
    if n_odd == 0:
        return df.withColumn(label, canonical_label(label))
    composed = odd.select(F.col("_raw").alias(label), nfkc("_raw").alias("_nfkc"))
    joined = join_counted(df, composed, n_odd, label)
    return joined.withColumn(label, canonical_label(F.coalesce("_nfkc", label))).select(
        *[named(c) for c in df.columns]
    )


def coerce_numbers(df: DataFrame, meta: Sequence[str] = META_COLUMNS, keep_text: Sequence[str] = ()) -> DataFrame:
    """Every column that is not metadata becomes a finite double or null, in one projection."""
    skip = {*meta, *keep_text}
    changed = {}
    for name, dtype in df.dtypes:
        if name in skip:
            continue
        c = named(name)
        changed[name] = to_number(c) if dtype == "string" else finite(c.cast("double"))
    return df.withColumns(changed) if changed else df


def meta_by_substring(columns: Sequence[str]) -> list[str]:
    """The looser metadata test: any name holding ``ip`` or ``timestamp``, besides label and file."""
    lowered = {c: c.lower() for c in columns}
    return [c for c, low in lowered.items() if "ip" in low or "timestamp" in low or low in ("label", "sourcefile")]


def parse_timestamps(
    df: DataFrame, timestamp: str = TIMESTAMP, formats: Sequence[str] = TIMESTAMP_FORMATS
) -> DataFrame:
    """Text timestamps to ``timestamp_ntz``; typed columns are left alone."""
    if dict(df.dtypes)[timestamp] != "string":
        return df
    return df.withColumn(timestamp, to_timestamp(F.trim(F.col(timestamp)), formats))


def fit_medians(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool | None = None
) -> dict[str, float]:
    """Median per numeric column, 0.0 for a column without values; a sketch only with ``exact=False``."""
    columns = list(columns if columns is not None else numeric_columns(df))
    if not columns:
        return {}
    medians = (approx_quantiles if exact is False else exact_quantiles)(df, columns)
    return {c: float(medians[c, 0.5]) if medians[c, 0.5] is not None else 0.0 for c in columns}


def impute(df: DataFrame, medians: Mapping[str, float], columns: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls with stored medians; 0.0 for a column without one."""
    columns = columns if columns is not None else [c for c in medians if c in df.columns]
    return df.withColumns({c: F.coalesce(named(c), F.lit(float(medians.get(c, 0.0)))) for c in columns})


def frequency_codes(df: DataFrame, column: str):
    """``(value, code)`` by falling frequency, ties by value, with the number of values."""
    counts = df.groupBy(F.coalesce(named(column), F.lit(MISSING)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return dense_index(counts, [F.col("n").desc(), F.col("value").asc()], index="code", name="frequency-codes")


def encode_by_frequency(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """Replace text columns by their frequency-ordered codes; also the number of values of each."""
    sizes = {}
    for c in columns:
        codes = frequency_codes(df, c)
        sizes[c] = codes.n
        lookup = codes.df.select(F.col("value").alias("_value"), F.col("code").cast("int").alias("_code"))
        df = (
            join_counted(df.withColumn("_value", F.coalesce(named(c), F.lit(MISSING))), lookup, codes.n, "_value")
            .withColumn(c, F.col("_code"))
            .drop("_value", "_code")
        )
    return df, sizes


def endpoint_report(df: DataFrame, by: Sequence[str] = (), src: str = SOURCE_IP, dst: str = DESTINATION_IP) -> DataFrame:
    """``usable``: the endpoints are not all placeholders and at least one side varies.

    Smallest against largest value tells whether a side varies, without counting distinct values.
    """
    s, d = (F.coalesce(F.trim(c), F.lit("nan")) for c in (src, dst))

    def placeholder(c):
        return (c == PLACEHOLDER_IP) | (F.lower(c) == "nan")

    return df.groupBy(*by).agg(
        (
            ~F.bool_and(placeholder(s) & placeholder(d)) & ((F.min(s) != F.max(s)) | (F.min(d) != F.max(d)))
        ).alias("usable")
    )


def has_usable_endpoints(df: DataFrame, src: str = SOURCE_IP, dst: str = DESTINATION_IP) -> bool:
    if src not in df.columns or dst not in df.columns:
        return False
    return bool(endpoint_report(df, (), src, dst).first()["usable"])


def row_index_per_file(df: DataFrame, order_by: Sequence[str], file: str = SOURCE_FILE) -> DataFrame:
    """Adds ``row_index``, 0-based within each file in ``order_by`` order.

    A file's rows are neighbours in the global index, so its first position is all that is needed.
    """
    ix = dense_index(df, [file, *order_by], index="_i", name="file-rows")
    starts = ix.df.groupBy(file).agg(F.min("_i").alias("_first"))
    placed = join_counted(ix.df, starts, starts.count(), file)
    return placed.select(*[named(c) for c in df.columns], (F.col("_i") - F.col("_first")).alias("row_index"))


def assign_endpoints(
    df: DataFrame,
    order_by: Sequence[str],
    file: str = SOURCE_FILE,
    src: str = SOURCE_IP,
    dst: str = DESTINATION_IP,
) -> DataFrame:
    """Pseudo-endpoints from file name and row number, only where the table has no usable ones."""
    if has_usable_endpoints(df, src, dst):
        return df
    x, y = pseudo_endpoints(F.col(file), F.col("row_index"))
    return row_index_per_file(df, order_by, file).withColumns({src: x, dst: y}).drop("row_index")


def to_binary(df: DataFrame, label: str = LABEL, original: str = LABEL_ORIGINAL) -> DataFrame:
    """Two classes; the old label stays in ``original``."""
    return df.withColumn(original, stripped(label)).withColumn(label, binary_label(label))


def to_training_taxonomy(df: DataFrame, mapping: Mapping[str, str] | None = None, label: str = LABEL) -> DataFrame:
    """Map labels of another vintage; rows whose label has no counterpart are dropped."""
    return df.withColumn(label, mapped_label(label, mapping)).filter(F.col(label).isNotNull())
