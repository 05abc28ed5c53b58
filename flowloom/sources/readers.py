"""Flow tables from CSV and parquet files."""

from __future__ import annotations

import csv
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowloom.fixed_values import SOURCE_FILE
from flowloom.operators.columns import select_existing, unique_names

CORRUPT = "_corrupt_record"
# Where a row stands in its file: split start, then reading order inside the split.
POSITION = ["_split_start", "_split_row"]


@dataclass(frozen=True)
class FileHead:
    path: str
    header: str
    utf8: bool


def inspect_csv(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.csv") -> list[FileHead]:
    """Header line and encoding of every matching file, in name order.

    The files are read as raw lines in parallel; one row per file reaches the
    driver. Hidden files, such as editor locks, are not listed by Spark.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(paths).select(
        "value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"),
    )
    heads = lines.groupBy("file_path").agg(
        F.min_by(F.col("value").cast("binary"), F.struct("at", "row")).alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
    )
    found = []
    for r in heads.collect():
        text = bytes(r["header"]).decode("utf-8" if r["utf8"] else "latin-1")
        found.append(FileHead(r["file_path"], text.rstrip("\r").removeprefix("\ufeff"), r["utf8"]))
    if not found:
        raise FileNotFoundError(f"no {pattern} under {paths}")
    return sorted(found, key=lambda f: os.path.basename(f.path))


def read_flow_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    pattern: str = "*.csv",
    columns: Iterable[str] | None = None,
    bad_rows: str = "skip",
    with_position: bool = False,
) -> tuple[DataFrame, list[str]]:
    """All matching CSV files as one table of text columns plus ``SourceFile``.

    Headers are trimmed; of repeated names the first keeps its name and the
    later ones are returned as the second value, to be dropped. Files with
    equal header and encoding share one scan, the scans are united by name.
    Rows with too many fields are skipped (``bad_rows="skip"``) or kept with
    their text in ``_corrupt_record`` (``"keep"``); short rows are filled with nulls.
    """
    groups: dict[tuple[str, bool], list[str]] = defaultdict(list)
    for head in inspect_csv(spark, paths, pattern):
        groups[head.header, head.utf8].append(head.path)
    repeats: list[str] = []
    out: DataFrame | None = None
    for (header, utf8), files in groups.items():
        names, repeated = unique_names(next(csv.reader([header])))
        repeats += [c for c in repeated if c not in repeats]
        part = _scan(spark, files, names, "UTF-8" if utf8 else "ISO-8859-1", with_position)
        if columns is not None:
            wanted = [c for c in columns if c in names]
            extra = [c for c in part.columns if c not in names]
            part = part.select(*[F.col(f"`{c}`") for c in [*wanted, *extra]])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if columns is not None:
        repeats = [c for c in repeats if c in out.columns]
    if bad_rows == "skip":
        out = out.filter(~F.col("_too_long")).drop(CORRUPT)
    elif bad_rows != "keep":
        raise ValueError(bad_rows)
    return out.drop("_too_long"), repeats


def _as_pattern(uri: str) -> str:
    """The path pattern that matches the file of a ``_metadata.file_path`` alone."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def _scan(spark: SparkSession, files: list[str], names: list[str], encoding: str, with_position: bool) -> DataFrame:
    # Whole lines are parsed even when few columns are wanted: a pruned parser does not see surplus fields.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    df = (
        spark.read.schema(schema)
        .options(
            header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False
        )
        .csv([_as_pattern(f) for f in files])
    )
    unquoted = F.regexp_replace(CORRUPT, '"[^"]*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    # Spark refuses a scan of the corrupt-record column alone, as a bare count would make it;
    # the always-true second test reads a data column too.
    reads_data = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0
    extra = {
        SOURCE_FILE: F.col("_metadata.file_name"),
        "_too_long": F.coalesce((fields > len(names)) & reads_data, F.lit(False)),
    }
    if with_position:
        extra |= {
            POSITION[0]: F.col("_metadata.file_block_start"),
            POSITION[1]: F.monotonically_increasing_id(),
        }
    return df.withColumns(extra)


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A parquet table, pruned to the wanted columns that exist; the missing ones are returned."""
    df = spark.read.parquet(path)
    return select_existing(df, columns) if columns is not None else (df, [])


def read_table(
    spark: SparkSession, base: str, columns: Iterable[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """``base.parquet`` if it can be read, else ``base.csv``; the missing columns are returned."""
    columns = list(columns) if columns is not None else None
    try:
        return read_parquet(spark, f"{base}.parquet", columns)
    except AnalysisException:
        df, repeats = read_flow_csv(spark, f"{base}.csv", pattern="*", columns=columns)
        df = df.drop(*repeats)
        present = set(df.columns)
        return df, [c for c in columns or [] if c not in present]
