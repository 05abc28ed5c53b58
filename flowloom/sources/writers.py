"""Result tables, documents and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from flowloom.fixed_values import ATTACK, BENIGN, LABEL
from flowloom.functions.labels import label_key, label_key_text
from flowloom.operators.artifacts import Artifacts


def write_table(df: DataFrame, base: str, with_csv: bool = False, mode: str = "overwrite") -> None:
    """``base.parquet`` and, on request, ``base.csv``."""
    df.write.mode(mode).parquet(f"{base}.parquet")
    if with_csv:
        df.write.mode(mode).option("header", True).csv(f"{base}.csv")


def write_by_kind(df: DataFrame, path: str, label: str = LABEL, mode: str = "overwrite") -> None:
    """Parquet partitioned into benign and attack rows, so a reader of attacks skips the rest."""
    kind = F.when(label_key(label) == label_key_text(BENIGN), BENIGN).otherwise(ATTACK)
    df.withColumn("kind", kind).write.mode(mode).partitionBy("kind").parquet(path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row, as text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def preprocessing_report(
    row_report: DataFrame,
    dropped_classes: DataFrame,
    other_classes: DataFrame,
    art: Artifacts,
    encoded: Mapping[str, int] | None = None,
) -> DataFrame:
    """``(section, item, value, reason)``: the human-readable preprocessing summary as a table."""
    spark = row_report.sparkSession
    schema = "section string, item string, value long, reason string"
    columns = [("dropped columns", c, None, why) for c, why in art.dropped.items()]
    columns += [("encoded columns", c, n, "frequency-ordered integer encoding") for c, n in (encoded or {}).items()]
    columns += [("features", "numeric features", len(art.features), None)]
    none = F.lit(None).cast("string")

    def section(df: DataFrame, name: str, item: str, value: str, reason: str | None = None) -> DataFrame:
        why = F.lit(reason) if reason else none
        return df.select(F.lit(name).alias("section"), F.col(item).alias("item"), F.col(value).alias("value"), why.alias("reason"))

    return (
        spark.createDataFrame(columns, schema)
        .unionByName(section(row_report, "row cleaning", "item", "rows"))
        .unionByName(section(dropped_classes, "low-support classes", dropped_classes.columns[0], "rows", "class imbalance control"))
        .unionByName(section(other_classes, "other classes", other_classes.columns[0], "rows", "not among the training classes"))
    )


def report_text(report: DataFrame) -> DataFrame:
    """The report as lines of text."""
    line = F.concat_ws(
        "", F.lit("- "), "section", F.lit(" / "), "item",
        F.coalesce(F.concat(F.lit(": "), F.col("value").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), F.col("reason"), F.lit(")")), F.lit("")),
    )
    return report.orderBy("section", "item").select(line.alias("value"))
