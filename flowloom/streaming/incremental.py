"""Incremental versions of the per-file and per-chunk jobs.

Each function starts a query that processes what has arrived and stops
(``availableNow``). What was processed is remembered in the checkpoint; a new
checkpoint folder redoes everything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowloom.fixed_values import LABEL, META_COLUMNS
from flowloom.operators.artifacts import Artifacts
from flowloom.operators.cleaning import coerce_numbers, parse_timestamps
from flowloom.operators.features import align
from flowloom.operators.rows import attacks_only
from flowloom.functions.labels import canonical_label


def read_csv_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.csv") -> DataFrame:
    """New CSV files of ``folder`` as text rows with their file name."""
    return (
        spark.readStream.schema(schema)
        .options(header=True, pathGlobFilter=pattern)
        .csv(folder)
        .withColumn("SourceFile", F.col("_metadata.file_name"))
    )


def read_parquet_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def append_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a parquet table."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def materialize_attacks(stream: DataFrame, path: str, checkpoint: str, label: str = LABEL) -> StreamingQuery:
    """Keep the attack rows of files not seen before."""
    return append_table(attacks_only(stream.withColumn(label, canonical_label(label)), label=label), path, checkpoint)


def observed_counts(query: StreamingQuery, name: str) -> dict[str, int]:
    """Totals of the observation ``name`` over the micro-batches of an ended query (as many as it keeps progress of)."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        for key, value in (progress["observedMetrics"].get(name) or Row()).asDict().items() if progress["observedMetrics"] else ():
            total[key] = total.get(key, 0) + value
    return total


def clean_and_append(
    stream: DataFrame, art: Artifacts, path: str, checkpoint: str, meta: Sequence[str] = META_COLUMNS
) -> StreamingQuery:
    """Coerce, align and scale each batch with stored statistics; stateless, so equal to the batch result."""
    return append_table(clean_chunk(stream, art, meta), path, checkpoint)


def clean_chunk(df: DataFrame, art: Artifacts, meta: Sequence[str] = META_COLUMNS) -> DataFrame:
    """The stateless cleaning both the stream and the batch job use."""
    if LABEL in df.columns:
        df = df.withColumn(LABEL, canonical_label(LABEL))
    if "Timestamp" in df.columns:
        df = parse_timestamps(df)
    return align(coerce_numbers(df, meta), art, meta=meta)


def running_label_counts(stream: DataFrame, path: str, checkpoint: str, label: str = LABEL) -> StreamingQuery:
    """Label counts over everything seen so far; ``path`` holds the latest state.

    The state is one row per label. Each batch replaces the table with the
    whole result, so a batch that runs again writes the same rows.
    """

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        stream.groupBy(label)
        .agg(F.count(F.lit(1)).alias("count"))
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def deduplicate(
    stream: DataFrame, keys: Sequence[str], event_time: str, horizon: str, path: str, checkpoint: str
) -> StreamingQuery:
    """Drop repeats that arrive within ``horizon`` of event time; older keys leave the state."""
    unique = stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(keys))
    return append_table(unique, path, checkpoint)


def run(start: Callable[..., StreamingQuery], *args, **kwargs) -> None:
    """Start a query and wait until it has processed what is there."""
    start(*args, **kwargs).awaitTermination()
