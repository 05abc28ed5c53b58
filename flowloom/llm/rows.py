"""Row identities and Arrow column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.scratch import stage


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _steady(df: DataFrame) -> bool:
    """Whether ``df`` is a plain scan of files under selections and filters that always give the same."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.children().size() == 1:
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.isStreaming():
        return False
    return plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and not plan.relation().bucketSpec().isDefined()


def identified(df: DataFrame, uid: str) -> DataFrame:
    """Add ``uid``, a number that every later reading of the rows gives again.

    Scans of files below deterministic selections and filters number their rows alike each time, once the least number of
    scan tasks is fixed. By default it follows the executors that are alive, so where the session leaves it open, it is set to its present
    value. Any other input (shuffled, limited, sampled, ordered, joined, bucketed) is first written to the shared folder.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if not _steady(df):
        df = stage(df, "rows")
    return df.withColumn(uid, F.monotonically_increasing_id())


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict[str, pa.Array]]], schema: str) -> DataFrame:
    """Map batches to batches; ``f`` yields dictionaries of columns in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in f(batch):
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.mapInArrow(run, schema)
