"""Suffix-array deduplication by prefix doubling (operator 2): strings of a given length that start at two places go.

Positions are ranked by Spark at growing lengths: by the hash of ``GRAM`` bytes at sampled anchors, by the span of strings
around an anchor, and by the rank pair at offset 0 and half the length; what is unique at one length is not looked at any more.
Sampling loses nothing (see ``repeats``). Hashes have 64 bits; equal hashes count as equal strings.

Null and empty texts have no bytes. A repeated row repeats the row's whole text, so both go if it is long enough. Rows of
empty tables give none; further columns are kept, and a new column whose name is taken gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.arrays import TABLE, text_groups
from flowloom.llm.repeats import covered, repeated_windows, runs
from flowloom.llm.rows import free_name, identified

GRAM = 64


def _bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return TABLE[data], offsets


def removed_bytes(df: DataFrame, text: str = "text", size: int = 200) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (what is left, as bytes) to every row."""
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_bytes": "binary"}
    new = {free_name(df, name): kind for name, kind in new.items()}
    uid, found = free_name(df, "uid"), free_name(df, "found")
    rows = identified(df, uid)
    hits = repeated_windows(rows, uid, F.lit(None), text, _bytes, size, min(GRAM, max(1, size // 2)), earlier=False)
    joined = rows.join(hits.select(F.col("uid").alias(uid), F.col("found").alias(found)), uid, "left").select(*df.columns, found)
    columns, width, where = df.columns, len(df.columns), df.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_groups(batch.column(where)):
                gone = covered(batch.column(width).slice(first, end - first), offsets, size)
                left = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
                counts = [pa.array(x, pa.int64()) for x in (np.diff(offsets), lost, runs(gone, offsets))]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *counts, pa.array(left, pa.binary())], names=[*columns, *new])

    schema = T.StructType([*df.schema.fields])
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return joined.mapInArrow(cut, schema)


def removal_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = removed_bytes(documents.select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
