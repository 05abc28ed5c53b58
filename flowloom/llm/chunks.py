"""Substring deduplication by content-defined cuts (operator 7).

A gear hash rolls over ``GRAM`` bytes: one bit to the left and the next byte's random value added, so a byte is forgotten after as
many steps. Of the hashes inside every ``passage`` bytes the smallest is the cut (see ``repeats``). A mask of zero bits would
cut too, but may leave a passage without any cut. So every passage of
that size has a cut that depends on its own bytes only, and finds it again wherever it stands, shifted or not. The passages
that share a cut are a chunk. Chunks with equal digests repeat as a whole; of different chunks at equal cuts the passages are
compared one by one, so a repeat is followed to its true ends, whatever stands around it. The first one stays (order: id with
nulls first, row, position); every later passage of ``passage`` bytes goes, overlaps included. 51 words have 101 bytes at least,
so with 100 bytes no passage of over 50 words is missed. A document of fewer bytes is one chunk, and goes if an earlier document
is the same; shorter repeats inside documents are common phrases.

A character of UTF-8 goes only if all its bytes do, so what is left is text again. Null texts stay null.
A repeated row loses its whole text. Further columns are kept; a new column whose name is taken gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.arrays import TABLE, text_groups
from flowloom.llm.repeats import covered, repeated_windows, runs, spans
from flowloom.llm.rows import free_name, identified

PASSAGE, GRAM = 100, 32


def _bytes(data: np.ndarray, offsets: np.ndarray, passage: int) -> tuple[np.ndarray, ...]:
    """Byte values, bounds, and the documents shorter than a passage."""
    sizes = np.diff(offsets)
    short = (sizes > 0) & (sizes < passage)
    return TABLE[data], offsets, offsets[:-1][short], sizes[short]


def gear(values: np.ndarray, gram: int) -> np.ndarray:
    """The rolling hash of every ``gram`` bytes, by start: the sum of the byte values, each moved left by its distance from the end.

    Sums of 1, 2, 4, ... bytes are joined as the bits of ``gram`` say. Beyond 64 bytes the first ones have no weight.
    """
    n = len(values) - gram + 1
    if n <= 0:
        return values[:0]
    out, at, part, size = np.zeros(n, np.uint64), 0, values, 1
    while at < gram:
        if gram & size:
            out = (out << np.uint64(size) if size < 64 else 0) + part[at : at + n]
            at += size
        step = np.uint64(size)
        part = (part[:-size] << step if size < 64 else 0) + part[size:]
        size *= 2
    return out


def _chunk_counts(data: np.ndarray, offsets: np.ndarray, passage: int, gram: int) -> np.ndarray:
    sizes = np.diff(offsets)
    doc = spans(TABLE[data], offsets, passage, gram, gear)[0]
    return np.bincount(doc, minlength=len(sizes)) + ((sizes > 0) & (sizes < passage))


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the characters of which some byte stays."""
    if len(data) == 0:
        return gone
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, begins), np.diff(np.append(begins, len(data))))


def dedup_chunks(df: DataFrame, id: str = "doc_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """Every row with the remaining bytes as its text, and ``n_bytes``, ``n_chunks``, ``n_removed`` (bytes) and ``n_spans``."""
    new = [free_name(df, name) for name in ("n_bytes", "n_chunks", "n_removed", "n_spans")]
    uid, found, gram = free_name(df, "uid"), free_name(df, "found"), min(GRAM, max(1, passage // 2))
    rows = identified(df, uid)
    hits = repeated_windows(rows, uid, F.col(id), text, partial(_bytes, passage=passage), passage, gram, earlier=True, hashes=gear)
    joined = rows.join(hits.select(F.col("uid").alias(uid), F.col("found").alias(found)), uid, "left").select(*df.columns, found)
    columns, width, where = df.columns, len(df.columns), df.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column(where).is_valid().to_pylist()
            for first, end, data, offsets in text_groups(batch.column(where)):
                part = batch.slice(first, end - first).columns[:width]
                gone = _whole_characters(data, covered(batch.column(width).slice(first, end - first), offsets, passage))
                left = [data[a:b][~gone[a:b]].tobytes().decode() if v else None for a, b, v in zip(offsets[:-1], offsets[1:], valid[first:end])]
                part[where] = pa.array(left, part[where].type)
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
                counts = (np.diff(offsets), _chunk_counts(data, offsets, passage, gram), lost, runs(gone, offsets))
                yield pa.RecordBatch.from_arrays([*part, *[pa.array(x, pa.int64()) for x in counts]], names=[*columns, *new])

    schema = T.StructType([*df.schema.fields])
    for name in new:
        schema = schema.add(name, "long")
    return joined.mapInArrow(cut, schema)


def chunk_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans and the digest of the remaining text of every document."""
    rows = dedup_chunks(documents.select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
