"""Line deduplication by winnowing over line hashes (operator 8): later repeats of runs of lines and of long lines go.

A document is the sequence of its lines that have a word, each without the white space around it. Of every ``run`` lines
in a row the smallest line hash is the fingerprint, so every repeated run has a fingerprint in common with its repeat.
Fingerprint positions are joined, and matches are extended both ways over the lines around them (see ``repeats``).
A line is deleted if it is part of a run that also starts at an earlier place, overlaps included; places are ordered by
id (nulls first), row and line. The first one stays.

With ``alone``, a line of so many words is deleted by itself if it also stands at an earlier place, and so is the only line of a
document, however short, if it also is the only line of an earlier one. Both are joined by their hash with the first place of it.

Lines without words are never deleted. Null texts stay null, empty ones empty. The later of two repeated rows
loses all its lines; without ``alone``, if there are ``run`` or more. Further columns are kept; a new column whose name is taken gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.arrays import text_groups, word_hashes, words
from flowloom.llm.repeats import covered, repeated_windows, runs
from flowloom.llm.rows import free_name, identified

#: Consecutive lines that make a repeat.
RUN = 2
#: Words of a line that is a repeat by itself.
ALONE = 50


def line_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (after it) of the lines with words, without white space around, document bounds, and words of each line."""
    starts, ends, _ = words(data, offsets)
    breaks = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    line = np.searchsorted(breaks, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = line[1:] != line[:-1]
    last = np.ones(len(starts), bool)
    last[:-1] = new[1:]
    low = starts[new]
    return low, ends[last], np.searchsorted(low, offsets), np.diff(np.append(np.flatnonzero(new), len(starts)))


def _hashes(data: np.ndarray, offsets: np.ndarray, alone: int | None) -> tuple[np.ndarray, ...]:
    low, high, bounds, n_words = line_places(data, offsets)
    values = word_hashes(data, low, high, lower=False) if len(low) else np.zeros(0, np.uint64)
    if alone is None:
        return values, bounds
    by_itself = n_words >= alone
    by_itself[bounds[:-1][np.diff(bounds) == 1]] = True
    at = np.flatnonzero(by_itself)
    return values, bounds, at, np.ones(len(at), np.int64)


def _remaining(raw: bytes, low: np.ndarray, gone: np.ndarray) -> str:
    """The text without the lines that hold the given places."""
    if not gone.any():
        return raw.decode()
    kept, at, dead = [], 0, set(low[gone].tolist())
    for line in raw.split(b"\n"):
        inner = at + len(line) - len(line.lstrip(b" \t\n\x0b\x0c\r"))
        if inner not in dead:
            kept.append(line)
        at += len(line) + 1
    return b"\n".join(kept).decode()


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN, counts: bool = True, alone: int | None = ALONE) -> DataFrame:
    """Every row with the remaining lines as its text; with ``counts``, also ``n_lines``, ``n_removed`` and ``n_runs``."""
    if run < 2:
        raise ValueError("a run has two lines at least")
    new = ["n_lines", "n_removed", "n_runs"] if counts else []
    new = [free_name(df, name) for name in new]
    uid, found = free_name(df, "uid"), free_name(df, "found")
    rows = identified(df, uid)
    hits = repeated_windows(rows, uid, F.col(id), text, partial(_hashes, alone=alone), run, 1, earlier=True)
    joined = rows.join(hits.select(F.col("uid").alias(uid), F.col("found").alias(found)), uid, "left").select(*df.columns, found)
    columns, width, where = df.columns, len(df.columns), df.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column(where).is_valid().to_pylist()
            for first, end, data, offsets in text_groups(batch.column(where)):
                low, _, bounds, _ = line_places(data, offsets)
                gone = covered(batch.column(width).slice(first, end - first), bounds, run)
                left = [
                    _remaining(data[a:b].tobytes(), low[x:y] - a, gone[x:y]) if v else None
                    for a, b, x, y, v in zip(offsets[:-1], offsets[1:], bounds[:-1], bounds[1:], valid[first:end])
                ]
                part = batch.slice(first, end - first).columns[:width]
                part[where] = pa.array(left, part[where].type)
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
                extra = [pa.array(x, pa.int64()) for x in (np.diff(bounds), lost, runs(gone, bounds))] if counts else []
                yield pa.RecordBatch.from_arrays([*part, *extra], names=[*columns, *new])

    schema = T.StructType([*df.schema.fields])
    for name in new:
        schema = schema.add(name, "long")
    return joined.mapInArrow(cut, schema)


def line_digest(documents: DataFrame, alone: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and the digest of the remaining text of every document; only runs go without ``alone``."""
    rows = dedup_lines(documents.select("doc_id", "text"), alone=alone)
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
