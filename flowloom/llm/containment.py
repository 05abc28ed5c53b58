"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

Items are short and documents long, so MinHash is used on the items' side only, by bottom-k: an item of n shingles is
found if a share of its shingles is in a document, hence one of its first ``n - ceil(share * n) + 1`` shingles in any fixed
order is. k is a function of the size n, the item's size partition; no item is missed. The order is by hash, but shingles of more documents (by
powers of two) come after those of fewer, so a common phrase makes candidates only where an item consists of such phrases.

All shingles of documents pass a Bloom filter of fixed size over the items' shingles. What passes is joined with the bottom-k
rows alone; that gives the candidate pairs, and only for those the item's shingles are looked up in the document and counted.
Items of equal text are searched for once. Shingles and items that many documents share are dealt out (see ``hot``).

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; shingles have five words. An item of fewer words is its whole
sequence, looked for as such. Items and documents without words match nothing. Items with a null id and
repeated items count like others; each (document, item) row pair is one result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.arrays import mix, shingles, text_groups, word_hashes, words
from flowloom.llm.hot import spread_join
from flowloom.llm.rows import free_name, identified
from flowloom.scratch import stage

_U = np.uint64
#: Bits of the Bloom filter, as a power of two: 16 MB at most, whatever the number of items. More items let more pass.
BLOOM_BITS = 27


def _bit_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((mix(hashes + _U(k)) >> _U(64 - BLOOM_BITS)).astype(np.int64) for k in (1, 2))


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """(item, n, words, h): distinct shingles of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for first, end, data, offsets in text_groups(batch.column(1)):
                starts, ends, bounds = words(data, offsets)
                values, at = shingles(word_hashes(data, starts, ends), bounds, size)
                sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = np.array([len(s) for s in sets])
                row = np.repeat(np.arange(first, end), n)
                columns = [
                    pa.array(uids[row]), pa.array(np.repeat(n, n), pa.int64()), pa.array(np.repeat(np.minimum(np.diff(bounds), size), n).astype(np.int32)),
                    pa.array(np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "n", "words", "h"])

    return items.mapInArrow(run, "item long, n long, words int, h long")


def _bloom(hashes: DataFrame) -> bytes:
    """The filter's bits; the driver gets at most one row per 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(np.concatenate(_bit_places(batch.column(0).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.left_shift(_U(1), (bits & 63).astype(_U)).view(np.int64))], names=["at", "bits"])

    rows = hashes.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    filled[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return filled.tobytes()


def item_classes(items: DataFrame, text: str = "text") -> DataFrame:
    """(item, text): the different texts of the items, numbered."""
    return identified(items.select(F.col(text).alias("text")).where("text is not null").distinct(), "item").select("item", "text")


def matches(docs: DataFrame, classes: DataFrame, uid: str, text: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """(uid, item, n_shared, n_item): items of which ``percent`` of the distinct shingles are in a document.

    ``uid`` of ``docs`` must be repeatable.
    """
    index = stage(item_shingles(classes, size), "items")
    lengths = [r[0] for r in index.select("words").distinct().collect()]  # at most ``size`` numbers
    filled = docs.sparkSession.sparkContext.broadcast(_bloom(index.select("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filled.value, np.uint64)
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for first, end, data, offsets in text_groups(batch.column(1)):
                starts, ends, bounds = words(data, offsets)
                hashes = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, _U)
                for length in lengths:
                    values, at = shingles(hashes, bounds, length, short=False)
                    passed = np.arange(len(values))
                    for k in (0, 1):
                        places = _bit_places(values[passed])[k]
                        passed = passed[(bits[places >> 6] >> (places & 63).astype(_U)) & _U(1) == 1]
                    row = uids[first + np.searchsorted(at, passed, "right") - 1]
                    table = pa.table({"uid": row, "words": np.full(len(row), length, np.int32), "h": values[passed].view(np.int64)})
                    distinct = table.group_by(["uid", "words", "h"]).aggregate([]).select(["uid", "words", "h"]).combine_chunks()
                    yield from distinct.to_batches()

    passed = stage(docs.select(F.col(uid).alias("uid"), F.col(text).alias("text")).mapInArrow(run, "uid long, words int, h long"), "passed")
    least = F.expr(f"(n * {percent} + 99) div 100")
    met = passed.groupBy("h", "words").agg(F.count("*").alias("meets"))
    by_hash = Window.partitionBy("item").orderBy(F.ceil(F.log2(F.coalesce("meets", F.lit(0)) + 1)), "h")
    bottom = index.join(met, ["h", "words"], "left").withColumn("rank", F.row_number().over(by_hash) - 1)
    bottom = stage(bottom.where((F.col("rank") <= F.col("n") - least) & F.col("meets").isNotNull()).select("h", "words", "item", "meets"), "bottom")
    candidates = stage(spread_join(passed, bottom, ["h", "words"], "meets", ["uid"]).select("uid", "item").distinct(), "candidates")
    pairs = candidates.groupBy("item").agg(F.count("*").alias("pairs"))
    wanted = spread_join(candidates, index.join(pairs, "item"), ["item"], "pairs", ["uid"]).select("uid", "item", "n", "words", "h")
    shared = wanted.join(passed, ["uid", "words", "h"]).groupBy("uid", "item", "n").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") >= least).select("uid", "item", "n_shared", F.col("n").alias("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    uid = free_name(docs, "uid")
    rows = identified(docs, uid)
    found = matches(rows, item_classes(items), uid, text, percent, size).select(F.col("uid").alias(uid)).distinct()
    return rows.join(found, uid, "left_anti").select(*docs.columns)


def containment_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item of every document and benchmark item that it contains."""
    rows, classes = identified(documents.select("doc_id", "text"), "uid"), item_classes(benchmark)
    found = rows.select("uid", "doc_id").join(matches(rows, classes, "uid"), "uid")
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").join(classes, "text").select("item", "item_id")
    return found.join(ids, "item").select("doc_id", "item_id", "n_shared", "n_item")
