"""Windows of fixed size that also stand elsewhere, over sequences of 64-bit symbols (shared by operators 2, 7 and 8).

Of every window the smallest k-gram hash is chosen (the leftmost of ties), so equal windows choose the same anchor at the same
offset. Windows of one anchor form a span. Round one ranks spans: equal spans repeat as a whole. Only anchors found with
several different spans go on, one representative each, to window level, where the rank pair of both halves decides. An
anchor's spans travel as rows of ranks to one task if they are ``LARGE_GROUP`` at most; those of larger groups are dealt out
by window rank, with the same result.

Anchors are shuffled once: sorted by anchor and span, a row is next to its equals, and rows without any go. Anchors that a
frequency sketch finds crowded are left out of that and counted by pre-aggregation instead; keys with over a thousandth of all rows
(a thousand keys at most) are then joined by broadcast. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.arrays import Substrings, mix, text_groups, window_minima
from flowloom.scratch import discard, stage

_U = np.uint64
#: A key with more than this share of all rows is hot; so there are HOT_KEYS of them at most.
HOT_KEYS = 1000
#: Rows of an anchor from which on it is crowded, and keys that the sketch of frequencies follows (it errs by some of all rows' 1 / TRACKED).
CROWD, TRACKED = 1 << 15, 1 << 15
#: Different spans of one anchor (of some hundred ranks each at most) that one task takes at once.
LARGE_GROUP = 4096
#: Symbol values and the sequences' bounds in them; also, if wanted, start and length of the pieces that count by themselves.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]
#: Hashes of all k-grams of the values, by start.
Hashes = Callable[[np.ndarray, int], np.ndarray]


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join; ``keyed`` has every key once, with the number of ``rows`` it will meet in ``count``."""
    limit = max(1, total // HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col(count) > limit))
    cold = rows.join(F.broadcast(keyed.where(F.col(count) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(keyed.where(F.col(count) <= limit), keys))


def _gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    return Substrings(values).windows(gram)


def spans(values: np.ndarray, bounds: np.ndarray, size: int, gram: int, hashes: Hashes = _gram_hashes) -> tuple[np.ndarray, ...]:
    """(sequence, first window, windows, anchor hash, span hash) of all spans in the concatenated sequences."""
    none = np.zeros(0, np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(values)) + size <= ends)
    if len(starts) == 0:
        return none, none, none, none, none
    sub = Substrings(values)
    grams = hashes(values, gram)
    anchor = window_minima(grams, size - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    low, n, pos = starts[at], np.diff(np.append(at, len(starts))), anchor[at].astype(np.int64)
    shape = mix((pos - low).astype(np.uint64) * _U(1 << 32) + n.astype(np.uint64))
    name = mix(sub(low, low + n - 1 + size) + shape)
    doc = np.searchsorted(bounds, low, "right") - 1
    return doc, low - bounds[doc], n, grams[pos].view(np.int64), name.view(np.int64)


def lone_spans(values: np.ndarray, bounds: np.ndarray, size: int, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces shorter than a window as spans of their own; ``n`` is such that ``covered`` marks just the piece."""
    doc = np.searchsorted(bounds, start, "right") - 1
    name = mix(Substrings(values)(start, start + length) ^ _U(0xA0761D6478BD642F)).view(np.int64)
    return doc, start - bounds[doc], length - size + 1, name, np.zeros(len(start), np.int64)


def _found_in_groups(batches: Iterator[pa.RecordBatch], earlier: bool) -> Iterator[pa.RecordBatch]:
    """Runs (uid, low, n) of repeated windows, from spans (uid, o, low, copies, h, ranks) sorted by anchor."""
    names = ["uid", "low", "n"]
    waiting: pa.Table | None = None

    def searched(group: pa.Table) -> pa.RecordBatch:
        group = group.combine_chunks()
        uid, o, low, copies = (group.column(k).to_numpy() for k in range(4))
        lists = group.column(5).combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        rank = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        p = low[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
        order = np.lexsort((p, uid[owner], o[owner], rank)) if earlier else np.argsort(rank)
        same = rank[order[1:]] == rank[order[:-1]]
        hit = np.zeros(len(rank), bool)
        hit[order[1:]] = same
        if not earlier:
            hit[order[:-1]] |= same
            hit &= copies[owner] == 1
        begin = hit.copy()
        begin[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
        at = np.flatnonzero(begin)
        length = np.bincount(np.cumsum(begin)[hit] - 1, minlength=len(at))
        return pa.RecordBatch.from_arrays([pa.array(uid[owner[at]]), pa.array(p[at].astype(np.int32)), pa.array(length.astype(np.int32))], names=names)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
        h = rows.column(4).to_numpy()
        changes = np.flatnonzero(h[1:] != h[:-1])
        done = int(changes[-1]) + 1 if len(changes) else 0  # the last anchor may go on
        if done:
            yield searched(rows.slice(0, done))
        waiting = rows.slice(done)
    if waiting is not None:
        yield searched(waiting)


def _crowded(every: DataFrame) -> list[int]:
    """The anchors with about ``CROWD`` rows or more, ``HOT_KEYS`` at most; the largest are surely among them."""
    top = every.agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {max(HOT_KEYS, TRACKED)})").alias("top")).first()["top"]
    return [r["item"] for r in top or [] if r["count"] >= CROWD]


def _open_and_whole(every: DataFrame, earlier: bool) -> tuple[DataFrame, DataFrame]:
    """From all spans (uid, o, low, n, h, s): one of each different span (uid, low, n, copies, h, shapes) of the anchors that have several, and
    those (uid, low, n) that repeat as a whole. ``every`` is staged, and goes when all that has company is written."""
    place = F.struct("o", "uid", "low")
    crowded = _crowded(every)
    is_crowded = F.col("h").isin(crowded) if crowded else F.lit(False)
    by_span, by_anchor = Window.partitionBy("h", "s"), Window.partitionBy("h")
    marked = every.where(~is_crowded).repartition("h").withColumns({"copies": F.count("*").over(by_span), "first": F.min(place).over(by_span)})
    marked = marked.withColumn("is_first", place == F.col("first")).drop("first").withColumn("shapes", F.count_if("is_first").over(by_anchor))
    kept = stage(marked.where("copies > 1 or shapes > 1"), "kept")
    shown = ["uid", "low", "n", "copies", "h", "shapes"]
    firsts = kept.where("is_first and shapes > 1").select(*shown)
    whole = kept.where("copies > 1 and not is_first" if earlier else "copies > 1").select("uid", "low", "n")
    if not crowded:
        discard(every)
        return firsts, whole
    rows = stage(every.where(is_crowded), "crowded")
    discard(every)
    total = rows.count()
    names = stage(rows.groupBy("h", "s").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.min("n").alias("n")), "spans")
    shapes = F.broadcast(names.groupBy("h").agg(F.count("*").alias("shapes")).where("shapes > 1"))  # HOT_KEYS rows at most
    more = names.join(shapes, "h").select("first.uid", "first.low", "n", "copies", "h", "shapes")
    copies = join_hot(rows.drop("n"), names.where("copies > 1"), ["h", "s"], "copies", max(total, 1))
    if earlier:
        copies = copies.where("struct(o, uid, low) > first")
    return firsts.unionByName(more), whole.unionByName(copies.select("uid", "low", "n"))


def repeated_windows(
    df: DataFrame, uid: str, order: Column, text: str, symbols: Symbols, size: int, gram: int, earlier: bool, hashes: Hashes = _gram_hashes
) -> DataFrame:
    """(uid, found): runs of window starts whose window also stands elsewhere, or with ``earlier`` at an earlier place.

    Places are ordered by ``order`` (nulls first), then ``uid``, then position. ``uid`` must be repeatable. Sequences
    shorter than ``size`` have no windows. Pieces that ``symbols`` names beside them are found if the same piece is named
    elsewhere, by the same rule. ``found`` holds at most one entry per symbol and piece of the text.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, orders = (batch.column(k).to_numpy() for k in (0, 1))
            for first, end, data, offsets in text_groups(batch.column(2)):
                values, bounds, *lone = symbols(data, offsets)
                doc, low, n, h, s = spans(values, bounds, size, gram, hashes)
                if lone:
                    doc, low, n, h, s = map(np.concatenate, zip((doc, low, n, h, s), lone_spans(values, bounds, size, *lone)))
                doc = doc + first
                columns = [ids[doc], orders[doc], low.astype(np.int32), n.astype(np.int32), h, s]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "o", "low", "n", "h", "s"])

    half = size // 2

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, orders, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for first, end, data, offsets in text_groups(batch.column(2)):
                values, bounds = symbols(data, offsets)[:2]
                part = lists.slice(first, end - first)
                fields = part.flatten()
                low, n = (fields.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                owner = np.repeat(np.arange(end - first), part.value_lengths().to_numpy())
                edges = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(low + bounds[owner] - edges[:-1], n) + np.arange(edges[-1])
                sub = Substrings(values)
                pair = mix(sub(at, at + half) * _U(0x9FB21C651E98DF25) + sub(at + half, at + size))
                columns = [pa.array(x) for x in (ids[first + owner], orders[first + owner])] + [fields.field(k) for k in (0, 2, 3, 4)]
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(pair.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "o", "low", "copies", "h", "large", "ranks"])

    texts = df.select(F.col(uid).alias("uid"), F.coalesce(order.cast("long"), F.lit(-(1 << 63))).alias("o"), F.col(text).alias("text"))
    every = stage(texts.mapInArrow(anchors, "uid long, o long, low int, n int, h long, s long"), "anchors")
    open_spans, whole = _open_and_whole(every, earlier)
    span = F.struct("low", "n", "copies", "h", (F.col("shapes") > LARGE_GROUP).alias("large"))
    has_large = not open_spans.where(F.col("shapes") > LARGE_GROUP).isEmpty()
    wanted = open_spans.groupBy("uid").agg(F.collect_list(span).alias("spans"))
    ranked = texts.join(wanted, "uid").select("uid", "o", "text", "spans").mapInArrow(ranks, "uid long, o long, low int, copies long, h long, large boolean, ranks array<long>")
    if has_large:
        ranked = stage(ranked, "ranked")
    in_groups = ranked.where("not large").drop("large").repartition("h").sortWithinPartitions("h")
    found = in_groups.mapInArrow(partial(_found_in_groups, earlier=earlier), "uid long, low int, n int")
    if has_large:
        windows = ranked.where("large").select("uid", "o", "low", "copies", F.posexplode("ranks").alias("k", "r")).select("uid", "o", (F.col("low") + F.col("k")).alias("p"), "copies", "r")
        shared = stage(windows.groupBy("r").agg(F.count("*").alias("m"), F.min(F.struct("o", "uid", "p")).alias("least")).where("m > 1"), "shared")
        hits = join_hot(windows if earlier else windows.where("copies = 1"), shared, ["r"], "m", max(windows.count(), 1))
        if earlier:
            hits = hits.where("struct(o, uid, p) > least")
        found = found.union(hits.select("uid", "p", F.lit(1)))
    found = found.union(whole)
    return found.groupBy("uid").agg(F.collect_list(F.struct("low", "n")).alias("found"))


def covered(found: pa.ListArray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Of all symbols, whether a found window covers it. ``found`` has one entry per sequence, null for none."""
    steps = np.zeros(int(bounds[-1]) + 1, np.int64)
    flat = found.flatten()
    lengths = found.value_lengths().fill_null(0).to_numpy()
    low, n = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
    at = low + np.repeat(bounds[:-1], lengths)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n - 1 + size, -1)
    return np.cumsum(steps[:-1]) > 0


def runs(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of maximal runs of true values in every sequence."""
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    inner = bounds[:-1][np.diff(bounds) > 0]
    begin[inner] = mask[inner]
    return np.diff(np.concatenate([[0], np.cumsum(begin)])[bounds])
