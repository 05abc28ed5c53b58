"""Count-based sliding windows over the time-sorted flow table and their host graphs.

Window ``w`` starts at flow ``w * stride``. Its sequence is the next
``seq_len`` flows, its graph the next ``graph_size`` flows with hosts as nodes
and flows as edges. Windows overlap, so flows are cut into blocks by position
and the first flows of a block are copied to the block before: each block then
holds every window that starts in it, and blocks run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.fixed_values import BENIGN, GRAPH_SIZE, SEQ_LEN, WINDOW_STRIDE
from flowloom.functions.values import named
from flowloom.operators.lookup import join_counted
from flowloom.operators.ordering import Indexed, dense_index, running_totals

MIN_BLOCK, MAX_BLOCK = 1024, 16384


@dataclass(frozen=True)
class Geometry:
    """Sizes of a window; all its hosts are nodes (``2 * graph_size`` at most), or the first ``max_nodes`` if given."""

    seq_len: int = SEQ_LEN
    graph_size: int = GRAPH_SIZE
    stride: int = WINDOW_STRIDE
    max_nodes: int | None = None

    def count(self, n: int, cap: int | None = None) -> int:
        """Number of windows over ``n`` flows, at most the first ``cap``."""
        if n == 0:
            return 0
        windows = -(-max(1, n - self.seq_len - self.graph_size) // self.stride)
        return windows if cap is None else min(windows, cap)

    def centre(self, n: int) -> int:
        """Distance from a window's first flow to its centre flow."""
        return min(self.seq_len, n) // 2


def _window_id(position: Column, ix: Indexed, g: Geometry, cap: int | None) -> Column:
    """Window starting at ``position``; null where none starts."""
    w = F.floor(position / g.stride)
    starts = (position >= 0) & (F.pmod(position, F.lit(g.stride)) == 0) & (w < g.count(ix.n, cap))
    return F.when(starts, w)


def window_bounds(ix: Indexed, g: Geometry = Geometry(), cap: int | None = None) -> DataFrame:
    """``(window_id, start, end, graph_end)``, half open; a projection of the index."""
    i = F.col(ix.index)
    end = F.least(i + g.seq_len, F.lit(ix.n))
    return (
        ix.df.select(
            _window_id(i, ix, g, cap).alias("window_id"),
            F.greatest(F.lit(0), end - g.seq_len).alias("start"),
            end.alias("end"),
            F.least(i + g.graph_size, F.lit(ix.n)).alias("graph_end"),
        )
        .filter("window_id IS NOT NULL")
    )


def window_labels(
    ix: Indexed, label: str, g: Geometry = Geometry(), cap: int | None = None, default: str = BENIGN
) -> DataFrame:
    """``(window_id, label)``: the label of the centre flow.

    The centre lies a fixed distance after the start, so each flow knows the
    window it is the centre of and neither a join nor a frame is needed.
    """
    w = _window_id(F.col(ix.index) - g.centre(ix.n), ix, g, cap)
    return ix.df.select(w.alias("window_id"), F.coalesce(F.col(label), F.lit(default)).alias("label")).filter(
        "window_id IS NOT NULL"
    )


def block_size(ix: Indexed, g: Geometry, blocks_per_core: int = 4) -> int:
    """Flows per block: enough blocks for all cores, few enough that copies stay rare."""
    cores = ix.df.sparkSession.sparkContext.defaultParallelism
    size = max(MIN_BLOCK, 4 * g.graph_size, 4 * g.seq_len, ix.n // (cores * blocks_per_core))
    return min(size, max(MAX_BLOCK, 4 * g.graph_size, 4 * g.seq_len))


def in_blocks(ix: Indexed, g: Geometry, size: int | None = None) -> tuple[DataFrame, int]:
    """Flows with the ``block`` they serve; border flows appear in two blocks."""
    size = size or block_size(ix, g)
    halo = max(g.seq_len, g.graph_size) - 1
    if halo > size:
        raise ValueError("a block must hold at least one window")
    i = F.col(ix.index)
    own = F.floor(i / size)
    first = F.greatest(F.lit(0), F.floor((i - halo) / size))
    return ix.df.withColumn("block", F.explode(F.sequence(first, own))), size


def _frame(ix: Indexed, length: int):
    return Window.partitionBy("block").orderBy(ix.index).rowsBetween(0, length - 1)


def framed(
    ix: Indexed,
    columns: dict[str, Column],
    length: int,
    g: Geometry = Geometry(),
    cap: int | None = None,
    size: int | None = None,
    label: str | None = None,
    default: str = BENIGN,
) -> DataFrame:
    """``(block, window_id, ...)`` with aggregates over ``length`` flows from each window start.

    With ``label`` the centre flow's label comes from the same pass over the blocks.
    """
    rows, size = in_blocks(ix, g, size)
    i = F.col(ix.index)
    ahead = Window.partitionBy("block").orderBy(ix.index)
    frame = ahead.rowsBetween(0, length - 1)
    out = {name: c.over(frame) for name, c in columns.items()}
    if label:
        out["label"] = F.coalesce(F.lead(label, g.centre(ix.n)).over(ahead), F.lit(default))
    return (
        rows.select(
            "block",
            i.alias("_i"),
            _window_id(i, ix, g, cap).alias("window_id"),
            *[c.alias(name) for name, c in out.items()],
        )
        .filter(F.col("window_id").isNotNull() & (F.floor(F.col("_i") / size) == F.col("block")))
        .drop("_i")
    )


def window_means(
    ix: Indexed, features: list[str], g: Geometry = Geometry(), cap: int | None = None, label: str | None = None
) -> DataFrame:
    """Mean of each feature over the sequence positions; missing positions count as zeros."""
    sums = {f: F.sum(named(f)) for f in features}
    return framed(ix, sums, g.seq_len, g, cap, label=label).withColumns(
        {f: F.coalesce(named(f), F.lit(0.0)) / g.seq_len for f in features}
    )


def window_sequences(
    ix: Indexed, features: list[str], g: Geometry = Geometry(), cap: int | None = None, label: str | None = None
) -> DataFrame:
    """``(window_id, seq)``: the float matrix of each window, zero rows first when flows are too few.

    The matrix repeats each flow ``seq_len`` times; use it only where a model needs it.
    """
    row = F.array(*[named(f).cast("float") for f in features])
    zeros = F.array(*[F.lit(0.0).cast("float") for _ in features])
    seq = F.col("seq")
    padding = F.array_repeat(zeros, F.greatest(F.lit(0), F.lit(g.seq_len) - F.size(seq)))
    return framed(ix, {"seq": F.collect_list(row)}, g.seq_len, g, cap, label=label).withColumn(
        "seq", F.concat(padding, seq)
    )


def window_nodes(
    ix: Indexed, src: str, dst: str, g: Geometry = Geometry(), cap: int | None = None, size: int | None = None
) -> DataFrame:
    """``(window_id, nodes)``: hosts in first-seen order, sources before destinations."""
    lists = {"_s": F.collect_list(src), "_d": F.collect_list(dst)}
    hosts = F.array_distinct(F.concat("_s", "_d"))
    if g.max_nodes is not None:
        hosts = F.slice(hosts, 1, g.max_nodes)
    return framed(ix, lists, g.graph_size, g, cap, size).select(
        "block", "window_id", hosts.alias("nodes")
    )


def _first_seen_ids(ends: np.ndarray) -> np.ndarray:
    """Per row, the rank of each code by first appearance; -1 stays -1."""
    width = np.arange(ends.shape[1])
    order = np.argsort(ends, axis=1, kind="stable")
    ranked = np.take_along_axis(ends, order, 1)
    head = np.ones(ends.shape, bool)
    head[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    run_start = np.maximum.accumulate(np.where(head, width, 0), axis=1)
    first = np.empty_like(order)
    np.put_along_axis(first, order, np.take_along_axis(order, run_start, 1), 1)
    rank = np.cumsum((first == width) & (ends >= 0), axis=1) - 1
    return np.where(ends >= 0, np.take_along_axis(rank, first, 1), -1)


def _previous(codes: np.ndarray) -> np.ndarray:
    """Per position, the last earlier one with the same code; -1 without any."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), -1)
    out[order[1:]] = np.where(codes[order[1:]] == codes[order[:-1]], order[:-1], -1)
    return out


def _next_source(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per position, the first later one whose source is this target; beyond all positions without any."""
    n = len(source)
    keys = np.sort(source * n + np.arange(n))
    at = np.searchsorted(keys, target * n + np.arange(n), "right")
    found = keys[np.minimum(at, n - 1)]
    return np.where((at < n) & (found // n == target), found % n, 2 * n)


def _ids_in_place(codes: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ranks by first appearance in the windows from ``starts``, one row of ``ids`` per position; returns the hosts counted."""
    before, lane, flat = _previous(codes), np.arange(len(starts)), ids.reshape(-1)
    hosts = np.zeros(len(starts), ids.dtype)
    for k in range(len(ids)):
        at = starts + k
        back, given = before[at] - starts, codes[at] >= 0
        new = (back < 0) & given
        same = flat.take(np.maximum(back, 0) * len(starts) + lane)
        ids[k] = np.where(new, hosts, np.where(given, same, -1))
        hosts += new
    return hosts


def ids_in_windows(
    source: np.ndarray, target: np.ndarray, starts: np.ndarray, length: int, interleaved: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Node ids of the sources and of the targets of ``length`` flows from every start, one row per window; -1 stays -1.

    A host's place is looked up through its last one before and, for targets, its next one as a source, so no window is sorted.
    """
    source, target = (np.concatenate([np.asarray(c, np.int64), np.full(length, -1)]) for c in (source, target))
    n, lane = len(starts), np.arange(len(starts))
    ids = np.zeros((2 * length, n), np.int32)
    if interleaved:
        _ids_in_place(np.stack([source, target], 1).ravel(), 2 * starts, ids)
        return np.ascontiguousarray(ids[::2].T), np.ascontiguousarray(ids[1::2].T)
    hosts = _ids_in_place(source, starts, ids[:length])
    before, ahead, flat, place = _previous(target), _next_source(source, target), ids.reshape(-1), np.arange(len(source))
    for k in range(length):
        ahead[k:] = np.where(source[: len(source) - k] == target[k:], place[: len(source) - k], ahead[k:])
        at = starts + k
        first, back, given = ahead[at] - starts, before[at] - starts, target[at] >= 0
        row = np.where(first < length, first, np.where(back >= 0, length + back, -1))
        new = (row < 0) & given
        same = flat.take(np.maximum(row, 0) * n + lane)
        ids[length + k] = np.where(new, hosts, np.where(given, same, -1))
        hosts += new
    return np.ascontiguousarray(ids[:length].T), np.ascontiguousarray(ids[length:].T)


def _starts_in(block: int, size: int, windows: int, g: Geometry) -> np.ndarray:
    """Where windows start in a block, counted from its first flow."""
    low = block * size
    last = min(low + size - 1, (windows - 1) * g.stride)
    return np.arange(-(-low // g.stride) * g.stride, last + 1, g.stride) - low


def _kept(source: np.ndarray, target: np.ndarray, g: Geometry) -> np.ndarray:
    """Flows that are edges: both ends given, and among the first ``max_nodes`` where these are limited."""
    kept = (source >= 0) & (target >= 0)
    return kept if g.max_nodes is None else kept & (source < g.max_nodes) & (target < g.max_nodes)


def _block_edges(
    size: int, windows: int, g: Geometry, index: str, src: str, dst: str, carry: list[str], interleaved: bool
):
    """Edges of all windows that start in one block; all windows of the block at once."""

    def edges(flows: pd.DataFrame) -> pd.DataFrame:
        flows = flows.sort_values(index)
        block = int(flows["block"].iloc[0])
        low = block * size
        starts = _starts_in(block, size, windows, g)
        codes = pd.factorize(pd.concat([flows[src], flows[dst]]))[0].reshape(2, -1)
        source, target = ids_in_windows(*codes, starts, g.graph_size, interleaved)
        kept = _kept(source, target, g)
        w, p = np.nonzero(kept)
        flow = starts[w] + p
        return pd.DataFrame(
            {
                "block": block,
                "window_id": (low + starts[w]) // g.stride,
                "edge_pos": (np.cumsum(kept, axis=1) - 1)[w, p],
                "src_node": source[w, p],
                "dst_node": target[w, p],
                "flow_idx": low + flow,
                **{c: flows[c].to_numpy()[flow] for c in carry},
            }
        )

    return edges


@dataclass(frozen=True)
class BlockGraphs:
    """The windows that start in one block: flows in order, window starts among them, node ids of their flows, which of these are edges."""

    flows: pa.Table
    low: int
    starts: np.ndarray
    source: np.ndarray
    target: np.ndarray
    kept: np.ndarray

    def window_ids(self, g: Geometry) -> np.ndarray:
        return (self.low + self.starts) // g.stride


def map_block_graphs(
    ix: Indexed,
    src: str,
    dst: str,
    columns: Mapping[str, Column],
    result: Callable[[BlockGraphs], dict[str, pa.Array | np.ndarray]],
    schema: str,
    g: Geometry = Geometry(),
    cap: int | None = None,
    size: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``block`` and the columns ``result`` makes of the window graphs of each block; ``columns`` of its flows come with them.

    Only flows are shuffled, each once and border flows twice; edges, ``graph_size`` times as many, live in one block's task alone.
    With ``buckets`` the result lies in that many partitions by block.
    """
    rows, size = in_blocks(ix, g, size)
    windows = g.count(ix.n, cap)
    dealt = rows.filter(F.col("block") * size <= F.lit((windows - 1) * g.stride)).select(
        "block", F.col(ix.index).alias("_at"), named(src).alias("_s"), named(dst).alias("_d"),
        *[c.alias(name) for name, c in columns.items()],
    )
    if buckets:
        dealt = dealt.repartition(buckets, "block")

    def run(flows: pa.Table) -> pa.Table:
        flows = flows.sort_by("_at").combine_chunks()
        block = flows["block"][0].as_py()
        starts = _starts_in(block, size, windows, g)
        hosts = pa.chunked_array([*flows["_s"].chunks, *flows["_d"].chunks]).combine_chunks().dictionary_encode()
        codes = hosts.indices.fill_null(-1).to_numpy().reshape(2, -1)
        ids = ids_in_windows(*codes, starts, g.graph_size)
        found = result(BlockGraphs(flows, block * size, starts, *ids, _kept(*ids, g)))
        rows = len(next(iter(found.values())))
        return pa.table({"block": np.full(rows, block), **found})

    return dealt.groupBy("block").applyInArrow(run, f"block long, {schema}")


def edge_fingerprints(
    ix: Indexed, src: str, dst: str, g: Geometry = Geometry(), cap: int | None = None, size: int | None = None
) -> DataFrame:
    """``(block, window_id, n_edges, src_sum, dst_sum)`` of windows with edges: node ids plus one, weighted by the flow's place in the window."""

    def sums(b: BlockGraphs) -> dict[str, np.ndarray]:
        some = b.kept.any(axis=1)
        place = b.kept[some] * np.arange(1, g.graph_size + 1)
        return {
            "window_id": b.window_ids(g)[some],
            "n_edges": b.kept[some].sum(axis=1),
            "src_sum": np.einsum("wp,wp->w", place, b.source[some] + 1),
            "dst_sum": np.einsum("wp,wp->w", place, b.target[some] + 1),
        }

    return map_block_graphs(ix, src, dst, {}, sums, "window_id long, n_edges long, src_sum long, dst_sum long", g, cap, size)


def window_edges(
    ix: Indexed,
    src: str,
    dst: str,
    carry: list[str] = (),
    g: Geometry = Geometry(),
    cap: int | None = None,
    size: int | None = None,
    node_order: str = "sources_first",
) -> DataFrame:
    """``(block, window_id, edge_pos, src_node, dst_node, flow_idx, *carry)``, one row per edge.

    Node ids follow ``window_nodes``; flows with a missing endpoint, or one
    beyond a given ``max_nodes``, give no edge. ``node_order="interleaved"`` numbers the
    hosts flow by flow instead. Numbering 2 x 64 endpoints per window by array
    expressions costs a linear search per endpoint (38 s for 599,904 windows);
    a block's windows are numbered at once instead. A block is bounded, so is
    the memory of the step. What is wanted per window is better made inside the
    block (``map_block_graphs``) than from these rows.
    """
    if node_order not in ("sources_first", "interleaved"):
        raise ValueError(node_order)
    rows, size = in_blocks(ix, g, size)
    windows = g.count(ix.n, cap)
    reach = F.lit((windows - 1) * g.stride)
    carry = list(carry)
    types = dict(ix.df.dtypes)
    schema = "block long, window_id long, edge_pos int, src_node int, dst_node int, flow_idx long"
    schema = ", ".join([schema, *[f"`{c}` {types[c]}" for c in carry]])
    kernel = _block_edges(size, windows, g, ix.index, src, dst, carry, node_order == "interleaved")
    needed = list(dict.fromkeys(["block", ix.index, src, dst, *carry]))
    return (
        rows.filter(F.col("block") * size <= reach)
        .select(*needed)
        .groupBy("block")
        .applyInPandas(kernel, schema)
    )


def edge_offsets(ix: Indexed, edges: DataFrame, g: Geometry = Geometry(), cap: int | None = None) -> DataFrame:
    """``(window_id, n_edges, edge_start, edge_end)``: where each window's edges lie in one long list.

    Windows without edges are kept with an empty range.
    """
    per_edge = edges.select("window_id", F.lit(1).cast("long").alias("n"))
    per_window = window_bounds(ix, g, cap).select("window_id", F.lit(0).cast("long").alias("n"))
    sizes = per_edge.unionByName(per_window).groupBy("window_id").agg(F.sum("n").alias("n_edges"))
    return running_totals(sizes, ["window_id"], {"n_edges": "edge_end"}, name="edge-offsets").select(
        "window_id", "n_edges", (F.col("edge_end") - F.col("n_edges")).alias("edge_start"), "edge_end"
    )


def endpoint_codes(ix: Indexed, src: str, dst: str) -> Indexed:
    """``(endpoint, code)`` in first-seen order, all sources before destinations."""
    seen = ix.df.select(F.explode(F.array(
        F.struct(F.col(src).alias("endpoint"), F.lit(0).alias("side"), F.col(ix.index).alias("at")),
        F.struct(F.col(dst).alias("endpoint"), F.lit(1).alias("side"), F.col(ix.index).alias("at")),
    )).alias("e")).select("e.*")
    first = (
        seen.filter("endpoint IS NOT NULL")
        .groupBy("endpoint")
        .agg(F.min(F.struct("side", "at")).alias("first"))
        .select("endpoint", "first.side", "first.at")
    )
    codes = dense_index(first, ["side", "at"], index="code", name="endpoint-codes")
    return Indexed(codes.df.select("endpoint", "code"), codes.n, "code")


def encode_endpoints(ix: Indexed, src: str, dst: str) -> Indexed:
    """Adds ``src_code`` and ``dst_code``; -1 where the endpoint is missing."""
    codes = endpoint_codes(ix, src, dst)
    df = ix.df
    for side, out in ((src, "src_code"), (dst, "dst_code")):
        lookup = codes.df.select(F.col("endpoint").alias(side), F.col("code").alias(out))
        df = join_counted(df, lookup, codes.n, side).withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
    return Indexed(df, ix.n, ix.index)
