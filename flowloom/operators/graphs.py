"""Weight-free message passing on window graphs, and fusion with the sequence features.

``block_nodes``, ``block_readout`` and ``block_vectors`` take flows and work inside the blocks the windows start in: no edge is shuffled.
The others take edges as ``window_edges`` rows. These are shuffled once, by block; every
later grouping has ``block`` among its keys and reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from flowloom.fixed_values import BENIGN
from flowloom.functions.values import named
from flowloom.operators.ordering import Indexed
from flowloom.operators.windows import BlockGraphs, Geometry, map_block_graphs

WINDOW_KEY = ["block", "window_id"]
NODE_KEY = [*WINDOW_KEY, "node"]


def by_block(edges: DataFrame) -> DataFrame:
    """The one shuffle of the edge table."""
    return edges.repartition("block")


def _endpoint_rows(edges: DataFrame, features: list[str]) -> DataFrame:
    """Two rows per edge: its target with the edge features, its source with the target as ``peer``."""
    none = {f: F.lit(None).cast("double") for f in features}
    target = F.struct(
        F.col("dst_node").alias("node"), F.lit(None).cast("int").alias("peer"),
        *[named(f).cast("double").alias(f) for f in features],
    )
    source = F.struct(
        F.col("src_node").alias("node"), F.col("dst_node").alias("peer"), *[none[f].alias(f) for f in features]
    )
    return edges.select(*WINDOW_KEY, F.explode(F.array(target, source)).alias("_e")).select(*WINDOW_KEY, "_e.*")


def _mean_or_zero(f: str, over: WindowSpec | None = None) -> Column:
    mean = F.avg(named(f)) if over is None else F.avg(named(f)).over(over)
    return F.coalesce(mean, F.lit(0.0))


def node_means(edges: DataFrame, features: list[str]) -> DataFrame:
    """``(block, window_id, node, ...)``: mean of the incoming edges' features, 0 without any."""
    return (
        _endpoint_rows(edges, features).groupBy(*NODE_KEY).agg(*[_mean_or_zero(f).alias(f) for f in features])
    )


def propagate(edges: DataFrame, features: list[str]) -> DataFrame:
    """One hop: node state plus the mean state of the sources of its incoming edges.

    The state of a source is a windowed mean on the endpoint rows, so it is
    sent to the target without joining edges to nodes.
    """
    state = Window.partitionBy(*NODE_KEY)
    rows = _endpoint_rows(edges, features).select(
        *NODE_KEY, "peer", *[_mean_or_zero(f, state).alias(f) for f in features]
    )
    own = F.struct("node", *[named(f).alias(f"s_{f}") for f in features],
                   *[F.lit(None).cast("double").alias(f"m_{f}") for f in features])
    message = F.struct(F.col("peer").alias("node"), *[F.lit(None).cast("double").alias(f"s_{f}") for f in features],
                       *[named(f).alias(f"m_{f}") for f in features])
    sent = F.explode(F.when(F.col("peer").isNull(), F.array(own)).otherwise(F.array(own, message)))
    return (
        rows.select(*WINDOW_KEY, sent.alias("_e"))
        .select(*WINDOW_KEY, "_e.*")
        .groupBy(*NODE_KEY)
        .agg(*[(F.max(named(f"s_{f}")) + _mean_or_zero(f"m_{f}")).alias(f) for f in features])
    )


def readout(nodes: DataFrame, features: list[str]) -> DataFrame:
    """Mean over nodes per window; the node count is the largest edge endpoint plus one."""
    size = F.max("node") + 1
    return nodes.groupBy(*WINDOW_KEY).agg(
        size.alias("n_nodes"), *[(F.sum(named(f)) / size).alias(f) for f in features]
    )


def fuse(sequence: DataFrame, graph: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Replaces the features by one array: sequence means, then graph means; zeros without a graph.

    Both sides are partitioned by block, so the join moves no rows where
    ``spark.sql.requireAllClusterKeysForCoPartition`` is off.
    """
    graph = graph.select(*WINDOW_KEY, *[named(f).alias(f"g_{f}") for f in features])
    parts = [named(f) for f in features] + [F.coalesce(named(f"g_{f}"), F.lit(0.0)) for f in features]
    kept = [c for c in sequence.columns if c not in (*WINDOW_KEY, *features)]
    return sequence.join(graph, WINDOW_KEY, "left").select("window_id", *kept, F.array(*parts).alias(out))


#: Windows whose nodes are held as one matrix inside a block.
SLICE = 1024


def _doubles(features: Sequence[str]) -> dict[str, Column]:
    return {f"f{k}": named(f).cast("double") for k, f in enumerate(features)}


def _states(b: BlockGraphs, features: int, hops: int) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray]]]:
    """Per slice of windows: which nodes are there and their state by feature, after ``hops`` hops (0 or 1); a window per row, a node per column."""
    values = [b.flows[f"f{k}"].to_numpy() for k in range(features)]
    for first in range(0, len(b.starts), SLICE):
        part = slice(first, first + SLICE)
        kept = b.kept[part]
        width = 1 + max(int(b.source[part].max()), int(b.target[part].max()), 0)
        size = len(kept) * width
        w, p = np.nonzero(kept)
        source, target = (w * width + ids[part][w, p] for ids in (b.source, b.target))
        degree = np.bincount(target, minlength=size)
        there = degree > 0
        there[source] = True
        states = []
        for v in values:
            v = v[b.starts[part][w] + p]
            known = ~np.isnan(v)
            counted = np.bincount(target[known], minlength=size)
            state = np.bincount(target[known], v[known], size) / np.maximum(counted, 1)
            if hops:
                state = state + np.bincount(target, state[source], size) / np.maximum(degree, 1)
            states.append(state.reshape(-1, width))
        yield part, there.reshape(-1, width), states


def block_nodes(
    ix: Indexed, src: str, dst: str, features: Sequence[str], g: Geometry = Geometry(), cap: int | None = None, hops: int = 1, size: int | None = None
) -> DataFrame:
    """``node_means`` (``hops=0``) or ``propagate`` (``hops=1``) of all window graphs."""

    def nodes(b: BlockGraphs) -> dict[str, np.ndarray]:
        ids, parts = b.window_ids(g), []
        for part, there, states in _states(b, len(features), hops):
            w, node = np.nonzero(there)
            parts.append([ids[part][w], node.astype(np.int32), *[x[w, node] for x in states]])
        return dict(zip(["window_id", "node", *features], map(np.concatenate, zip(*parts))))

    schema = ", ".join(["window_id long", "node int", *[f"`{f}` double" for f in features]])
    return map_block_graphs(ix, src, dst, _doubles(features), nodes, schema, g, cap, size)


def _read_out(b: BlockGraphs, features: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Node count and mean state after one hop of every window; 0 without edges."""
    count, means = np.zeros(len(b.starts), np.int32), [np.zeros(len(b.starts)) for _ in range(features)]
    for part, there, states in _states(b, features, 1):
        count[part] = (there * np.arange(1, there.shape[1] + 1)).max(axis=1)
        for mean, state in zip(means, states):
            mean[part] = np.where(there, state, 0.0).sum(axis=1) / np.maximum(count[part], 1)
    return count, means


def block_readout(
    ix: Indexed, src: str, dst: str, features: Sequence[str], g: Geometry = Geometry(), cap: int | None = None, size: int | None = None
) -> DataFrame:
    """``readout`` after one hop, of all windows with edges."""

    def readouts(b: BlockGraphs) -> dict[str, np.ndarray]:
        count, means = _read_out(b, len(features))
        some = count > 0
        return {"window_id": b.window_ids(g)[some], "n_nodes": count[some], **{f: m[some] for f, m in zip(features, means)}}

    schema = ", ".join(["window_id long", "n_nodes int", *[f"`{f}` double" for f in features]])
    return map_block_graphs(ix, src, dst, _doubles(features), readouts, schema, g, cap, size)


def block_vectors(
    ix: Indexed,
    src: str,
    dst: str,
    label: str,
    features: Sequence[str],
    g: Geometry = Geometry(),
    cap: int | None = None,
    size: int | None = None,
    default: str = BENIGN,
    out: str = "features",
) -> DataFrame:
    """``(window_id, label, features)``: ``fuse`` of sequence means and read-out, with the label of the centre flow, from one pass over a block."""
    centre = g.centre(ix.n)

    def vectors(b: BlockGraphs) -> dict[str, np.ndarray | pa.Array]:
        columns = []
        for k in range(len(features)):
            column = np.pad(b.flows[f"f{k}"].fill_null(0.0).to_numpy(), (0, g.seq_len))
            columns.append(np.lib.stride_tricks.sliding_window_view(column, g.seq_len)[b.starts].sum(axis=1) / g.seq_len)
        columns += _read_out(b, len(features))[1]
        flat = np.stack(columns, axis=1).ravel() if columns else np.zeros(0)
        offsets = np.arange(len(b.starts) + 1, dtype=np.int32) * len(columns)
        return {
            "window_id": b.window_ids(g),
            "label": b.flows["label"].take(b.starts + centre),
            "vector": pa.ListArray.from_arrays(offsets, pa.array(flat)),
        }

    carried = {"label": F.coalesce(F.col(label), F.lit(default)), **_doubles(features)}
    schema = "window_id long, label string, vector array<double>"
    made = map_block_graphs(ix, src, dst, carried, vectors, schema, g, cap, size)
    return made.select("window_id", "label", F.col("vector").alias(out))
