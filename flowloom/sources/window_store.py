"""Windows and their edges on disk: two bucketed parquet tables and a one-row description.

Both tables are bucketed by the block a window starts in, so a join of windows with their edges (on ``block`` and ``window_id``) reads
matching buckets side by side, without a shuffle. The layout is in the file names; a session that did not write the store declares the
tables over the folder again.

A row of the edge table holds the edges of ``WINDOWS_PER_ROW`` windows: node ids and flow places by window, and the features of their flows
once, since these overlap. The edges of a block are made where its flows are and never shuffled; ``read_window_store`` gives one row per edge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, fields
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.functions.values import named
from flowloom.operators.lookup import label_index
from flowloom.operators.ordering import Indexed
from flowloom.operators.windows import BlockGraphs, Geometry, block_size, map_block_graphs, window_labels, window_sequences


#: Blocks that share a bucket, and the most buckets Spark allows by default.
BLOCKS_PER_BUCKET, MOST_BUCKETS = 8, 100_000
WINDOWS_PER_ROW = 16
_NUMBERS = (("smallint", np.int16), ("int", np.int32), ("bigint", np.int64))


def _nodes(g: Geometry) -> int:
    """More than any node id; a pair of ids is stored as ``source * _nodes + target``."""
    return 2 * g.graph_size


def _table_name(path: str, part: str) -> str:
    return f"flowloom_{md5(path.encode()).hexdigest()[:16]}_{part}"


def _write_bucketed(dealt: DataFrame, path: str, part: str, buckets: int) -> None:
    """One file per bucket, its windows in order; ``dealt`` lies in that many partitions by block."""
    writer = dealt.write.mode("overwrite").bucketBy(buckets, "block").sortBy("block", "window_id")
    writer.option("path", f"{path}/{part}").option("compression", "zstd").saveAsTable(_table_name(path, part), format="parquet")


def _edge_rows(
    ix: Indexed, src: str, dst: str, features: Sequence[str], g: Geometry, cap: int | None, size: int, buckets: int
) -> DataFrame:
    """``(block, window_id, windows, c0, c1, ...)``: the edges of the windows from ``window_id`` on, and each feature of their flows.

    ``windows`` has ``(ends, places)`` of each: per edge both node ids in one number (``_nodes``) and its flow, counted from the window's
    first; no places where every flow is an edge.
    """
    number, dtype = next((n, t) for n, t in _NUMBERS if _nodes(g) ** 2 <= np.iinfo(t).max)
    types = dict(ix.df.dtypes)

    def rows(b: BlockGraphs) -> dict[str, pa.Array | np.ndarray]:
        first = np.arange(0, len(b.starts), WINDOWS_PER_ROW)
        w, p = np.nonzero(b.kept)
        per_window = np.concatenate([[0], np.cumsum(b.kept.sum(axis=1))]).astype(np.int32)
        ends = b.source[w, p].astype(np.int64) * _nodes(g) + b.target[w, p]
        gaps = (b.kept[:, 1:] & ~b.kept[:, :-1]).any(axis=1) | ~b.kept[:, 0]
        some = np.concatenate([[0], np.cumsum(np.where(gaps, np.diff(per_window), 0))]).astype(np.int32)
        places = pa.ListArray.from_arrays(some, pa.array(p[gaps[w]].astype(np.int32)), mask=pa.array(~gaps))
        windows = pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(per_window, pa.array(ends.astype(dtype))), places], ["ends", "places"]
        )
        per_row = np.append(first, len(b.starts)).astype(np.int32)
        last = b.starts[np.minimum(first + WINDOWS_PER_ROW, len(b.starts)) - 1]
        ends = np.minimum(last + g.graph_size, len(b.flows))
        spans = ends - b.starts[first]
        offsets = np.concatenate([[0], np.cumsum(spans)])
        at = np.arange(offsets[-1]) + np.repeat(b.starts[first] - offsets[:-1], spans)
        return {
            "window_id": b.window_ids(g)[first],
            "windows": pa.ListArray.from_arrays(per_row, windows),
            **{
                f"c{k}": pa.ListArray.from_arrays(offsets.astype(np.int32), b.flows[f"c{k}"].take(at).combine_chunks())
                for k in range(len(features))
            },
        }

    lists = f"windows array<struct<ends: array<{number}>, places: array<int>>>"
    schema = ", ".join(["window_id long", lists, *[f"c{k} array<{types[f]}>" for k, f in enumerate(features)]])
    carried = {f"c{k}": named(f) for k, f in enumerate(features)}
    return map_block_graphs(ix, src, dst, carried, rows, schema, g, cap, size, buckets)


def _edges_of(stored: DataFrame, features: Sequence[str], g: Geometry) -> DataFrame:
    """``(block, window_id, edge_pos, src_node, dst_node, flow_idx, *features)`` of the stored rows, one row per edge."""
    carried = [f"c{k}" for k in range(len(features))]
    by_window = stored.select("block", "window_id", F.posexplode("windows").alias("_w", "_e"), *carried)
    by_edge = by_window.select("block", "window_id", "_w", F.posexplode("_e.ends").alias("edge_pos", "_ends"), "_e.places", *carried)
    window, ends = F.col("window_id") + F.col("_w"), F.col("_ends").cast("long")
    place = F.when(F.col("places").isNull(), F.col("edge_pos")).otherwise(F.col("places")[F.col("edge_pos")])
    return by_edge.select(
        "block", window.alias("window_id"), "edge_pos",
        F.floor(ends / _nodes(g)).cast("int").alias("src_node"), (ends % _nodes(g)).cast("int").alias("dst_node"),
        (window * g.stride + place).alias("flow_idx"),
        *[F.col(c)[F.col("_w") * g.stride + place].alias(f) for c, f in zip(carried, features)],
    )


def _edge_counts(stored: DataFrame) -> DataFrame:
    """``(block, window_id, edges, last)`` of the stored rows; both numbers agree where each edge has its place."""
    by_window = stored.select("block", F.posexplode("windows").alias("_w", "_e"), "window_id")
    n = F.size("_e.ends").cast("long")
    return by_window.filter(n > 0).groupBy("block", (F.col("window_id") + F.col("_w")).alias("window_id")).agg(
        F.sum(n).alias("edges"), (F.max(F.when(F.col("_e.places").isNull(), n).otherwise(F.size("_e.places"))) - 1).alias("last")
    )


def _read_bucketed(spark: SparkSession, path: str, part: str, buckets: int | None) -> DataFrame:
    files = spark.read.parquet(f"{path}/{part}")
    if not buckets:
        return files
    name = _table_name(path, part)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (block) SORTED BY (block, window_id) "
        f"INTO {buckets} BUCKETS LOCATION '{path}/{part}'"
    )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def store_exists(spark: SparkSession, path: str) -> bool:
    meta = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return meta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(meta)


def write_window_store(
    ix: Indexed,
    features: Sequence[str],
    label: str,
    label2idx: Mapping[str, int],
    src: str,
    dst: str,
    path: str,
    g: Geometry = Geometry(),
    cap: int | None = None,
    sequences: bool = True,
    force: bool = False,
) -> bool:
    """Write the store; an existing one is kept unless ``force``. Returns whether it was written.

    ``sequences=False`` leaves out the float matrices, which repeat every flow
    ``seq_len`` times. The description goes last and marks the store complete.
    """
    spark = ix.df.sparkSession
    if store_exists(spark, path) and not force:
        return False
    features = list(features)
    windows = window_sequences(ix, features, g, cap, label) if sequences else window_labels(ix, label, g, cap)
    size = block_size(ix, g)
    buckets = min(MOST_BUCKETS, -(-max(1, ix.n) // (size * BLOCKS_PER_BUCKET)))
    block = F.floor(F.col("window_id") * g.stride / size)
    windows = windows.withColumns({"block": block, "y": label_index(F.col("label"), label2idx)})
    _write_bucketed(windows.repartition(buckets, "block"), path, "windows", buckets)
    _write_bucketed(_edge_rows(ix, src, dst, features, g, cap, size, buckets), path, "window_edges", buckets)
    meta = {
        **asdict(g),
        "buckets": buckets,
        "n_flows": ix.n,
        "num_items": g.count(ix.n, cap),
        "num_features": len(features),
        "feat_cols": features,
        "label2idx": dict(label2idx),
    }
    spark.createDataFrame([meta], _META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return True


_META = (
    "seq_len int, graph_size int, stride int, max_nodes int, n_flows long, num_items long, "
    "num_features int, feat_cols array<string>, label2idx map<string,int>, buckets int"
)


def store_integrity(windows: DataFrame, edges: DataFrame, num_items: int) -> DataFrame:
    """``windows``, ``repeated``, ``out_of_range``, ``stray_edges``, ``edge_gaps``; all but the first must be 0.

    Edges of a window must belong to a stored window and be numbered without gaps. Tables with blocks are joined by block.
    """
    keys = ["block", "window_id"] if "block" in windows.columns and "block" in edges.columns else ["window_id"]
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"), F.max("edge_pos").alias("last"))
    return _integrity(windows, e, keys, num_items)


def _integrity(windows: DataFrame, e: DataFrame, keys: list[str], num_items: int) -> DataFrame:
    w = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return (
        w.join(e, keys, "full")
        .agg(
            F.count("rows").alias("windows"),
            F.count_if(F.col("rows") > 1).alias("repeated"),
            F.count_if((F.col("window_id") < 0) | (F.col("window_id") >= num_items)).alias("out_of_range"),
            F.count_if(F.col("rows").isNull()).alias("stray_edges"),
            F.count_if(F.col("edges") != F.col("last") + 1).alias("edge_gaps"),
        )
    )


def read_window_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """``(windows, edges, meta)``; fails when the tables do not fit together."""
    meta = spark.read.schema(_META).json(f"{path}/meta").first().asDict()
    windows = _read_bucketed(spark, path, "windows", meta["buckets"])
    stored = _read_bucketed(spark, path, "window_edges", meta["buckets"])
    edges = _edges_of(stored, meta["feat_cols"], Geometry(**{f.name: meta[f.name] for f in fields(Geometry)}))
    found = _integrity(windows, _edge_counts(stored), ["block", "window_id"], meta["num_items"]).first().asDict()
    if found.pop("windows") != meta["num_items"] or any(found.values()):
        raise ValueError(f"window store {path} does not match its description: {found}")
    return windows, edges, meta
