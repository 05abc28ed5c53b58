"""Count-based sliding windows over streams of flows, one dense order per capture.

A window is known for good when the flow that closes it has come: with ``n`` flows of a capture, windows start before
``n - seq_len - graph_size``, as in the batch. The state of a capture is its number of flows and the last flows that windows to come still
need, at most ``seq_len + graph_size + stride`` of them, however long the capture is. So the rows that have been written
after any number of micro-batches and restarts are those of the batch windows over what has arrived.

Flows of one micro-batch are put in order by ``order``; micro-batches must follow one another in time (a file per time span, as
captures are rotated). A capture is sequential by nature, so captures run in parallel and a long one is cut by its micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowloom.fixed_values import BENIGN
from flowloom.operators.windows import Geometry, _block_edges

#: Flows of a capture whose windows are worked out at once.
CHUNK = 8192
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Windows(StatefulProcessor):
    """Keeps the last flows of a capture and emits the windows that each new flow closes."""

    def __init__(self, order: list[str], held: dict[str, str], geometry: dict):
        self.order, self.held, self.geometry = order, held, geometry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flows = handle.getListState("flows", ", ".join(f"`{c}` {t}" for c, t in self.held.items()))
        self.place = handle.getValueState("place", "first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g, columns = Geometry(**self.geometry), list(self.held)
        first = self.place.get()[0] if self.place.exists() else 0
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")[columns]
        known = pd.DataFrame(list(self.flows.get()) if self.flows.exists() else [], columns=columns)
        for low in range(0, len(new), CHUNK):
            more = new.iloc[low : low + CHUNK]
            flows = pd.concat([known, more], ignore_index=True) if len(known) else more.reset_index(drop=True)
            windows = max(0, -(-(len(flows) - g.seq_len - g.graph_size) // g.stride))
            if windows:
                yield self.emit(key[0], first, flows, windows, g)
            done = windows * g.stride
            first, known = first + done, flows.iloc[done:]
        self.place.update((first,))
        rest = [tuple(None if x is None or x != x else x for x in row) for row in known.astype(object).itertuples(index=False)]
        if rest:
            self.flows.put(rest)
        else:
            self.flows.clear()

    def emit(self, capture: str, first: int, flows: pd.DataFrame, windows: int, g: Geometry) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Means(_Windows):
    """Mean of every feature over the sequence, and the centre flow's label."""

    def emit(self, capture: str, first: int, flows: pd.DataFrame, windows: int, g: Geometry) -> pd.DataFrame:
        starts = np.arange(windows) * g.stride
        label, *features = flows.columns
        centre = flows[label].to_numpy()[starts + g.centre(len(flows))]
        values = flows[features].to_numpy(float)
        frames = np.lib.stride_tricks.sliding_window_view(np.where(np.isnan(values), 0.0, values), g.seq_len, axis=0)[starts]
        out = {"capture": capture, "window_id": (first + starts) // g.stride, "label": [BENIGN if x is None or x != x else x for x in centre]}
        return pd.DataFrame(out | {f: frames[:, k].mean(axis=1) for k, f in enumerate(features)})


class _Edges(_Windows):
    """Edges of every window, numbered as in the batch."""

    def emit(self, capture: str, first: int, flows: pd.DataFrame, windows: int, g: Geometry) -> pd.DataFrame:
        src, dst = flows.columns
        kernel = _block_edges(len(flows), windows, g, "_i", src, dst, [], False)
        edges = kernel(flows.assign(_i=np.arange(len(flows)), block=0)).drop(columns="block")
        edges["window_id"] += first // g.stride
        edges["flow_idx"] += first
        edges.insert(0, "capture", capture)
        return edges


def _transformed(stream: DataFrame, capture: str, processor: _Windows, schema: str, needed: Sequence[str]) -> DataFrame:
    stream.sparkSession.conf.set(_STORE, _ROCKS)  # the only state store for such state
    rows = stream.select(capture, *dict.fromkeys(needed))
    return rows.groupBy(capture).transformWithStateInPandas(processor, schema, "Append", "None")


def stream_window_means(
    stream: DataFrame, capture: str, order: Sequence[str], label: str, features: Sequence[str], g: Geometry = Geometry()
) -> DataFrame:
    """``(capture, window_id, label, *features)`` of every closed window; a missing value counts as zero, a missing label as benign."""
    held = {label: "string"} | dict.fromkeys(features, "double")
    schema = ", ".join(["capture string", "window_id long", "label string", *[f"`{f}` double" for f in features]])
    return _transformed(stream, capture, _Means(list(order), held, asdict(g)), schema, [*order, *held])


def stream_window_edges(stream: DataFrame, capture: str, order: Sequence[str], src: str, dst: str, g: Geometry = Geometry()) -> DataFrame:
    """``(capture, window_id, edge_pos, src_node, dst_node, flow_idx)`` of every closed window; flows without an endpoint give none."""
    schema = "capture string, window_id long, edge_pos int, src_node int, dst_node int, flow_idx long"
    return _transformed(stream, capture, _Edges(list(order), {src: "string", dst: "string"}, asdict(g)), schema, [*order, src, dst])
