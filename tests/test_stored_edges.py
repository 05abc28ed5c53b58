"""Edges of the window store against those made from the flows."""

import pytest
from test_windows import flows, index

from flowloom.operators import windows as w
from flowloom.sources import window_store

GEOMETRIES = [
    w.Geometry(),
    w.Geometry(seq_len=8, graph_size=12, stride=3, max_nodes=5),
    w.Geometry(seq_len=20, graph_size=4, stride=7),
]


def with_gaps(spark, n=260):
    """Flows of which some have no value and some no endpoint."""
    rows = [(*r[:5], None if k % 7 == 0 else r[5]) for k, r in enumerate(flows(n, missing=0.1, seed=n))]
    return rows, index(spark, rows)


@pytest.mark.parametrize("geo", GEOMETRIES)
def test_stored_edges_are_those_of_the_windows(spark, tmp_path, geo):
    ix, path = with_gaps(spark)[1], str(tmp_path / "store")
    window_store.write_window_store(ix, ["f", "k"], "label", {"BENIGN": 0, "DDoS": 1}, "src", "dst", path, geo)
    edges = window_store.read_window_store(spark, path)[1]
    expected = w.window_edges(ix, "src", "dst", ["f", "k"], geo)
    assert edges.dtypes == expected.dtypes
    assert sorted(map(str, edges.collect())) == sorted(map(str, expected.collect()))
    stored = spark.read.parquet(f"{path}/window_edges")
    assert stored.count() < 1 + geo.count(ix.n) / 8  # many windows share a row and their flows


def test_a_store_without_some_edges_is_refused(spark, tmp_path):
    ix, path = with_gaps(spark)[1], str(tmp_path / "store")
    window_store.write_window_store(ix, ["f"], "label", {"BENIGN": 0, "DDoS": 1}, "src", "dst", path)
    stored = spark.read.parquet(f"{path}/window_edges")
    cut = "transform(windows, w -> struct(w.ends AS ends, slice(coalesce(w.places, array(0)), 1, 3) AS places)) AS windows"
    stored.selectExpr("block", "window_id", cut, "c0").write.parquet(f"{path}-cut")
    counts = window_store._edge_counts(spark.read.parquet(f"{path}-cut"))
    found = window_store._integrity(spark.read.parquet(f"{path}/windows"), counts, ["block", "window_id"], w.Geometry().count(ix.n)).first()
    assert found["edge_gaps"] == w.Geometry().count(ix.n)
