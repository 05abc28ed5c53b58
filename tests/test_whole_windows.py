"""Windows with more hosts than any cap."""

import pytest
from test_windows import flows, index, loop

from flowloom.operators import windows as w


@pytest.mark.parametrize("order", ["sources_first", "interleaved"])
def test_all_hosts_are_nodes_by_default(spark, order):
    rows = flows(170, hosts=1000, missing=0.05, seed=3)
    ix, g = index(spark, rows), w.Geometry()
    want = loop(rows, g, interleaved=order == "interleaved")
    assert max(len(x[4]) for x in want) > 100
    edges = w.window_edges(ix, "src", "dst", (), g, size=128, node_order=order).collect()
    got = sorted((e.window_id, e.flow_idx, e.src_node, e.dst_node) for e in edges)
    assert got == sorted((x[0], at, s, d) for x in want for s, d, at in x[5])
    if order == "sources_first":
        assert {r.window_id: r.nodes for r in w.window_nodes(ix, "src", "dst", g).collect()} == {x[0]: x[4] for x in want}
        capped = w.Geometry(max_nodes=5)
        assert max(len(r.nodes) for r in w.window_nodes(ix, "src", "dst", capped).collect()) == 5
