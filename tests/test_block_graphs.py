"""Graph work inside the blocks: the results of the edge rows, and no shuffle of edges."""

import pytest
from test_stored_edges import GEOMETRIES, with_gaps
from test_windows import index, loop

from flowloom.operators import graphs, windows as w
from flowloom.plans.flows import build_window_vectors


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("geo", GEOMETRIES)
def test_blocks_equal_edge_rows(spark, geo):
    rows, ix = with_gaps(spark)
    edges = graphs.by_block(w.window_edges(ix, "src", "dst", ["f"], geo, size=128))
    hops = [graphs.node_means(edges, ["f"]), graphs.propagate(edges, ["f"])]
    for k, expected in enumerate(hops):
        assert rounded(graphs.block_nodes(ix, "src", "dst", ["f"], geo, hops=k, size=128)) == rounded(expected)
    assert rounded(graphs.block_readout(ix, "src", "dst", ["f"], geo, size=128)) == rounded(graphs.readout(hops[1], ["f"]))
    sums = {}
    for x in loop(rows, geo):
        for s, d, at in x[5]:
            n, a, b = sums.get(x[0], (0, 0, 0))
            place = at - x[0] * geo.stride + 1
            sums[x[0]] = n + 1, a + (s + 1) * place, b + (d + 1) * place
    found = w.edge_fingerprints(ix, "src", "dst", geo, size=128).collect()
    assert {r.window_id: (r.n_edges, r.src_sum, r.dst_sum) for r in found} == sums


@pytest.mark.parametrize("geo", GEOMETRIES)
def test_vectors_equal_fused_parts(spark, geo):
    ix = with_gaps(spark)[1]
    edges = graphs.by_block(w.window_edges(ix, "src", "dst", ["f"], geo))
    parts = graphs.fuse(w.window_means(ix, ["f"], geo, label="label"), graphs.readout(graphs.propagate(edges, ["f"]), ["f"]), ["f"])
    show = lambda df: rounded(df.selectExpr("window_id", "label", "features[0]", "features[1]"))
    vectors = build_window_vectors(ix, ["f"], "src", "dst", "label", geo)
    assert show(vectors) == show(parts)
    assert exchanges(vectors) <= 2  # the flows by block, and the broadcast offsets of the index


def test_an_empty_table_has_no_vectors(spark):
    assert build_window_vectors(index(spark, []), ["f"], "src", "dst", "label").count() == 0
