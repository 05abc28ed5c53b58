"""Windows and graphs against a plain loop, on small and awkward inputs."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from flowloom.operators import graphs, windows as w
from flowloom.operators.ordering import Indexed, dense_index, running_totals


def flows(n, hosts=9, missing=0.0, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        s, d = (None if rng.random() < missing else f"h{rng.integers(hosts)}" for _ in "sd")
        out.append((int(rng.integers(5)), k, s, d, ["BENIGN", "DDoS", None][int(rng.integers(3))], float(rng.integers(100))))
    return out


SCHEMA = "ts int, k int, src string, dst string, label string, f double"


def loop(rows, g, interleaved=False):
    """Windows of the sorted rows, one after the other."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    n = len(rows)
    result = []
    for wid in range(-(-max(1, n - g.seq_len - g.graph_size) // g.stride)):
        at = wid * g.stride
        end = min(at + g.seq_len, n)
        start = max(0, end - g.seq_len)
        part = rows[at : min(at + g.graph_size, n)]
        order = [x for r in part for x in (r[2], r[3])] if interleaved else [r[2] for r in part] + [r[3] for r in part]
        nodes = list(dict.fromkeys(x for x in order if x is not None))[: g.max_nodes]
        edges = [
            (nodes.index(r[2]), nodes.index(r[3]), at + p)
            for p, r in enumerate(part)
            if r[2] in nodes and r[3] in nodes
        ]
        seq = [0.0] * (g.seq_len - (end - start)) + [r[5] for r in rows[start:end]]
        result.append((wid, start, end, rows[(start + end) // 2][4] or "BENIGN", nodes, edges, seq))
    return result


def index(spark, rows):
    return dense_index(spark.createDataFrame(rows, SCHEMA), ["ts", "k"])


@pytest.mark.parametrize(
    "n, geo, size, missing",
    [
        (1, w.Geometry(), None, 0.0),
        (20, w.Geometry(), None, 0.0),
        (32, w.Geometry(), None, 0.0),
        (96, w.Geometry(), None, 0.2),
        (97, w.Geometry(), None, 0.0),
        (200, w.Geometry(), 64, 0.1),
        (200, w.Geometry(seq_len=8, graph_size=12, stride=3, max_nodes=5), 16, 0.3),
        (150, w.Geometry(seq_len=20, graph_size=4, stride=7, max_nodes=64), 32, 0.0),
    ],
)
def test_windows_equal_loop(spark, n, geo, size, missing):
    rows = flows(n, missing=missing, seed=n)
    ix = index(spark, rows)
    want = loop(rows, geo)
    assert ix.n == n and geo.count(n) == len(want)

    bounds = {r["window_id"]: (r["start"], r["end"]) for r in w.window_bounds(ix, geo).collect()}
    assert bounds == {x[0]: (x[1], x[2]) for x in want}
    labels = {r["window_id"]: r["label"] for r in w.window_labels(ix, "label", geo).collect()}
    assert labels == {x[0]: x[3] for x in want}
    nodes = {r["window_id"]: r["nodes"] for r in w.window_nodes(ix, "src", "dst", geo, size=size).collect()}
    assert nodes == {x[0]: x[4] for x in want}
    seqs = w.window_sequences(ix, ["f"], geo, label="label").collect()
    assert {r["window_id"]: [v[0] for v in r["seq"]] for r in seqs} == {x[0]: x[6] for x in want}
    assert {r["window_id"]: r["label"] for r in seqs} == labels

    edges = w.window_edges(ix, "src", "dst", ["f"], geo, size=size)
    got = {x[0]: [] for x in want}
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    for r in edges.orderBy("window_id", "edge_pos").collect():
        assert r["edge_pos"] == len(got[r["window_id"]])
        assert r["f"] == ordered[r["flow_idx"]][5]
        got[r["window_id"]].append((r["src_node"], r["dst_node"], r["flow_idx"]))
    assert got == {x[0]: x[5] for x in want}

    offsets = w.edge_offsets(ix, edges, geo).orderBy("window_id").collect()
    start = 0
    for r, x in zip(offsets, want, strict=True):
        assert (r["edge_start"], r["edge_end"]) == (start, start + len(x[5]))
        start += len(x[5])


def test_interleaved_order_and_cap(spark):
    geo = w.Geometry(seq_len=4, graph_size=10, stride=2, max_nodes=4)
    rows = flows(60, hosts=12, seed=3)
    ix = index(spark, rows)
    got = {}
    for r in w.window_edges(ix, "src", "dst", (), geo, cap=7, node_order="interleaved").orderBy("window_id", "edge_pos").collect():
        got.setdefault(r["window_id"], []).append((r["src_node"], r["dst_node"], r["flow_idx"]))
    assert got == {x[0]: x[5] for x in loop(rows, geo, True)[:7] if x[5]}


def test_hub_keeps_sources_first(spark):
    rows = [(0, k, f"s{k}", f"d{k}", "BENIGN", 1.0) for k in range(200)]
    ix = index(spark, rows)
    capped = w.Geometry(max_nodes=64)
    nodes = w.window_nodes(ix, "src", "dst", capped).filter("window_id = 0").first()["nodes"]
    assert nodes == [f"s{k}" for k in range(64)]
    assert w.window_edges(ix, "src", "dst", g=capped).count() == 0
    nodes = w.window_nodes(ix, "src", "dst").filter("window_id = 0").first()["nodes"]
    assert nodes == [f"{side}{k}" for side in "sd" for k in range(64)]
    assert w.window_edges(ix, "src", "dst").filter("window_id = 0").count() == 64


def test_all_endpoints_missing_gives_no_edges(spark):
    ix = index(spark, [(0, k, None, None, "BENIGN", 1.0) for k in range(120)])
    assert w.window_edges(ix, "src", "dst").count() == 0
    assert w.edge_offsets(ix, w.window_edges(ix, "src", "dst")).count() == 24


def test_empty_table(spark):
    ix = index(spark, [])
    assert ix.n == 0
    assert w.window_bounds(ix).count() == w.window_edges(ix, "src", "dst").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-1, 6), min_size=9, max_size=9), min_size=1, max_size=6))
def test_first_seen_ids(rows):
    for row, got in zip(rows, w._first_seen_ids(np.array(rows))):
        seen = {}
        assert list(got) == [-1 if x < 0 else seen.setdefault(x, len(seen)) for x in row]


def test_graph_means_against_loop(spark):
    geo = w.Geometry(seq_len=6, graph_size=10, stride=4, max_nodes=6)
    rows = flows(80, hosts=5, missing=0.1, seed=5)
    ix = index(spark, rows)
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    edges = graphs.by_block(w.window_edges(ix, "src", "dst", ["f"], geo))
    got = {(r["window_id"], r["node"]): r["f"] for r in graphs.propagate(edges, ["f"]).collect()}
    out = {r["window_id"]: r["f"] for r in graphs.readout(graphs.propagate(edges, ["f"]), ["f"]).collect()}
    for x in loop(rows, geo):
        if not x[5]:
            assert x[0] not in out
            continue
        size = max(max(e[:2]) for e in x[5]) + 1
        state, count = np.zeros(size), np.zeros(size)
        for _, d, f in x[5]:
            state[d] += ordered[f][5]
            count[d] += 1
        state /= np.maximum(count, 1)
        message = np.zeros(size)
        for s, d, _ in x[5]:
            message[d] += state[s]
        final = state + message / np.maximum(count, 1)
        for s, d, _ in x[5]:
            for node in (s, d):
                assert got[x[0], node] == pytest.approx(final[node])
        assert out[x[0]] == pytest.approx(final.sum() / size)


def test_window_vectors_without_partition_setting(spark):
    """The fused vectors are the same where joins must be repartitioned."""
    from flowloom.plans.flows import build_window_vectors

    ix = index(spark, flows(300, missing=0.1, seed=8))
    make = lambda: sorted(map(str, build_window_vectors(ix, ["f"], "src", "dst", "label").collect()))
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    fused = make()
    spark.conf.set(key, "true")
    try:
        assert make() == fused
    finally:
        spark.conf.set(key, "false")
    assert len(fused) == 204


def test_dense_index_with_one_hot_key(spark):
    """Two thirds of the rows share one timestamp; the tie-break spreads and orders them."""
    rows = [(1 if k % 3 else k, k, None, None, None, 0.0) for k in range(3000)]
    ix = index(spark, rows)
    got = [r["k"] for r in ix.df.orderBy("i").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (r[0], r[1]))]
    assert [r["i"] for r in ix.df.select("i").orderBy("i").collect()] == list(range(3000))


def test_running_totals_restart(spark):
    df = spark.range(2000).selectExpr("id % 3 AS g", "id", "id % 7 AS v")
    got = running_totals(df, ["id"], {"v": "upto"}, restart_by="g").collect()
    sums = {}
    for r in sorted(got, key=lambda r: (r["g"], r["id"])):
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]
        assert r["upto"] == sums[r["g"]]


def test_endpoint_codes_keep_missing(spark):
    rows = flows(50, missing=0.3, seed=2)
    ix = w.encode_endpoints(index(spark, rows), "src", "dst")
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    codes = {}
    for side in (2, 3):
        for r in ordered:
            if r[side] is not None:
                codes.setdefault(r[side], len(codes))
    for r in ix.df.collect():
        assert (r["src_code"], r["dst_code"]) == (codes.get(r["src"], -1), codes.get(r["dst"], -1))


def test_blocks_must_hold_a_window(spark):
    with pytest.raises(ValueError):
        w.in_blocks(Indexed(spark.range(5).withColumnRenamed("id", "i"), 5), w.Geometry(), 10)
