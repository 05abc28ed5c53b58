"""Windows over arriving captures equal the batch windows, after micro-batches and restarts."""

import random

from pyspark.sql import functions as F

from flowloom.operators import windows as w
from flowloom.operators.ordering import dense_index
from flowloom.streaming import incremental as inc, windows as live

GEO = w.Geometry(seq_len=4, graph_size=7, stride=3)
SCHEMA = "capture string, t long, src string, dst string, label string, v double"


def _flows():
    random.seed(2)
    rows = []
    for capture, n in (("a", 90), ("b", 12), ("c", 11), ("d", 3), ("e", 40)):
        for t in range(n):
            host = lambda: random.choice([None, *[f"h{k}" for k in range(6)]])
            rows.append((capture, t, host(), host(), random.choice(["x", "y", None]), random.choice([None, 1.0, 2.5])))
    return rows


def test_equal_to_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "CHUNK", 16)
    rows = _flows()
    folder = str(tmp_path / "in")
    empty = spark.createDataFrame([], SCHEMA)
    jobs = {
        "means": lambda s: live.stream_window_means(s, "capture", ["t"], "label", ["v"], GEO),
        "edges": lambda s: live.stream_window_edges(s, "capture", ["t"], "src", "dst", GEO),
    }
    for low, high in ((0, 5), (5, 6), (6, 50), (50, 100)):  # four parts, each after a restart
        part = spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA)
        part.repartition(3).write.mode("append").parquet(folder)
        for name, job in jobs.items():
            stream = inc.read_parquet_stream(spark, folder, empty.schema)
            inc.run(inc.append_table, job(stream), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    means = spark.read.parquet(str(tmp_path / "means"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    for capture in "abcde":
        flows = spark.createDataFrame([r for r in rows if r[0] == capture], SCHEMA)
        ix = dense_index(flows, ["t"])
        mine = sorted(map(tuple, means.where(F.col("capture") == capture).drop("capture").collect()))
        if ix.n <= GEO.seq_len + GEO.graph_size:  # no flow has closed the first window yet
            assert mine == []
            continue
        want = w.window_means(ix, ["v"], GEO, label="label").select("window_id", "label", "v")
        assert mine == sorted(map(tuple, want.collect()))
        got = sorted(map(tuple, edges.where(F.col("capture") == capture).drop("capture").collect()))
        assert got == sorted(map(tuple, w.window_edges(ix, "src", "dst", (), GEO).drop("block").collect()))
