"""Blocked splits of overlapping windows, held-out evaluation, sums of column pairs, the bucketed store."""

import random

import numpy as np
import pytest

from flowloom.operators import evaluation, features, gram, models, sampling, windows as w
from flowloom.operators.lookup import label_index, label_map
from flowloom.operators.ordering import dense_index
from flowloom.sources import window_store
from pyspark.sql import functions as F


@pytest.mark.parametrize("stride, block, every", [(1, 40, 2), (1, 55, 3), (3, 20, 4), (8, 10, 5)])
def test_no_flow_on_both_sides(spark, stride, block, every):
    g = w.Geometry(seq_len=4, graph_size=9, stride=stride)
    ids = spark.range(400).withColumnRenamed("id", "window_id")
    rows = sampling.split_by_blocks(ids, g, block, every).collect()
    flows = {"train": set(), "val": set()}
    for r in rows:
        flows[r.split] |= set(range(r.window_id * stride, r.window_id * stride + 9))
    assert flows["val"] and flows["train"] and not flows["val"] & flows["train"]
    assert sum(r.split == "val" for r in rows) == sum(k // block % every == every - 1 for k in range(400))
    gone = sorted(set(range(400)) - {r.window_id for r in rows})
    bounds = [k * block for k in range(1, 400 // block + 1) if (k % every == every - 1) or (k % every == 0)]
    assert all(min(abs(x - b) for b in bounds) * stride <= 13 for x in gone)


def test_blocks_must_outlast_the_embargo(spark):
    with pytest.raises(ValueError, match="embargo"):
        sampling.split_by_blocks(spark.range(5).withColumnRenamed("id", "window_id"), w.Geometry(), 100)


def test_held_out_report(spark):
    random.seed(1)
    rows = []
    for k in range(600):
        c = random.choice("abc")
        centre = {"a": (0, 0), "b": (3, 0), "c": (0, 3)}[c]
        rows.append((k, c, [random.gauss(x, 1.0) for x in centre], "val" if k // 60 % 5 == 4 else "train"))
    rows += [(700, "a", [50.0, 50.0], "neither")]
    df = spark.createDataFrame(rows, "window_id long, label string, features array<double>, split string")
    classes = label_map(["a", "b", "c"])
    model, scored = models.fit_and_validate(df, classes, maxIter=20)
    got = scored.collect()
    assert sorted(r.window_id for r in got) == [r[0] for r in rows if r[3] == "val"]
    means = np.mean([r[2] for r in rows if r[3] == "train"], axis=0)
    assert np.allclose(model.stages[0].mean.toArray(), means)  # nothing of the other rows in the scaler
    pairs = scored.withColumn("true_idx", label_index(F.col("label"), classes))
    report = {r[0]: r for r in evaluation.classification_report(evaluation.confusion(pairs, "true_idx", "pred_idx", [0, 1, 2])).collect()}
    true = [classes[r.label] for r in got]
    pred = [r.pred_idx for r in got]
    assert sum(t == p for t, p in zip(true, pred)) > 0.85 * len(true)
    for k in range(3):
        hit = sum(t == p == k for t, p in zip(true, pred))
        row = next(r for name, r in report.items() if str(name) == str(k)).asDict()
        assert row["support"] == true.count(k)
        assert row["precision"] == pytest.approx(hit / pred.count(k)) and row["recall"] == pytest.approx(hit / true.count(k))


def test_eighty_columns_in_one_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 2.0, (500, 80))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.01, 500)
    x[:, 2] = 7.0
    gone = rng.random((500, 80)) < 0.1
    gone[:, 5] = True
    rows = [tuple(None if gone[r, k] else float(x[r, k]) for k in range(80)) for r in range(500)]
    names = [f"c {k}" for k in range(80)]
    spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    pairs = features.correlation_pairs(df, names)
    got = {(r.a, r.b): r["corr"] for r in pairs.collect()}
    assert len(got) == 80 * 79 // 2
    for (a, b), value in got.items():
        i, j = names.index(a), names.index(b)
        both = ~gone[:, i] & ~gone[:, j]
        if 2 in (i, j) or 5 in (i, j):
            assert value is None
        else:
            assert value == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1


def test_pairs_of_an_empty_table_and_of_constants(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert gram.pair_sums(empty, ["a", "b"]).count() == 0
    assert [tuple(r) for r in features.correlation_pairs(empty, ["a", "b"]).collect()] == [("a", "b", None)]
    some = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.3, None)], "a double, b double")  # a is constant where b is present
    assert features.correlation_pairs(some, ["a", "b"]).first()["corr"] is None


def test_store_is_joined_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(k, f"h{k % 5}", f"h{k % 3}", "DDoS" if k % 2 else "BENIGN", float(k)) for k in range(30_000)]
    ix = dense_index(spark.createDataFrame(rows, "t int, s string, d string, l string, f double"), ["t"])
    geo = w.Geometry(seq_len=8, graph_size=16, stride=16)
    window_store.write_window_store(ix, ["f"], "l", {"BENIGN": 0, "DDoS": 1}, "s", "d", path, geo)
    for again in (False, True):
        if again:  # as another session would: the tables are declared anew over the folder
            for part in ("windows", "window_edges"):
                spark.sql(f"DROP TABLE {window_store._table_name(path, part)}")
        windows, edges, meta = window_store.read_window_store(spark, path)
        assert meta["buckets"] > 1
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            joined = windows.join(edges, ["block", "window_id"])
            counted = joined.groupBy("block", "window_id").count()
            assert counted.where("count = 16").count() == meta["num_items"]
            plan = counted._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
