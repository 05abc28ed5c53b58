"""Exact quotas, draws, redundant features and evaluation identities."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowloom.operators import evaluation, features, lookup, models, risk, sampling


def test_take_first_with_a_hot_bucket(spark):
    """All rows of a class in one bucket, and quotas that end exactly on a bucket border."""
    df = spark.range(900).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g")
    hot = sampling.take_first(df, "g", {"b": 100}, [F.lit("x")], F.struct("id"))
    kept = {r["g"]: r["n"] for r in hot.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert kept == {"a": 300, "b": 100}
    assert hot.filter("g = 'b'").agg(F.max("id")).first()[0] == 149
    border = sampling.take_first(df, "g", {"a": 50}, [F.floor(F.col("id") / 150)], F.struct("id"))
    assert border.filter("g = 'a'").count() == 50
    two = sampling.take_first(df, "g", {"a": 77, "b": 5000}, [F.floor(F.col("id") / 300), F.floor(F.col("id") / 30)], F.struct("id"))
    assert two.filter("g = 'a'").agg(F.max("id")).first()[0] == 76 * 3 and two.filter("g = 'b'").count() == 600


def test_sample_is_repeatable_and_exact(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    a, b = (sampling.sample_rows(df.repartition(n), 321, ["id"]) for n in (2, 7))
    assert a.count() == 321 and sorted(a.collect()) == sorted(b.collect())
    assert sampling.sample_rows(df, 9000, ["id"]).count() == 5000
    assert sampling.sample_rows(df, 0, ["id"]).count() == 0


def test_first_of_each_reports_shortage(spark):
    df = spark.createDataFrame([("f", k, "BENIGN" if k < 3 else "Bot") for k in range(10)], "SourceFile string, row_index int, Label string")
    assert sampling.first_of_each(df, 2, 4).count() == 6
    with pytest.raises(ValueError, match="3/5"):
        sampling.first_of_each(df, 5, 4)


def test_draws(spark):
    df = spark.createDataFrame([(k, "BENIGN" if k % 2 else "DDoS", float(k), 1.0) for k in range(300)], "k int, Label string, a double, b double")
    drawn = sampling.draw_with_replacement(df, 1000, ["k"])
    assert drawn.count() == 1000 and drawn.select("k").distinct().count() > 250


def test_time_split_leaves_a_gap(spark):
    got = sampling.split_by_time(spark.range(100).withColumnRenamed("id", "window_id"), 100, 10).collect()
    train = [r["window_id"] for r in got if r["split"] == "train"]
    val = [r["window_id"] for r in got if r["split"] == "val"]
    assert (max(train), min(val), len(train) + len(val)) == (69, 80, 90)


def test_redundant_rule_keeps_comparing_a_dropped_column():
    corr = {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 0.0}
    stds = {"a": 2.0, "b": 3.0, "c": 1.0}
    assert set(features.redundant_features(["a", "b", "c"], corr, stds)) == {"a", "c"}
    assert features.redundant_features(["a", "b"], {("a", "b"): math.nan}, stds) == {}


def test_correlation_of_constant_and_masked(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 5.0, 1.0), (4.0, 1.0, 1.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in features.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got["a", "c"] is None and got["b", "c"] is None
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 1])[0, 1])


pairs = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None)
@given(pairs)
def test_metric_identities(spark, data):
    df = spark.createDataFrame(data, "t int, p int")
    matrix = evaluation.confusion(df, "t", "p", [0, 1, 2])
    assert matrix.agg(F.sum("count")).first()[0] == len(data) and matrix.count() == 9
    for r in evaluation.per_class(matrix).collect():
        c = r["class"]
        tp = sum(t == p == c for t, p in data)
        n, m = sum(t == c for t, _ in data), sum(p == c for _, p in data)
        assert r["support"] == n
        assert r["precision"] == pytest.approx(tp / m if m else 0.0)
        assert r["recall"] == pytest.approx(tp / n if n else 0.0)
        assert r["f1"] == pytest.approx(2 * tp / (n + m) if n + m else 0.0)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 6)), min_size=2, max_size=30))
def test_auc_and_curve(spark, data):
    df = spark.createDataFrame([(int(t), [float(s)]) for t, s in data], "t int, s array<double>")
    auc = evaluation.roc_auc(df, "t", "s", [1]).first()["auc"]
    pos = [s for t, s in data if t]
    neg = [s for t, s in data if not t]
    if not pos or not neg:
        assert auc is None
        return
    assert auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    points = sorted((r["fpr"], r["tpr"]) for r in evaluation.roc_curve(df, "t", "s", [1]).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(points, points[1:]))
    assert area == pytest.approx(auc)


def test_prototypes_fall_back_to_the_overall_mean(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [2.0, 0.0]), (1, [10.0, 4.0])], "y int, v array<double>")
    p = models.Prototypes.fit(df, "v", "y", [0, 1, 2])
    assert p.centres == [[1.0, 0.0], [10.0, 4.0], [4.0, pytest.approx(4 / 3)]]
    assert [r["pred"] for r in p.predict(df, "v").orderBy("v").collect()] == [0, 0, 1]


def test_prediction_columns(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    r = models.add_prediction(df, "s", {"a": 0, "b": 1}).first()
    assert (r["pred_idx"], r["pred_label"]) == (1, "b") and sum(r["probs"]) == pytest.approx(1)
    assert models.add_prediction(df, "s", {"a": 0}).first()["pred_label"] == "UNK"


def test_empty_risk_summary(spark):
    r = risk.risk_summary(spark.createDataFrame([], "pred_label string")).first()
    assert (r["total_windows"], r["risk_score"], r["risk_level"], r["most_common"], r["top_attack"]) == (0, 0.0, "safe", "Unknown", "None")


def test_large_lookup_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 3)
    df, small = spark.range(10), spark.range(5).withColumn("x", F.lit(1))
    assert lookup.join_counted(df, small, 5, "id").filter("x = 1").count() == 5


@pytest.mark.parametrize("kind, params", [("logistic", {}), ("forest", {"numTrees": 3}), ("perceptron", {"layers": [2, 4, 2]})])
def test_window_classifiers(spark, kind, params):
    data = spark.createDataFrame([(k, [float(k % 2), float(k % 5)], "DDoS" if k % 2 else "BENIGN") for k in range(60)],
                                 "window_id long, features array<double>, label string")
    labels = {"BENIGN": 0, "DDoS": 1}
    model = models.fit_window_classifier(data, labels, kind=kind, **params)
    scored = models.score_windows(data, model, labels)
    assert scored.filter("label = pred_label").count() >= 55
    if kind == "logistic":
        assert models.loss_history(spark, model).count() > 1
