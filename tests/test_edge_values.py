"""Missing predictions, white space, odd file names, many classes, large counts."""

import pytest
from pyspark.sql import functions as F

from flowloom.functions.labels import binary_label
from flowloom.functions.values import is_filled
from flowloom.operators import evaluation, sampling
from flowloom.sources.readers import read_flow_csv


def test_missing_predictions_are_wrong(spark):
    df = spark.createDataFrame([("A", "A"), ("A", None), (None, "A")], "t string, p string")
    assert evaluation.accuracy(df, "t", "p").first()[0] == 0.5
    report = evaluation.unseen_class_report(df.where("t is not null"), "t", "p", benign="A", unseen="Z")
    assert report.first()["known_accuracy"] == 0.5


def test_white_space_of_any_kind_is_blank(spark):
    df = spark.createDataFrame([("BENIGN\t",), (" \t",), (None,)], "x string")
    got = [tuple(r) for r in df.select(is_filled(F.col("x")), binary_label("x")).collect()]
    assert got == [(True, "BENIGN"), (False, "ATTACK"), (False, None)]


@pytest.mark.parametrize("name", ["day#1 50%.csv", "a[1].csv", "b{2}%20.csv"])
def test_csv_file_names(spark, tmp_path, name):
    (tmp_path / name).write_text("a,b\n1,2\n")
    df, _ = read_flow_csv(spark, str(tmp_path))
    assert [r["a"] for r in df.select("a").collect()] == ["1"]


def test_every_class_is_sampled(spark):
    df = spark.range(600).select("id", F.concat(F.lit("c"), F.col("id") % 6).alias("label"))
    out = sampling.stratified_sample(df, 60, [f"c{k}" for k in range(6)], ["id"], "label")
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {f"c{k}": 10 for k in range(6)}


def test_auc_of_more_pairs_than_a_long_holds(spark, monkeypatch):
    counts = spark.createDataFrame([("A", 0.9, 5_000_000_000, 0), ("A", 0.1, 0, 5_000_000_000)], "class string, score double, pos long, neg long")
    monkeypatch.setattr(evaluation, "one_vs_rest", lambda *_: counts)
    assert evaluation.roc_auc(counts, "t", "s", ["A"]).first()["auc"] == 1.0
