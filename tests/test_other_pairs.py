"""Missing and unlisted truths and predictions stay in every score."""

import json

import pytest

from flowloom.operators import evaluation as e

DATA = [("A", "A"), ("A", None), ("A", "Z"), ("B", "B"), ("B", "A"), ("new", "A"), (None, "B"), ("new", "Z")]


def test_pairs_outside_the_classes_count(spark):
    df = spark.createDataFrame(DATA, "t string, p string")
    matrix = e.confusion(df, "t", "p", ["A", "B"])
    assert {(r["true"], r["pred"]): r["count"] for r in matrix.collect()} == {
        ("A", "A"): 1, ("A", "B"): 0, ("B", "A"): 1, ("B", "B"): 1,
        ("A", None): 2, (None, "A"): 1, (None, "B"): 1, (None, None): 1,
    }
    scores = {r["class"]: r for r in e.per_class(matrix).collect()}
    assert (scores["A"]["support"], scores["A"]["recall"], scores["A"]["precision"]) == (3, pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert (scores["B"]["support"], scores["B"]["recall"], scores["B"]["precision"]) == (2, 0.5, 0.5)
    assert (scores[None]["support"], scores[None]["recall"]) == (3, 0.0)
    report = {r["row"]: r for r in e.classification_report(matrix).collect()}
    assert (report["accuracy"]["f1"], report["accuracy"]["support"]) == (0.25, 8)
    assert report["macro avg"]["recall"] == pytest.approx((1 / 3 + 1 / 2) / 2)
    assert report["weighted avg"]["recall"] == pytest.approx(0.25) and report["other"]["support"] == 3
    assert e.macro(e.per_class(matrix)).first()["recall_macro"] == pytest.approx((1 / 3 + 1 / 2) / 2)
    assert tuple(e.top_confusions(matrix, 1).first()) == ("A", None, 2)
    assert {r["class"]: (r["true_count"], r["pred_count"]) for r in e.class_distributions(matrix).collect()} == {"A": (3, 3), "B": (2, 2), None: (3, 3)}


def test_document_has_other(spark):
    df = spark.createDataFrame(DATA, "t string, p string")
    doc = json.loads(e.metrics_document(df, "t", "p", ["A", "B"]).first()["metrics"])
    assert doc["accuracy"] == 0.25 and sum(c["count"] for c in doc["confusion"]) == len(DATA)
    assert doc["per_class"]["other"]["support"] == 3 and doc["top_misclass_pairs"][0] == {"true": "A", "pred": None, "count": 2}
    named = json.loads(e.metrics_document(df.replace("B", "other"), "t", "p", ["A", "other"]).first()["metrics"])
    assert named["per_class"]["other"]["support"] == 2 and named["per_class"]["_other"]["support"] == 3
