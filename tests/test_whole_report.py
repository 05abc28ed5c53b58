"""The cross-dataset report is over the whole table."""

from flowloom.plans.registered import models

SF = "/root/testdata/sf0.001"


def test_no_benign_row_is_left_out(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(models, "_trained", lambda spark, sf: (None, None, None))
    monkeypatch.setattr(models.jobs, "evaluate_across", lambda raw, *args, **named: seen.update(named, raw=raw))
    models.cross_dataset_report(spark, SF)
    assert seen.get("benign_rows") is None and seen.get("max_windows") is None
    assert seen["raw"].count() == spark.read.parquet(f"{SF}/events.parquet").count()
