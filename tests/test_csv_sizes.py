"""CSV files stay bounded as the table grows."""

from flowloom.plans.registered import tables


def test_more_rows_more_files(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_FILE", 500)
    df = tables.csv_files(spark, "/root/testdata/sf0.001")
    assert len(df.inputFiles()) >= 12  # 6,000 rows; once always four
    assert df.count() == 6000
