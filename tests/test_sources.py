"""Messy CSV files, fallbacks, sinks and the window store."""

import pytest

from flowloom.operators.ordering import dense_index
from flowloom.plans.flows import build_training_table
from flowloom.sources import readers, window_store, writers
from flowloom.operators.artifacts import Artifacts


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a_pad.csv").write_text(
        " Label,Flow  ID ,Fwd Header Length,Fwd Header Length\n" + "".join(f"BENIGN,f{k},{k},{k * 2}\n" for k in range(5))
    )
    (tmp_path / "b_latin.csv").write_bytes(b"Label,Flow ID\nWeb Attack \x96 XSS,g1\nBot\xa0,g2\n")
    (tmp_path / "c_bad.csv").write_text('Label,Flow ID\nBot,h1\nBot,h2,extra\n"Bot, big",h3\nBot\n')
    (tmp_path / ".~lock.a_pad.csv").write_text("junk")
    (tmp_path / "notes.txt").write_text("junk")
    return str(tmp_path)


def test_mixed_files(spark, folder):
    df, repeats = readers.read_flow_csv(spark, folder, with_position=True)
    assert repeats == ["Fwd Header Length#1"]
    got = {(r["SourceFile"], r["Flow ID"]): r for r in df.collect()}
    assert len(got) == 10
    assert got["a_pad.csv", "f3"]["Fwd Header Length"] == "3" and got["a_pad.csv", "f3"]["Fwd Header Length#1"] == "6"
    assert got["b_latin.csv", "g1"]["Label"] == "Web Attack \x96 XSS" and got["b_latin.csv", "g2"]["Label"] == "Bot\xa0"
    assert got["c_bad.csv", "h3"]["Label"] == "Bot, big" and ("c_bad.csv", "h2") not in got
    assert got["c_bad.csv", None]["Label"] == "Bot"
    order = df.filter("SourceFile = 'a_pad.csv'").orderBy(*readers.POSITION).collect()
    assert [r["Flow ID"] for r in order] == [f"f{k}" for k in range(5)]


def test_bad_rows_can_be_kept_and_columns_pruned(spark, folder):
    df, _ = readers.read_flow_csv(spark, folder, "c_*.csv", ["Label", "Absent"], bad_rows="keep")
    assert df.columns == ["Label", readers.CORRUPT, "SourceFile"]
    bad = [r[readers.CORRUPT] for r in df.collect() if r[readers.CORRUPT]]
    assert sorted(bad) == ["Bot", "Bot,h2,extra"]
    pruned, _ = readers.read_flow_csv(spark, folder, "c_*.csv", ["Flow ID"])
    assert pruned.count() == 3
    assert sorted(r[0] or "" for r in pruned.select("Flow ID").collect()) == ["", "h1", "h3"]


def test_no_files(spark, folder):
    with pytest.raises(Exception):
        readers.read_flow_csv(spark, folder, "x_*.csv")


def test_read_table(spark, tmp_path):
    base = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "a int, b string").write.option("header", True).csv(f"{base}.csv")
    df, missing = readers.read_table(spark, base, ["b", "c"])
    assert ([r["b"] for r in df.collect()], missing) == (["x"], ["c"])
    writers.write_table(spark.createDataFrame([(2, "y")], "a int, b string"), base, with_csv=True)
    df, missing = readers.read_table(spark, base, ["a", "c"])
    assert (df.collect()[0]["a"], df.columns, missing) == (2, ["a"], ["c"])
    assert spark.read.option("header", True).csv(f"{base}.csv").first()["b"] == "y"


def test_window_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(k, f"h{k % 5}", f"h{k % 3}", "DDoS" if k % 2 else "BENIGN", float(k)) for k in range(130)]
    ix = dense_index(spark.createDataFrame(rows, "t int, s string, d string, l string, f double"), ["t"])
    args = (ix, ["f"], "l", {"BENIGN": 0, "DDoS": 1}, "s", "d", path)
    assert window_store.write_window_store(*args)
    assert not window_store.write_window_store(*args)
    assert window_store.write_window_store(*args, force=True)
    windows, edges, meta = window_store.read_window_store(spark, path)
    assert meta["num_items"] == windows.count() == 34 and meta["feat_cols"] == ["f"]
    assert edges.count() == 34 * 64
    first = windows.filter("window_id = 0").first()
    assert (first["y"], [x[0] for x in first["seq"]]) == (0, [float(k) for k in range(32)])
    edges.filter("edge_pos <> 3").write.mode("overwrite").parquet(f"{path}-broken/window_edges")
    windows.write.parquet(f"{path}-broken/windows")
    found = window_store.store_integrity(spark.read.parquet(f"{path}-broken/windows"),
                                         spark.read.parquet(f"{path}-broken/window_edges"), 34).first()
    assert found["edge_gaps"] == 34


def test_artifacts_round_trip(spark, tmp_path):
    art = Artifacts(["b", "a"], {"a": 1.0, "b": 2.0, "z": 0.0}, {"a": 0.5, "b": 0.25}, {"a": 1.0, "b": 3.0}, {"z": "constant"})
    art.save(spark, str(tmp_path / "art"))
    assert Artifacts.load(spark, str(tmp_path / "art")) == art


def test_training_table_from_files(spark, tmp_path):
    header = "Flow ID, Src IP,Dst IP,Timestamp,Flow Byts/s,Flow Pkts/s,Tot,Konst,Label\n"
    lines = [
        f"f{k},1.1.1.{k % 7},2.2.2.{k % 5},{1 + k % 28:02d}/07/2017 10:00:00,{'Infinity' if k == 3 else k},{k * k},{2 * k + 1},1,"
        f"{['BENIGN', 'DDoS', 'Bot', 'Odd'][k % 4]}\n"
        for k in range(60)
    ]
    (tmp_path / "day.csv").write_text(header + "".join(lines) + lines[5] + "f99,,2.2.2.2,03/07/2017 10:00:00,1,1,1,1,DDoS\n"
                                      + "f98,1.1.1.1,2.2.2.2,bad,1,1,1,1,DDoS\n")
    raw, repeats = readers.read_flow_csv(spark, str(tmp_path))
    built = build_training_table(raw, repeats)
    counts = {(r["section"], r["item"]): r["value"] for r in built.report.collect()}
    assert counts["row cleaning", "rows_before"] == 63
    assert counts["row cleaning", "missing_source_ip_rows_removed"] == 1
    assert counts["row cleaning", "missing_timestamp_rows_removed"] == 1
    assert counts["low-support classes", "Bot"] == counts["other classes", "Odd"] == 15
    assert "Konst" in built.artifacts.dropped and "Flow ID" in built.artifacts.dropped
    # The spread of the pair decides: the narrower of two perfectly correlated columns goes.
    assert "Flow Bytes/s" not in built.artifacts.features or "Tot" not in built.artifacts.features
    got = built.df.collect()
    assert len(got) == 30 and {r["Label"] for r in got} == {"BENIGN", "DDoS"}
    f = built.artifacts.features[0]
    values = [r[f] for r in got]
    assert abs(sum(values)) < 1e-9 and abs(sum(v * v for v in values) / len(values) - 1) < 1e-9
    binary = build_training_table(raw, repeats, binary=True)
    assert {r["Label"] for r in binary.df.select("Label").distinct().collect()} == {"BENIGN", "ATTACK"}
    assert binary.df.count() == 60 and "LabelOriginal" in binary.df.columns
