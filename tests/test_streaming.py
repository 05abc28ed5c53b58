"""Streams give what the batch job gives, file by file."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowloom.operators.artifacts import Artifacts
from flowloom.streaming import incremental as inc

SCHEMA = StructType([StructField(c, StringType()) for c in ("Label", "a", "Timestamp")])


def write(folder, name, rows):
    (folder / name).write_text("Label,a,Timestamp\n" + "".join(",".join(r) + "\n" for r in rows))


def test_only_new_files_are_processed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, counts = str(tmp_path / "out"), str(tmp_path / "counts")
    write(src, "1.csv", [("BENIGN", "1", "x"), ("Bot ", "2", "x"), ("", "3", "x")])

    def run(checkpoint, target):
        inc.run(inc.materialize_attacks, inc.read_csv_stream(spark, str(src), SCHEMA), target, str(tmp_path / checkpoint))

    run("c1", out)
    assert [r["Label"] for r in spark.read.parquet(out).collect()] == ["Bot"]
    write(src, "2.csv", [("DDoS", "4", "x"), ("Benign", "5", "x")])
    run("c1", out)
    assert sorted((r["Label"], r["SourceFile"]) for r in spark.read.parquet(out).collect()) == [("Bot", "1.csv"), ("DDoS", "2.csv")]
    redo = str(tmp_path / "again")
    run("c2", redo)
    assert spark.read.parquet(redo).count() == 2

    stream = inc.read_csv_stream(spark, str(src), SCHEMA).filter("Label IS NOT NULL")
    inc.run(inc.running_label_counts, stream, counts, str(tmp_path / "c3"))
    write(src, "3.csv", [("DDoS", "6", "x")])
    inc.run(inc.running_label_counts, stream, counts, str(tmp_path / "c3"))
    got = {r["Label"].strip(): r["count"] for r in spark.read.parquet(counts).collect()}
    assert got == {"BENIGN": 1, "Bot": 1, "DDoS": 2, "Benign": 1}


def test_clean_chunks_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "1.csv", [("BENIGN", "1", "03/07/2017 08:55:58"), ("Bot", "inf", "bad")])
    write(src, "2.csv", [("DDoS", "7", "03/07/2017 08:55:59")])
    art = Artifacts(["a"], {"a": 3.0}, {"a": 1.0}, {"a": 2.0})
    out = str(tmp_path / "out")
    inc.run(inc.clean_and_append, inc.read_csv_stream(spark, str(src), SCHEMA), art, out, str(tmp_path / "c"))
    batch = spark.read.schema(SCHEMA).option("header", True).csv(str(src)).withColumn("SourceFile", F.col("_metadata.file_name"))
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, inc.clean_chunk(batch, art).collect()))


def test_repeats_within_the_horizon_go(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:05:00"), ("v", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t AS timestamp) AS t").write.parquet(str(tmp_path / "in"))
    stream = inc.read_parquet_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    inc.run(inc.deduplicate, stream, ["k"], "t", "1 hour", str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u", "v"]
