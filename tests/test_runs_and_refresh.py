"""Stored runs, chosen parameters, counts of the writing job, tables that follow a folder."""

import random
import time

import pytest
from pyspark.sql import functions as F

from flowloom.operators import models, rows, sampling, windows as w
from flowloom.operators.artifacts import Artifacts
from flowloom.operators.lookup import label_index, label_map
from flowloom.sources import runs
from flowloom.streaming import incremental as inc, replace

CLASSES = label_map(["BENIGN", "DDoS", "Bot"])


@pytest.fixture(scope="module")
def vectors(spark):
    random.seed(4)
    data = []
    for k in range(400):
        c = random.choice(list(CLASSES))
        data.append((k, c, [CLASSES[c] + random.gauss(0, 0.7), random.gauss(0, 1)], k // 50 % 4))
    return spark.createDataFrame(data, "window_id long, label string, features array<double>, fold int").cache()


def test_latest_run_scores_like_the_fitted_model(spark, vectors, tmp_path):
    root = str(tmp_path)
    art = Artifacts(["a", "b"], {}, {"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0})
    old, new = (models.fit_window_classifier(vectors, CLASSES, maxIter=n) for n in (1, 20))
    runs.save_run(spark, root, "run-1", old, art, CLASSES, ["a", "b"], metric=0.5)
    runs.save_run(spark, root, "run-2", old, art, CLASSES, ["a", "b"])
    runs.save_run(spark, root, "run-2", new, art, CLASSES, ["a", "b"], w.Geometry(max_nodes=7), 0.75)  # replaces the other
    runs.save_run(spark, root, "run-3_binary", old, art, {"BENIGN": 0, "ATTACK": 1}, ["a"])
    (tmp_path / "run-9" / "model").mkdir(parents=True)  # broken off before its description
    assert sorted((r.run_id, r["mode"]) for r in runs.list_runs(spark, root).collect()) == [("run-1", "multi"), ("run-2", "multi"), ("run-3_binary", "binary")]
    run = runs.load_latest(spark, root, "multi", ["a", "b"], list(CLASSES))
    assert (run.run_id, run.metric, run.geometry, run.artifacts, run.label2idx) == ("run-2", 0.75, w.Geometry(max_nodes=7), art, dict(CLASSES))
    expected = models.score_windows(vectors, new, CLASSES).orderBy("window_id").collect()
    assert models.score_windows(vectors, run.model, run.label2idx).orderBy("window_id").collect() == expected
    with pytest.raises(ValueError, match="trained on"):
        runs.load_latest(spark, root, "multi", ["b", "a"])
    with pytest.raises(ValueError, match="classes"):
        runs.load_run(spark, root, "run-1", classes=["BENIGN"])
    with pytest.raises(LookupError):
        runs.load_latest(spark, root, "other")
    with pytest.raises(ValueError, match="folder name"):
        runs.save_run(spark, root, "a/b", old, art, CLASSES, ["a"])


def test_chosen_parameters_follow_from_the_folds(vectors):
    best, history = models.cross_validate(vectors, CLASSES, {"regParam": [1e-4, 50.0]})
    got = history.orderBy("combination").collect()
    assert [r.params for r in got] == ['{"regParam": 0.0001}', '{"regParam": 50.0}']
    assert [r.chosen for r in got] == [True, False] and got[0].metric > got[1].metric
    for r, strength in zip(got, (1e-4, 50.0)):
        each = []
        for k in range(4):
            model = models.fit_window_classifier(vectors.where(F.col("fold") != k), CLASSES, regParam=strength)
            scored = models.score_windows(vectors.where(F.col("fold") == k), model, CLASSES)
            each.append(scored.agg(F.avg((F.col("pred_idx") == label_index(F.col("label"), CLASSES)).cast("int"))).first()[0])
        assert r.metric == pytest.approx(sum(each) / 4, abs=1e-9)
    assert best.stages[-1].getRegParam() == 1e-4


@pytest.mark.parametrize("stride, block, folds", [(1, 30, 3), (4, 10, 2)])
def test_folds_share_no_flow(spark, stride, block, folds):
    g = w.Geometry(seq_len=4, graph_size=9, stride=stride)
    found = sampling.fold_by_blocks(spark.range(300).withColumnRenamed("id", "window_id"), g, block, folds).collect()
    flows = [set() for _ in range(folds)]
    for r in found:
        flows[r.fold] |= set(range(r.window_id * stride, r.window_id * stride + 9))
    assert all(flows) and sum(map(len, flows)) == len(set.union(*flows))


def test_counts_of_the_writing_job(spark, tmp_path):
    labels = ["BENIGN", "Bot", None, " benign ", "DDoS"] * 20
    df = spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "k int, Label string").repartition(3)
    attacks, seen = rows.observe_attacks(df)
    attacks.write.parquet(str(tmp_path / "batch"))
    kept = spark.read.parquet(str(tmp_path / "batch")).count()
    assert seen.get == {"scanned": 100, "kept": kept, "dropped": 100 - kept} and kept == 40
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = inc.append_table(rows.attacks_only(stream.observe("scan", *rows.attack_counts())), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert inc.observed_counts(query, "scan") == {"scanned": 100, "kept": 40, "dropped": 60}


def test_changed_files_replace_their_own_rows(spark, tmp_path):
    folder, table, seen = tmp_path / "in", str(tmp_path / "table"), []
    folder.mkdir()

    def read(session, paths):
        seen.append(sorted(p.rsplit("/", 1)[-1] for p in paths))
        return session.read.schema("k int, label string").option("header", True).csv(paths)

    def write(name, *lines):
        (folder / name).write_text("k,label\n" + "".join(f"{x}\n" for x in lines))

    def refresh():
        done = replace.refresh(spark, str(folder), table, read, lambda df: df.where("label <> 'BENIGN'"), "*.csv", digest=True)
        return done, sorted((r.SourceFile, r.k) for r in replace.read_rows(spark, table).collect())

    write("a b=1.csv", "1,Bot", "2,BENIGN")
    write("b.csv", "3,Bot", "4,DDoS")
    write("c.csv", "5,Bot")
    (folder / "note.txt").write_text("no data")
    done, got = refresh()
    assert got == [("a b=1.csv", 1), ("b.csv", 3), ("b.csv", 4), ("c.csv", 5)] and len(done.read) == 3
    done, again = refresh()
    assert again == got and (done.read, done.touched, done.removed) == ([], [], []) and len(seen) == 1
    time.sleep(1.1)
    write("a b=1.csv", "7,Bot", "8,Bot", "9,BENIGN")  # changed
    write("b.csv", "3,BENIGN")  # changed, no attack left
    write("c.csv", "5,Bot")  # written again, the same
    write("d.csv", "6,Bot")
    done, got = refresh()
    assert got == [("a b=1.csv", 7), ("a b=1.csv", 8), ("c.csv", 5), ("d.csv", 6)]
    assert seen[-1] == ["a b=1.csv", "b.csv", "d.csv"]
    assert done.touched == ["c.csv"] and done.removed == []
    (folder / "c.csv").unlink()
    done, got = refresh()
    assert got == [("a b=1.csv", 7), ("a b=1.csv", 8), ("d.csv", 6)] and done.removed == ["c.csv"] and done.read == []
