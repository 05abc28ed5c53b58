"""Training runs on disk: a fitted pipeline, its artifacts and a description, under one run id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators.artifacts import Artifacts
from flowloom.operators.risk import latest_runs, with_mode
from flowloom.operators.windows import Geometry

_META = (
    "run_id string, num_classes int, classes map<string,int>, features array<string>, seq_len int, graph_size int, stride int, "
    "max_nodes int, metric double"
)


@dataclass
class Run:
    """What scoring needs of a run."""

    run_id: str
    model: PipelineModel
    artifacts: Artifacts
    label2idx: dict[str, int]
    features: list[str]
    geometry: Geometry
    metric: float | None


def save_run(
    spark: SparkSession,
    root: str,
    run_id: str,
    model: PipelineModel,
    artifacts: Artifacts,
    label2idx: Mapping[str, int],
    features: Sequence[str],
    g: Geometry = Geometry(),
    metric: float | None = None,
) -> None:
    """Write a run; one of the same id is replaced. The description goes last, so a broken-off run is never listed."""
    if not run_id or set(run_id) & set("/\\*?[]{}"):
        raise ValueError(f"run id {run_id!r} is no folder name")
    path = f"{root}/{run_id}"
    meta = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    meta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(meta, True)
    model.write().overwrite().save(f"{path}/model")
    artifacts.save(spark, f"{path}/artifacts")
    row = {"run_id": run_id, "num_classes": len(label2idx), "classes": dict(label2idx), "features": list(features), "metric": metric}
    spark.createDataFrame([row | asdict(g)], _META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, num_classes, classes, features, ..., metric, mode)`` of every complete run."""
    return with_mode(spark.read.schema(_META).json(f"{root}/*/meta"))


def load_run(
    spark: SparkSession, root: str, run_id: str, features: Sequence[str] | None = None, classes: Sequence[str] | None = None
) -> Run:
    """Load a run; fails where it does not fit the table's ``features`` (their order counts) or the ``classes`` expected."""
    meta = spark.read.schema(_META).json(f"{root}/{run_id}/meta").first()
    if features is not None and list(features) != meta["features"]:
        raise ValueError(f"run {run_id} was trained on {meta['features']}, not on {list(features)}")
    if classes is not None and set(classes) != set(meta["classes"]):
        raise ValueError(f"run {run_id} knows the classes {sorted(meta['classes'])}, not {sorted(classes)}")
    return Run(
        run_id,
        PipelineModel.load(f"{root}/{run_id}/model"),
        Artifacts.load(spark, f"{root}/{run_id}/artifacts"),
        dict(meta["classes"]),
        list(meta["features"]),
        Geometry(meta["seq_len"], meta["graph_size"], meta["stride"], meta["max_nodes"]),
        meta["metric"],
    )


def load_latest(spark: SparkSession, root: str, mode: str, features: Sequence[str] | None = None, classes: Sequence[str] | None = None) -> Run:
    """The run of ``mode`` (``binary`` or ``multi``) with the largest id."""
    found = latest_runs(list_runs(spark, root)).filter(F.col("mode") == mode).first()
    if found is None:
        raise LookupError(f"no {mode} run in {root}")
    return load_run(spark, root, found["run_id"], features, classes)
