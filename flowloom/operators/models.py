"""Nearest-prototype classification, few-shot episodes, window classifiers, model choice."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.fixed_values import K_SHOT, N_QUERY, N_WAY, SEED
from flowloom.functions.ordering import random_key
from flowloom.functions.vectors import argmax, euclidean, softmax
from flowloom.operators.lookup import index_label, label_index
from flowloom.scratch import stage


def class_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``(label, pos, mean)``: the class centroids, one row per class and position."""
    return (
        df.select(label, F.posexplode(vector).alias("pos", "v"))
        .groupBy(label, "pos")
        .agg(F.avg(F.col("v").cast("double")).alias("mean"))
    )


@dataclass(frozen=True)
class Prototypes:
    """Class centroids; as small as classes x positions, so they travel inside the plan."""

    classes: list
    centres: list[list[float]]

    @classmethod
    def fit(cls, support: DataFrame, vector: str, label: str, classes: Sequence) -> Prototypes:
        """Mean vector per class; a class without support gets the mean of all support rows."""
        classes = list(classes)
        means = class_means(support.filter(F.col(label).isin(classes)), vector, label)
        rows = means.groupBy(label).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("centre")
        ).collect()  # one row per class
        found = {r[label]: r["centre"] for r in rows}
        if any(c not in found for c in classes):
            overall = class_means(support.withColumn("_all", F.lit(0)), vector, "_all").orderBy("pos").collect()
            found = {c: found.get(c, [r["mean"] for r in overall]) for c in classes}
        return cls(classes, [found[c] for c in classes])

    def scores(self, vector: Column) -> Column:
        """Minus the euclidean distance to each centroid, in class order."""
        centres = F.from_json(F.lit(json.dumps(self.centres)), "array<array<double>>")
        return F.transform(centres, lambda centre: -euclidean(vector, centre))

    def predict(self, df: DataFrame, vector: str, out: str = "pred", scores: str = "scores") -> DataFrame:
        """Adds the scores and the class of the largest one."""
        labels = F.array(*[F.lit(c) for c in self.classes])
        return df.withColumn(scores, self.scores(F.col(vector))).withColumn(
            out, F.element_at(labels, argmax(F.col(scores)) + 1)
        )


def few_shot_episode(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    n_way: int = N_WAY,
    k_shot: int = K_SHOT,
    n_query: int = N_QUERY,
    seed: int = SEED,
) -> DataFrame:
    """Random support and query rows of ``n_way`` random classes, marked by ``role``.

    Spark trims each partition to the few rows wanted per class before the
    shuffle, so a large class costs no more than a small one.
    """
    ways = (
        df.select(label).dropna().distinct().orderBy(random_key(seed, F.lit("class"), label), label).limit(n_way)
    )
    order = Window.partitionBy(label).orderBy(random_key(seed, *key), *key)
    return (
        df.join(F.broadcast(ways), label, "left_semi")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k_shot + n_query)
        .withColumn("role", F.when(F.col("_rank") <= k_shot, "support").otherwise("query"))
        .drop("_rank")
    )


def add_prediction(df: DataFrame, scores: str, label2idx: Mapping[str, int]) -> DataFrame:
    """``pred_idx``, ``pred_label`` and softmax ``probs`` from raw class scores."""
    return (
        df.withColumn("pred_idx", argmax(F.col(scores)))
        .withColumn("probs", softmax(F.col(scores)))
        .withColumn("pred_label", index_label(F.col("pred_idx"), label2idx))
    )


def fit_window_classifier(
    windows: DataFrame,
    label2idx: Mapping[str, int],
    features: str = "features",
    label: str = "label",
    kind: str = "logistic",
    seed: int = SEED,
    **params,
) -> PipelineModel:
    """Spark ML classifier on fused window vectors; ``kind`` is logistic, perceptron or forest.

    Training passes over the data many times, so the vectors are written out first.
    """
    target = label_index(F.col(label), label2idx).cast("double").alias("_y")
    data = _vectors(stage(windows.select(features, target), "training-vectors"), features)
    common = {"featuresCol": "_scaled", "labelCol": "_y"}
    if kind == "logistic":
        learner = LogisticRegression(**common, **({"maxIter": 30, "regParam": 1e-4} | params))
    elif kind == "forest":
        learner = RandomForestClassifier(**common, seed=seed, **({"numTrees": 20, "maxDepth": 6} | params))
    elif kind == "perceptron":
        width = len(windows.select(features).first()[0])
        layers = params.pop("layers", [width, 128, len(label2idx)])
        learner = MultilayerPerceptronClassifier(**common, layers=layers, seed=seed, **({"maxIter": 30} | params))
    else:
        raise ValueError(kind)
    scaler = StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, learner]).fit(data)


def _vectors(windows: DataFrame, features: str) -> DataFrame:
    return windows.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))


def score_windows(
    windows: DataFrame, model: PipelineModel, label2idx: Mapping[str, int], features: str = "features"
) -> DataFrame:
    """Adds ``probs``, ``pred_idx`` and ``pred_label``."""
    scored = model.transform(_vectors(windows, features))
    return scored.select(
        *windows.columns,
        vector_to_array("probability").alias("probs"),
        F.col("prediction").cast("int").alias("pred_idx"),
        index_label(F.col("prediction").cast("int"), label2idx).alias("pred_label"),
    )


def fit_and_validate(
    windows: DataFrame, label2idx: Mapping[str, int], split: str = "split", features: str = "features", label: str = "label", **options
) -> tuple[PipelineModel, DataFrame]:
    """A classifier fitted on the ``train`` windows alone, and the scored ``val`` windows.

    The scaler belongs to the model, so its statistics come from training windows too.
    """
    marked = stage(windows, "split-windows")
    model = fit_window_classifier(marked.filter(F.col(split) == "train"), label2idx, features, label, **options)
    return model, score_windows(marked.filter(F.col(split) == "val"), model, label2idx, features)


def cross_validate(
    windows: DataFrame,
    label2idx: Mapping[str, int],
    grid: Mapping[str, Sequence],
    fold: str = "fold",
    features: str = "features",
    label: str = "label",
    metric: str = "accuracy",
    parallelism: int = 2,
) -> tuple[PipelineModel, DataFrame]:
    """The best logistic model over a grid of its parameters, refitted on all windows, and how it was found.

    Every fold (0, 1, ... in ``fold``) is predicted by models of the other folds. The second result has one row per combination:
    ``(combination, params, metric, chosen)``, the metric being the mean over folds; the first of the best is chosen.
    """
    target = label_index(F.col(label), label2idx).cast("double").alias("_y")
    data = stage(_vectors(windows.select(features, target, F.col(fold).cast("int").alias("_fold")), features), "folds")
    folds = data.agg(F.max("_fold")).first()[0] + 1
    learner = LogisticRegression(featuresCol="_scaled", labelCol="_y", maxIter=30, regParam=1e-4)
    pipeline = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True, withStd=True), learner])
    combinations = ParamGridBuilder()
    for name, values in grid.items():
        combinations = combinations.addGrid(learner.getParam(name), list(values))
    combinations = combinations.build()
    judge = MulticlassClassificationEvaluator(labelCol="_y", metricName=metric)
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=combinations, evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=parallelism
    )
    found = search.fit(data)
    best = max(range(len(combinations)), key=lambda k: (found.avgMetrics[k], -k))
    rows = [
        (k, json.dumps({p.name: v for p, v in params.items()}, sort_keys=True), float(found.avgMetrics[k]), k == best)
        for k, params in enumerate(combinations)
    ]
    history = windows.sparkSession.createDataFrame(rows, "combination int, params string, metric double, chosen boolean")
    return found.bestModel, history


def loss_history(spark, model: PipelineModel) -> DataFrame:
    """``(iteration, loss)`` of a logistic or perceptron model."""
    history = list(model.stages[-1].summary.objectiveHistory)
    return spark.createDataFrame(list(enumerate(map(float, history))), "iteration int, loss double")


def best_epoch(history: DataFrame, by: Sequence[str] = (), metric: str = "val_acc", epoch: str = "epoch") -> DataFrame:
    """The epoch with the best metric, the earliest one on ties."""
    earliest_best = F.max_by(F.struct(epoch, metric), F.struct(F.col(metric), -F.col(epoch)))
    return history.groupBy(*by).agg(earliest_best.alias("_b")).select(*by, "_b.*")
