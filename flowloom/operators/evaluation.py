"""Evaluation of (true, predicted) pairs and of class scores.

A truth or prediction that is missing or not in the class list is ``other``, null in confusion tables. Such pairs are never
right; they count in the support, recall, precision, accuracy and weighted means. Macro means are over the listed classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.fixed_values import BENIGN, UNSEEN
from flowloom.functions.vectors import ratio
from flowloom.operators.ordering import running_totals

OTHER = "other"


def _array(classes: Sequence) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def confusion(
    df: DataFrame, true: str, pred: str, classes: Sequence, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, true, pred, count)`` for every pair of the given classes, zero cells kept, and for pairs with null (other) that occur.

    Rows collapse to their pair first; the grid of the class list is added to the few counts.
    """
    sides = [F.when(F.col(c).isin(list(classes)), F.col(c)).alias(name) for c, name in ((true, "true"), (pred, "pred"))]
    counts = df.groupBy(*by, *sides).agg(
        F.count(F.lit(1)).alias("n")
    )
    frame = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = (
        frame.select(*by, F.explode(_array(classes)).alias("true"))
        .select(*by, "true", F.explode(_array(classes)).alias("pred"))
        .withColumn("n", F.lit(0).cast("long"))
    )
    return (
        counts.unionByName(grid).groupBy(*by, "true", "pred").agg(F.sum("n").alias("count"))
    )


def _right(true: str, pred: str) -> Column:
    return F.coalesce((F.col(true) == F.col(pred)).cast("double"), F.lit(0.0))


def accuracy(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with a truth that are predicted right; a missing prediction is wrong."""
    return df.groupBy(*by).agg(F.avg(F.when(F.col(true).isNotNull(), _right(true, pred))).alias("accuracy"))


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, class, precision, recall, f1, support)`` from a confusion table; 0 for 0/0. Class null is other."""
    cell = F.col("count")
    sides = matrix.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("true").alias("class"), cell.alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("true") == F.col("pred"), cell).otherwise(0).alias("hit")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), cell.alias("predicted"),
                         F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(F.sum("hit").alias("tp"), F.sum("predicted").alias("p"), F.sum("support").alias("support"))
    return sums.select(
        *by,
        "class",
        ratio(F.col("tp"), F.col("p")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("p") + F.col("support")).alias("f1"),
        "support",
    )


def _listed_mean(name: str) -> Column:
    return F.avg(F.when(F.col("class").isNotNull(), F.col(name)))


def macro(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted means over all listed classes."""
    return scores.groupBy(*by).agg(*[_listed_mean(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")])


def classification_report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class rows, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = per_class(matrix, by)
    rows = scores.select(*by, F.coalesce(F.col("class").cast("string"), F.lit(OTHER)).alias("row"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    hit = ratio(F.sum(F.when(F.col("true") == F.col("pred"), F.col("count")).otherwise(0)), F.sum("count"))
    overall = matrix.groupBy(*by).agg(hit.alias("f1"), F.sum("count").alias("support")).select(
        *by, F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), "f1", "support",
    )
    metrics = ("precision", "recall", "f1")
    averages = scores.groupBy(*by).agg(
        F.struct(*[_listed_mean(m).alias(m) for m in metrics]).alias("a"),
        F.struct(*[ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in metrics]).alias("w"),
        total.alias("support"),
    )
    out = rows.unionByName(overall)
    for name, part in (("macro avg", "a"), ("weighted avg", "w")):
        out = out.unionByName(
            averages.select(*by, F.lit(name).alias("row"), *[F.col(f"{part}.{m}").alias(m) for m in metrics], "support")
        )
    return out


def normalized_confusion(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``share`` of the true class's row; an empty row divides by 1."""
    row = F.sum("count").over(Window.partitionBy(*by, "true"))
    return matrix.withColumn("share", F.col("count") / F.greatest(row, F.lit(1)))


def class_distributions(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, class, true_count, pred_count)``: row and column sums of a confusion table."""
    sides = F.array(
        F.struct(F.col("true").alias("class"), F.col("count").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("count").alias("p")),
    )
    return (
        matrix.select(*by, F.explode(sides).alias("s"))
        .select(*by, "s.*")
        .groupBy(*by, "class")
        .agg(F.sum("t").alias("true_count"), F.sum("p").alias("pred_count"))
    )


def top_confusions(matrix: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent wrong pairs."""
    wrong = matrix.filter(~F.col("true").eqNullSafe(F.col("pred")) & (F.col("count") > 0))
    return wrong.orderBy(F.desc("count"), "true", "pred").limit(k)


def one_vs_rest(df: DataFrame, true: str, scores: str, classes: Sequence) -> DataFrame:
    """``(class, score, pos, neg)`` counts per distinct score of each class.

    The outer explode keeps Spark from deriving a filter that would compute the scores twice.
    """
    entries = F.arrays_zip(_array(classes).alias("class"), F.col(scores).alias("score"))
    long = df.select(F.col(true).alias("_t"), F.explode_outer(entries).alias("_e")).select(
        "_t", F.col("_e.class").alias("class"), F.col("_e.score").alias("score")
    )
    hit = F.col("_t") == F.col("class")
    return long.groupBy("class", "score").agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )


def roc_curve(df: DataFrame, true: str, scores: str, classes: Sequence, drop_intermediate: bool = True) -> DataFrame:
    """``(class, threshold, fpr, tpr)`` by falling threshold, from the origin (null threshold).

    ``drop_intermediate`` leaves out thresholds on a straight line between
    their neighbours. Counts per score come first; their running sums are
    taken over range partitions, so no class is sorted in one task.
    """
    counts = one_vs_rest(df, true, scores, classes)
    order = [F.col("score").desc()]
    sums = running_totals(counts, order, {"pos": "tp", "neg": "fp"}, restart_by="class", name="roc")
    # The last running sums of a class are its totals: one row per class of the list.
    totals = sums.groupBy("class").agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    if drop_intermediate:
        sums = _with_next_step(sums)
        bend = (F.col("next_pos").isNull() | (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
                | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
        sums = sums.filter(bend)
    points = sums.join(F.broadcast(totals), "class").select(
        "class",
        F.col("score").cast("double").alias("threshold"),
        (F.col("fp") / F.nullif(F.col("N"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("P"), F.lit(0))).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.explode(_array(classes)).alias("class"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(points)


def _with_next_step(sums: DataFrame) -> DataFrame:
    """Adds the counts at the next lower score of the class.

    Row ``k`` of a class ends at ``(tp, fp)`` and the next row starts there:
    an equi-join of end to start, unique because every score adds a row.
    """
    end = F.col("tp") + F.col("fp")
    start = end - F.col("pos") - F.col("neg")
    following = sums.select(
        "class", start.alias("_at"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg")
    )
    return sums.withColumn("_at", end).join(following, ["class", "_at"], "left").drop("_at")


def roc_auc(df: DataFrame, true: str, scores: str, classes: Sequence) -> DataFrame:
    """``(class, auc)``; ties count half; null for a class without positives or negatives."""
    counts = one_vs_rest(df, true, scores, classes)
    below = running_totals(counts, ["score"], {"neg": "neg_upto"}, restart_by="class", name="auc")
    won = F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") / 2)
    return below.groupBy("class").agg(
        (F.sum(won) / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0))).alias("auc")
    )


def macro_auc(aucs: DataFrame) -> DataFrame:
    """Mean over the classes; null as soon as one class has none."""
    return aucs.agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("roc_auc_macro"))


def unseen_class_report(
    df: DataFrame, true: str, pred: str, benign: str = BENIGN, unseen: str = UNSEEN, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy on known classes, share of unseen-class rows flagged as attack, and the sample counts."""
    new = F.col(true) == unseen
    flagged = F.col(pred) != benign
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col(true) == benign).alias("n_benign"),
        F.count_if(~new & (F.col(true) != benign)).alias("n_known_attack"),
        F.count_if(new).alias("n_zero_day"),
        F.count_if(new & flagged).alias("zero_day_detected"),
        ratio(F.count_if(new & flagged), F.count_if(new)).alias("zero_day_detection_rate"),
        F.avg(F.when(~new, _right(true, pred))).alias("known_accuracy"),
    )


def metrics_document(df: DataFrame, true: str, pred: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """One JSON text per group: accuracy, macro scores, per-class map, confusion, distributions, top pairs."""
    matrix = confusion(df, true, pred, classes, by)
    scores = per_class(matrix, by)
    dists = class_distributions(matrix, by)
    other = OTHER
    while other in map(str, classes):
        other = f"_{other}"
    text = F.coalesce(F.col("class").cast("string"), F.lit(other))
    keys = list(by)

    def grouped(source: DataFrame, *aggs: Column) -> DataFrame:
        return source.groupBy(*keys).agg(*aggs)

    pairs = F.array_sort(
        F.filter(
            F.collect_list(F.when(~F.col("true").eqNullSafe(F.col("pred")) & (F.col("count") > 0),
                                  F.struct((-F.col("count")).alias("k"), "true", "pred", "count"))),
            lambda x: x.isNotNull(),
        )
    )
    parts = [
        grouped(matrix,
                F.count(F.lit(1)).alias("_cells"),
                ratio(F.sum(F.when(F.col("true") == F.col("pred"), F.col("count")).otherwise(0)), F.sum("count")).alias("accuracy"),
                F.array_sort(F.collect_list(F.struct("true", "pred", "count"))).alias("confusion"),
                F.transform(F.slice(pairs, 1, 5), lambda x: F.struct(x["true"].alias("true"), x["pred"].alias("pred"), x["count"].alias("count"))).alias("top_misclass_pairs")),
        macro(scores, by),
        grouped(scores, F.map_from_entries(F.array_sort(F.collect_list(F.struct(text, F.struct("precision", "recall", "f1", "support"))))).alias("per_class")),
        grouped(dists,
                F.map_from_entries(F.array_sort(F.collect_list(F.struct(text, "true_count")))).alias("class_dist_true"),
                F.map_from_entries(F.array_sort(F.collect_list(F.struct(text, "pred_count")))).alias("class_dist_pred")),
    ]
    # Every part has one row per group.
    out = parts[0]
    for part in parts[1:]:
        if keys:
            out = out.join(part, keys)
        else:
            out = out.withColumns({c: part.select(c).scalar() for c in part.columns})
    fields = [c for c in out.columns if c not in keys and c != "_cells"]
    return out.select(*by, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("metrics"))
