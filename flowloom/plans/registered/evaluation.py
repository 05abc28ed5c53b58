"""Confusion, per-class metrics, ROC, unseen-class and split comparisons."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import evaluation as e
from flowloom.operators.lookup import compare_on
from flowloom.operators.sampling import split
from flowloom.plans.registered.models import MEANS_CTE, scored_embeddings
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, flows, table

CLASSES = ["BENIGN", "Bot", "DDoS", "DoS Hulk", "Heartbleed", "PortScan"]
_PRED = "CASE WHEN f_qty > 40 THEN 'DDoS' WHEN f_qty > 25 THEN label ELSE 'BENIGN' END"
_VALUES = ", ".join(f"('{c}')" for c in CLASSES)


def _sql(by: str = "") -> str:
    """Pairs, confusion table and per-class scores, per ``by`` column if given."""
    b = f"{by}, " if by else ""
    frame = f"(SELECT DISTINCT {by} FROM pairs) g, cls a, cls z" if by else "cls a, cls z"
    match = f"q.{by} = g.{by} AND " if by else ""
    gb = f"g.{by} AS {by}, " if by else ""
    same = f"x.{by} = y.{by} AND " if by else ""
    xb = f"x.{by}, " if by else ""
    return (
        f"WITH {FLOWS_CTE}, pairs AS (SELECT row_key, label AS t, {_PRED} AS p, "
        "CASE WHEN cast('0x' || substr(md5('42|' || row_key), 1, 7) AS bigint) % 10000 < 8000 THEN 'train' ELSE 'val' END AS split "
        f"FROM flows), cls(c) AS (VALUES {_VALUES}), "
        f"q AS (SELECT {b}t, p, count(*) AS n FROM pairs GROUP BY ALL), "
        f"grid AS (SELECT {gb}a.c AS t, z.c AS p FROM {frame}), "
        f"cm AS (SELECT {'grid.' + by + ', ' if by else ''}grid.t, grid.p, coalesce(n, 0) AS n FROM grid LEFT JOIN q "
        f"ON {'q.' + by + ' = grid.' + by + ' AND ' if by else ''}q.t = grid.t AND q.p = grid.p), "
        f"rs AS (SELECT {b}t AS c, sum(n) AS support, sum(n) FILTER (t = p) AS tp FROM cm GROUP BY ALL), "
        f"cs AS (SELECT {b}p AS c, sum(n) AS predicted FROM cm GROUP BY ALL), "
        f"pc AS (SELECT {xb}x.c AS class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, "
        "CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, "
        "CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1, "
        f"cast(support AS bigint) AS support FROM rs x JOIN cs y ON {same}x.c = y.c)"
    )


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return split(flows(spark, sf).selectExpr("row_key", "label", "f_qty", f"{_PRED} AS pred"), ["row_key"])


def _matrix(spark: SparkSession, sf: str, by=()) -> DataFrame:
    return e.confusion(_pairs(spark, sf), "label", "pred", CLASSES, by)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(_sql() + ' SELECT t AS "true", p AS pred, n AS count FROM cm')
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf)


@query(
    'WITH g AS (SELECT a.v AS "true", z.v AS pred FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) z(v)) '
    'SELECT "true", pred, count(doc_id) AS count FROM g LEFT JOIN labels ON quality = "true" AND toxic = pred GROUP BY ALL'
)
def binary_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return e.confusion(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query(_sql() + " SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pairs")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(e.accuracy(_pairs(spark, sf), "label", "pred"), "accuracy")


@query(_sql() + " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc")
def per_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(e.per_class(_matrix(spark, sf)), "precision", "recall", "f1")


@query(
    _sql() + " SELECT round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, "
    "round(avg(f1), 6) AS f1_macro FROM pc"
)
def macro_averages(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(e.macro(e.per_class(_matrix(spark, sf))), "precision_macro", "recall_macro", "f1_macro")


@query(
    _sql() + ", tot AS (SELECT cast(sum(n) AS bigint) AS s, sum(n) FILTER (t = p) / sum(n) AS acc FROM cm) "
    'SELECT class AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc '
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), s FROM tot "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) AS bigint) FROM pc "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
    "round(sum(f1 * support) / sum(support), 6), cast(sum(support) AS bigint) FROM pc"
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(e.classification_report(_matrix(spark, sf)), "precision", "recall", "f1")


@query(
    _sql() + ' SELECT t AS "true", p AS pred, n AS count, round(n / greatest(sum(n) OVER (PARTITION BY t), 1), 6) AS share FROM cm'
)
def normalized_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(e.normalized_confusion(_matrix(spark, sf)), "share")


@query(_sql() + " SELECT x.c AS class, cast(support AS bigint) AS true_count, cast(predicted AS bigint) AS pred_count FROM rs x JOIN cs y ON x.c = y.c")
def class_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return e.class_distributions(_matrix(spark, sf))


@query(_sql() + ' SELECT t AS "true", p AS pred, n AS count FROM cm WHERE t <> p AND n > 0 ORDER BY n DESC, t, p LIMIT 5')
def top_confusions(spark: SparkSession, sf: str) -> DataFrame:
    return e.top_confusions(_matrix(spark, sf))


_SCORED_CTE = (
    f"WITH {MEANS_CTE}, s AS (SELECT label = cls AS hit, cls AS class, round(score, 6) AS score FROM d), "
    "k AS (SELECT class, score, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM s GROUP BY class, score), "
    "tot AS (SELECT class, sum(pos) AS P, sum(neg) AS N FROM k GROUP BY class)"
)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rounded = F.transform("scores", lambda x: F.round(x, 6))
    return scored_embeddings(spark, sf).select("label", rounded.alias("scores"))


def _roc_sql(keep: str) -> str:
    return _SCORED_CTE + (
        ", steps AS (SELECT class, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS rn, "
        "lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM k WINDOW w AS (PARTITION BY class ORDER BY score DESC)) "
        "SELECT class, score AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM steps JOIN tot USING (class) "
        f"WHERE {keep} UNION ALL SELECT class, NULL, 0.0, 0.0 FROM tot"
    )


def _curve(df: DataFrame) -> DataFrame:
    return _rounded(df, "fpr", "tpr")


@query(_roc_sql("rn = 1 OR np IS NULL OR np <> pos OR nn <> neg"))
def roc_curves(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(e.roc_curve(_scores(spark, sf), "label", "scores", list(range(10))))


@query(_roc_sql("true"))
def roc_curves_all_points(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(e.roc_curve(_scores(spark, sf), "label", "scores", list(range(10)), drop_intermediate=False))


_AUC = _SCORED_CTE + (
    ", b AS (SELECT class, pos, neg, sum(neg) OVER (PARTITION BY class ORDER BY score) - neg / 2 AS below FROM k), "
    "auc AS (SELECT class, sum(pos * below) / nullif(sum(pos) * sum(neg), 0) AS auc FROM b GROUP BY class)"
)


@query(_AUC + " SELECT class, round(auc, 6) AS auc FROM auc")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(e.roc_auc(_scores(spark, sf), "label", "scores", list(range(10))), "auc")


@query(_AUC + " SELECT round(avg(auc), 6) AS roc_auc_macro FROM auc")
def roc_auc_macro(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(e.macro_auc(e.roc_auc(_scores(spark, sf), "label", "scores", list(range(10)))), "roc_auc_macro")


@query(
    f"WITH {FLOWS_CTE}, k AS (SELECT 'BENIGN' AS class, f_price AS score, label = 'BENIGN' AS hit FROM flows UNION ALL "
    "SELECT 'DDoS', f_qty, label = 'DDoS' FROM flows), g AS (SELECT class, score, count(*) FILTER (hit) AS pos, "
    "count(*) FILTER (NOT hit) AS neg FROM k GROUP BY class, score), "
    "b AS (SELECT class, pos, neg, sum(neg) OVER (PARTITION BY class ORDER BY score) - neg / 2 AS below FROM g) "
    "SELECT class, round(sum(pos * below) / (sum(pos) * sum(neg)), 6) AS auc FROM b GROUP BY class"
)
def flow_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of raw feature values as scores over every flow."""
    df = flows(spark, sf).select("label", F.array("f_price", "f_qty").alias("scores"))
    return _rounded(e.roc_auc(df, "label", "scores", ["BENIGN", "DDoS"]), "auc")


_UNSEEN = (
    "count(*) AS total_samples, count(*) FILTER (t = 'BENIGN') AS n_benign, "
    "count(*) FILTER (t NOT IN ('BENIGN', 'Bot')) AS n_known_attack, count(*) FILTER (t = 'Bot') AS n_zero_day, "
    "count(*) FILTER (t = 'Bot' AND p <> 'BENIGN') AS zero_day_detected, "
    "round(count(*) FILTER (t = 'Bot' AND p <> 'BENIGN') / count(*) FILTER (t = 'Bot'), 6) AS zero_day_detection_rate, "
    "round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) FILTER (t <> 'Bot'), 6) AS known_accuracy FROM pairs"
)


@query(_sql() + f" SELECT {_UNSEEN}")
def unseen_class_report(spark: SparkSession, sf: str) -> DataFrame:
    report = e.unseen_class_report(_pairs(spark, sf), "label", "pred", unseen="Bot")
    return _rounded(report, "zero_day_detection_rate", "known_accuracy")


@query(
    _sql("split") + " SELECT a.class, round(a.precision, 6) AS precision_val, round(a.recall, 6) AS recall_val, "
    "round(a.f1, 6) AS f1_val, a.support AS support_val, round(b.precision, 6) AS precision_train, round(b.recall, 6) AS recall_train, "
    "round(b.f1, 6) AS f1_train, b.support AS support_train FROM pc a JOIN pc b ON a.class = b.class AND a.split = 'val' AND b.split = 'train'"
)
def train_validation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scores = _rounded(e.per_class(_matrix(spark, sf, ["split"]), ["split"]), "precision", "recall", "f1")
    val, train = (scores.filter(F.col("split") == s).drop("split") for s in ("val", "train"))
    return compare_on(val, train, "class", ("_val", "_train"))


@query(
    _sql("split") + " SELECT split, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, "
    "round(avg(f1), 6) AS f1_macro FROM pc GROUP BY split"
)
def macro_averages_by_split(spark: SparkSession, sf: str) -> DataFrame:
    scores = e.per_class(_matrix(spark, sf, ["split"]), ["split"])
    return _rounded(e.macro(scores, ["split"]), "precision_macro", "recall_macro", "f1_macro")


@query(
    _sql() + ", m AS (SELECT round(avg(precision), 6) AS pm FROM pc) SELECT round(sum(n) FILTER (t = p) / sum(n), 6) AS accuracy, "
    "any_value(pm) AS precision_macro, cast(count(*) AS integer) AS cells FROM cm, m"
)
def metrics_document(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON metrics document, read back."""
    doc = e.metrics_document(_pairs(spark, sf), "label", "pred", CLASSES)
    schema = "struct<accuracy:double,precision_macro:double,confusion:array<struct<true:string,pred:string,count:bigint>>>"
    m = F.from_json("metrics", schema)
    return doc.select(
        F.round(m["accuracy"], 6).alias("accuracy"), F.round(m["precision_macro"], 6).alias("precision_macro"),
        F.size(m["confusion"]).alias("cells"),
    )
