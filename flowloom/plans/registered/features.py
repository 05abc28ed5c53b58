"""Feature selection, scaling, alignment; and the flagship label profile."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import cleaning, features as ft
from flowloom.operators.artifacts import Artifacts
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, flows, table

_ALL = ["f_qty", "f_price", "f_disc", "f_tax", "f_const", "f_qty_dup"]
_FILLED_CTE = (
    f"WITH {FLOWS_CTE}, filled AS (SELECT * EXCLUDE (f_disc), "
    "coalesce(f_disc, (SELECT median(f_disc) FROM flows)) AS f_disc FROM flows)"
)


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf)
    return cleaning.impute(df, cleaning.fit_medians(df, ["f_disc"], exact=True))


@query(
    _FILLED_CTE + ", s AS (SELECT avg(f_qty) AS mq, stddev_pop(f_qty) AS sq, avg(f_price) AS mp, stddev_pop(f_price) AS sp, "
    "avg(f_disc) AS md, stddev_pop(f_disc) AS sd FROM filled) "
    "SELECT CASE WHEN label = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS kind, label, count(*) AS flows, "
    "round(avg((f_qty - mq) / sq), 6) AS f_qty, round(avg((f_price - mp) / sp), 6) AS f_price, "
    "round(avg((f_disc - md) / sd), 6) AS f_disc FROM filled, s GROUP BY ALL"
)
def label_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: impute, standardise, collapse labels and profile the classes."""
    names = ["f_qty", "f_price", "f_disc"]
    df = flows(spark, sf).select("label", *names)
    medians = cleaning.fit_medians(df, names, exact=True)
    filled = cleaning.impute(df, medians)
    means, stds = ft.fit_scaler(filled, names)
    scaled = ft.scale(filled, Artifacts(names, medians, means, stds))
    return (
        cleaning.to_binary(scaled.withColumn("kind", F.col("label")), "kind", "label")
        .groupBy("kind", "label")
        .agg(F.count("*").alias("flows"), *[F.round(F.avg(f), 6).alias(f) for f in names])
    )


@query(
    _FILLED_CTE + ", u AS (UNPIVOT (SELECT " + ", ".join(_ALL) + " FROM filled) ON " + ", ".join(_ALL)
    + " INTO NAME feature VALUE v), s AS (SELECT feature, stddev_samp(v) AS sd FROM u GROUP BY feature) "
    "SELECT feature, round(sd, 4) AS std, sd <= 1e-8 AS dropped FROM s"
)
def near_zero_variance(spark: SparkSession, sf: str) -> DataFrame:
    stds = {c: m.std_samp for c, m in ft.moments(_filled(spark, sf), _ALL).items()}
    gone = ft.near_zero_variance(stds)
    return spark.createDataFrame(
        [(c, round(s, 4), c in gone) for c, s in stds.items()], "feature string, std double, dropped boolean"
    )


_PAIRS = [(a, b) for i, a in enumerate(_ALL) for b in _ALL[i + 1:]]


@query(
    f"WITH {FLOWS_CTE}, v AS (SELECT * REPLACE (nullif(f_const, 1) AS f_const) FROM flows) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, "
        + ("max(cast(NULL AS double))" if "f_const" in (a, b) else f"round(corr({a}, {b}), 6)")
        + " AS corr FROM v"
        for a, b in _PAIRS
    )
)
def correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairwise correlations over rows where both are present; a constant column has none."""
    return ft.correlation_pairs(flows(spark, sf), _ALL).withColumn("corr", F.round("corr", 6))


@query(
    _FILLED_CTE + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM filled"
        for a, b in _PAIRS if "f_const" not in (a, b)
    )
)
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    names = [c for c in _ALL if c != "f_const"]
    matrix = ft.correlation_matrix(_filled(spark, sf), names)
    rows = [(a, b, round(matrix[a, b], 6) + 0.0) for a, b in _PAIRS if (a, b) in matrix]
    return spark.createDataFrame(rows, "a string, b string, corr double")


@query(
    _FILLED_CTE + " SELECT 'f_qty' AS feature, abs(corr(f_qty, f_qty_dup)) > 0.999 AND stddev_samp(f_qty) <= "
    "stddev_samp(f_qty_dup) AS dropped FROM filled UNION ALL SELECT f, false FROM (VALUES ('f_price'), ('f_disc'), "
    "('f_tax'), ('f_qty_dup')) t(f)"
)
def redundant_features(spark: SparkSession, sf: str) -> DataFrame:
    names = [c for c in _ALL if c != "f_const"]
    df = _filled(spark, sf)
    stds = {c: m.std_samp for c, m in ft.moments(df, names).items()}
    gone = ft.redundant_features(names, ft.correlation_matrix(df, names), stds)
    return spark.createDataFrame([(c, c in gone) for c in names], "feature string, dropped boolean")


@query(
    _FILLED_CTE + ", u AS (UNPIVOT (SELECT f_qty, f_price, f_const FROM filled) ON f_qty, f_price, f_const "
    "INTO NAME feature VALUE v) SELECT feature, round(avg(v), 6) AS mean, "
    "round(CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END, 6) AS std FROM u GROUP BY feature"
)
def scaler_statistics(spark: SparkSession, sf: str) -> DataFrame:
    means, stds = ft.fit_scaler(_filled(spark, sf), ["f_qty", "f_price", "f_const"])
    rows = [(c, round(means[c], 6), round(stds[c], 6)) for c in means]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


@query(
    f"WITH {FLOWS_CTE} SELECT row_key, round((f_qty - 25.5) / 14.25, 6) AS f_qty, "
    "round((f_tax - 0.04) / 0.025, 6) AS f_tax FROM flows"
)
def scale_with_stored_statistics(spark: SparkSession, sf: str) -> DataFrame:
    art = Artifacts(["f_qty", "f_tax"], {}, {"f_qty": 25.5, "f_tax": 0.04}, {"f_qty": 14.25, "f_tax": 0.025})
    scaled = ft.scale(flows(spark, sf).select("row_key", "f_qty", "f_tax"), art)
    return scaled.select("row_key", F.round("f_qty", 6).alias("f_qty"), F.round("f_tax", 6).alias("f_tax"))


@query(
    _FILLED_CTE + ", s AS (SELECT avg(f_qty) AS mq, stddev_pop(f_qty) AS sq, avg(f_disc) AS md, "
    "stddev_pop(f_disc) AS sd, avg(f_price) AS mp, stddev_pop(f_price) AS sp FROM filled), "
    "m AS (SELECT median(f_price) AS pm, median(f_disc) AS dm FROM flows) "
    "SELECT o_orderstatus AS \"Label\", round((o_totalprice - mq) / sq, 4) AS f_qty, "
    "round((pm - mp) / sp, 4) AS f_price, round((0.0 - md) / sd, 4) AS f_disc FROM orders, s, m"
)
def align_foreign_table(spark: SparkSession, sf: str) -> DataFrame:
    """Another table brought into the fitted space: one feature present, one filled with its median, one with zero."""
    names = ["f_qty", "f_price", "f_disc"]
    df = flows(spark, sf).select(*names)
    medians = cleaning.fit_medians(df, names, exact=True)
    means, stds = ft.fit_scaler(cleaning.impute(df, medians), names)
    art = Artifacts(names, medians, means, stds)
    foreign = table(spark, sf, "orders").selectExpr(
        "o_totalprice AS f_qty", "cast(0 AS double) AS f_disc", "o_orderstatus AS Label", "o_orderkey AS other"
    )
    return ft.align(foreign, art).select("Label", *[F.round(f, 4).alias(f) for f in names])


@query()
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return ft.feature_importance(flows(spark, sf), ["f_qty", "f_price", "f_disc", "f_tax"], "label", trees=10, depth=4)


@query()
def fitted_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """The artifact table of a whole fit: medians, variance and correlation drops, scaling."""
    df = flows(spark, sf).select("label", *_ALL)
    return ft.fit_features(df, exact_medians=True, exclude=("label",)).to_table(spark)
