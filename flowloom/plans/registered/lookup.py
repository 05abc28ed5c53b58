"""Lookup joins."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import lookup as k
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, flows, table

_KNOWN = k.label_map(["BENIGN", "DDoS", "DoS Hulk", "PortScan"])


def _metrics(df: DataFrame, where: str) -> DataFrame:
    return df.filter(where).groupBy("label").agg(F.round(F.avg("f_qty"), 6).alias("precision"), F.count("*").alias("support"))


@query(
    f"WITH {FLOWS_CTE}, v AS (SELECT label, round(avg(f_qty), 6) AS p, count(*) AS s FROM flows WHERE f_tax > 0.04 GROUP BY label), "
    "t AS (SELECT label, round(avg(f_qty), 6) AS p, count(*) AS s FROM flows WHERE f_tax <= 0.04 GROUP BY label) "
    "SELECT label, v.p AS precision_val, v.s AS support_val, t.p AS precision_train, t.s AS support_train FROM v JOIN t USING (label)"
)
def compare_metric_tables(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf)
    return k.compare_on(_metrics(df, "f_tax > 0.04"), _metrics(df, "f_tax <= 0.04"), "label", ("_val", "_train"))


@query(
    f"WITH {FLOWS_CTE} SELECT label, round(avg(f_qty), 6) AS precision_val, count(*) AS support_val, "
    "cast(NULL AS double) AS precision_train, cast(NULL AS bigint) AS support_train FROM flows GROUP BY label"
)
def compare_without_partner(spark: SparkSession, sf: str) -> DataFrame:
    return k.compare_on(_metrics(flows(spark, sf), "true"), None, "label", ("_val", "_train"))


@query(
    f"WITH {FLOWS_CTE} SELECT row_key, cast(CASE label WHEN 'BENIGN' THEN 0 WHEN 'DDoS' THEN 1 WHEN 'DoS Hulk' THEN 2 "
    "WHEN 'PortScan' THEN 3 ELSE 0 END AS integer) AS y FROM flows"
)
def label_to_index(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).select("row_key", k.label_index(F.col("label"), _KNOWN).alias("y"))


@query(
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DDoS' WHEN 2 THEN 'DoS Hulk' "
    "WHEN 3 THEN 'PortScan' ELSE 'UNK' END AS label FROM events"
)
def index_to_label(spark: SparkSession, sf: str) -> DataFrame:
    index = (F.col("event_id") % 6).cast("int")
    return table(spark, sf, "events").select("event_id", k.index_label(index, _KNOWN).alias("label"))


@query(
    f"WITH {FLOWS_CTE} SELECT label, cast(row_number() OVER (ORDER BY label) - 1 AS integer) AS idx "
    "FROM (SELECT DISTINCT label FROM flows)"
)
def label_index_table(spark: SparkSession, sf: str) -> DataFrame:
    return k.label_index_table(flows(spark, sf), "label")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS o_custkey")
    return table(spark, sf, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def non_membership(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS o_custkey")
    return table(spark, sf, "orders").join(wanted, "o_custkey", "left_anti").select("o_orderkey")
