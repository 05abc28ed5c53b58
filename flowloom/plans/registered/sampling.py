"""Sampling, balancing, splits, order and top-k."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.functions.ordering import random_key
from flowloom.operators import sampling as s
from flowloom.operators.cleaning import row_index_per_file
from flowloom.operators.ordering import dense_index
from flowloom.operators.risk import benign_first
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, TIE, flows, table

_RANDOM = "md5('42|' || row_key), row_key"


@query(
    f"WITH {FLOWS_CTE}, r AS (SELECT row_key, label, row_number() OVER (PARTITION BY label ORDER BY {_RANDOM}) AS rn "
    "FROM flows) SELECT row_key, label FROM r WHERE NOT (label = 'BENIGN' AND rn > 3000) AND NOT (label = 'DDoS' AND rn > 700)"
)
def cap_classes(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("row_key", "label")
    return s.cap_classes(df, {"BENIGN": 3000, "DDoS": 700}, ["row_key"], "label")


@query(f"WITH {FLOWS_CTE} SELECT row_key, f_qty FROM flows ORDER BY {_RANDOM} LIMIT 2000")
def sample_exact(spark: SparkSession, sf: str) -> DataFrame:
    return s.sample_rows(flows(spark, sf).select("row_key", "f_qty"), 2000, ["row_key"])


@query(
    f"WITH {FLOWS_CTE}, k AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, ok, ln, pk, sk, f_qty, f_price) - 1 "
    "AS row_index FROM flows), r AS (SELECT *, row_number() OVER (PARTITION BY label = 'BENIGN' ORDER BY source_file, row_index) AS rn FROM k) "
    "SELECT source_file, row_index, label FROM r WHERE rn <= CASE WHEN label = 'BENIGN' THEN 1000 ELSE 3000 END"
)
def first_benign_and_attacks(spark: SparkSession, sf: str) -> DataFrame:
    df = row_index_per_file(flows(spark, sf).select("source_file", "label", "ts", *TIE), ["ts", *TIE], "source_file")
    df = df.select("source_file", "row_index", "label")
    return s.first_of_each(df, 1000, 3000, "source_file", "row_index", "label")


@query(
    f"WITH {FLOWS_CTE}, r AS (SELECT row_key, label, row_number() OVER (PARTITION BY label ORDER BY {_RANDOM}) AS rn "
    "FROM flows WHERE label IN ('DDoS', 'DoS Hulk', 'PortScan')) SELECT row_key, label FROM r WHERE rn <= 300"
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("row_key", "label")
    return s.stratified_sample(df, 900, ["DDoS", "DoS Hulk", "PortScan"], ["row_key"], "label")


@query()
def draws_with_replacement(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("row_key", "label", "f_qty")
    return s.draw_with_replacement(df, 5000, ["row_key"])


@query(
    f"WITH {FLOWS_CTE} SELECT row_key, row_number() OVER (ORDER BY {_RANDOM}) - 1 AS shuffle_pos FROM flows"
)
def global_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("row_key")
    return dense_index(df, [random_key(42, "row_key"), "row_key"], "shuffle_pos", "shuffle").df


@query(
    f"WITH {FLOWS_CTE}, h AS (SELECT row_key, cast('0x' || substr(md5('42|' || row_key), 1, 7) AS bigint) % 10000 AS u FROM flows) "
    "SELECT row_key, CASE WHEN u < 8000 THEN 'train' ELSE 'val' END AS split FROM h"
)
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return s.split(flows(spark, sf).select("row_key"), ["row_key"])


@query(
    f"WITH {FLOWS_CTE} SELECT row_key, round(f_qty * 1.5 + 2.0, 6) AS f_qty, round(f_tax * 1.5 + 2.0, 6) AS f_tax FROM flows"
)
def shifted_features(spark: SparkSession, sf: str) -> DataFrame:
    df = s.shift_features(flows(spark, sf).select("row_key", "f_qty", "f_tax"), ["f_qty", "f_tax"], 1.5, 2.0)
    return df.withColumns({c: F.round(c, 6) for c in ("f_qty", "f_tax")})


@query(f"WITH {FLOWS_CTE} SELECT ts, ok, ln, pk, sk, f_qty, f_price FROM flows")
def sorted_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).select("ts", *TIE).orderBy("ts", *TIE)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def sorted_by_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 5")
def top_five(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "p_name").limit(5)


@query(f"WITH {FLOWS_CTE} SELECT label, count(*) AS n, label = 'BENIGN' AS first FROM flows GROUP BY label")
def benign_class_first(spark: SparkSession, sf: str) -> DataFrame:
    counts = flows(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return benign_first(counts.withColumn("first", F.col("label") == "BENIGN"), "label")
