"""Row filters, duplicate removal and their counters."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.functions.labels import canonical_label
from flowloom.operators import rows as r
from flowloom.operators.cleaning import parse_timestamps
from flowloom.operators.lookup import distinct_values
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, RAW_CTE, flows, label_sql, raw_flows, table, time_sql
from flowloom.scratch import stage

_ROLES = {"label": "label_raw", "source": "src_raw", "destination": "dst_raw", "timestamp": "ts"}
_CLEAN_CTE = (
    f"WITH {RAW_CTE}, dedup AS (SELECT DISTINCT * FROM raw), staged AS (SELECT *, CASE "
    "WHEN coalesce(trim(label_raw), '') = '' THEN 'null_label_rows_removed' "
    "WHEN coalesce(trim(src_raw), '') = '' THEN 'missing_source_ip_rows_removed' "
    "WHEN coalesce(trim(dst_raw), '') = '' THEN 'missing_destination_ip_rows_removed' "
    f"WHEN {time_sql('ts_raw')} IS NULL THEN 'missing_timestamp_rows_removed' "
    "ELSE 'kept' END AS reason FROM dedup)"
)


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_timestamps(raw_flows(spark, sf).withColumn("ts", F.col("ts_raw")), "ts")


@query(
    _CLEAN_CTE + ", c AS (SELECT reason, count(*) AS n FROM staged GROUP BY reason), items(item) AS (VALUES "
    "('null_label_rows_removed'), ('missing_source_ip_rows_removed'), ('missing_destination_ip_rows_removed'), "
    "('missing_timestamp_rows_removed')) "
    "SELECT item, coalesce(n, 0) AS rows FROM items LEFT JOIN c ON item = reason "
    "UNION ALL SELECT 'rows_before', count(*) FROM raw "
    "UNION ALL SELECT 'duplicate_rows_removed', (SELECT count(*) FROM raw) - (SELECT count(*) FROM dedup) "
    "UNION ALL SELECT 'rows_after', count(*) FROM staged WHERE reason = 'kept'"
)
def row_clean_report(spark: SparkSession, sf: str) -> DataFrame:
    return r.row_clean_report(_parsed(spark, sf), **_ROLES)


@query(_CLEAN_CTE + " SELECT row_key, qty_raw, label_raw, ts_raw, src_raw, dst_raw, file FROM staged WHERE reason = 'kept'")
def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    return r.clean_rows(_parsed(spark, sf), **_ROLES).drop("ts")


@query(f"WITH {RAW_CTE} SELECT row_key, label_raw FROM raw WHERE trim(label_raw) <> ''")
def labelled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return r.filled_only(raw_flows(spark, sf).select("row_key", "label_raw"), "label_raw")


@query(f"WITH {RAW_CTE} SELECT row_key, src_raw, dst_raw FROM raw WHERE trim(src_raw) <> '' AND trim(dst_raw) <> ''")
def rows_with_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return r.filled_only(raw_flows(spark, sf).select("row_key", "src_raw", "dst_raw"), "src_raw", "dst_raw")


@query(f"WITH {RAW_CTE} SELECT row_key, {time_sql('ts_raw')} AS ts FROM raw WHERE {time_sql('ts_raw')} IS NOT NULL")
def rows_with_time(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).select("row_key", "ts").filter("ts IS NOT NULL")


@query(
    f"WITH {FLOWS_CTE} SELECT row_key, label FROM flows WHERE lower(label) <> 'bot'"
)
def drop_low_support(spark: SparkSession, sf: str) -> DataFrame:
    return r.drop_classes(flows(spark, sf).select("row_key", "label"), label="label")


@query(
    f"WITH {RAW_CTE}, k AS (SELECT {label_sql('label_raw')} AS label FROM raw) SELECT label, count(*) AS rows FROM k "
    "WHERE lower(label) IN ('bot', 'web attack - xss') GROUP BY label"
)
def low_support_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = raw_flows(spark, sf).select(canonical_label("label_raw").alias("label"))
    return r.dropped_class_counts(df, label="label")


@query(f"WITH {FLOWS_CTE} SELECT row_key, label FROM flows WHERE label IN ('BENIGN', 'DDoS', 'PortScan')")
def keep_train_classes(spark: SparkSession, sf: str) -> DataFrame:
    return r.keep_classes(flows(spark, sf).select("row_key", "label"), ["DDoS", "PortScan"], label="label")


@query(
    f"WITH {FLOWS_CTE} SELECT label, count(*) AS rows FROM flows "
    "WHERE label NOT IN ('BENIGN', 'DDoS', 'PortScan') GROUP BY label"
)
def other_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return r.other_class_counts(flows(spark, sf), ["DDoS", "PortScan"], label="label")


@query(f"WITH {FLOWS_CTE} SELECT row_key, label, f_qty FROM flows WHERE label <> 'BENIGN'")
def attacks_only(spark: SparkSession, sf: str) -> DataFrame:
    return r.attacks_only(flows(spark, sf).select("row_key", "label", "f_qty"), label="label")


@query(
    f"WITH {FLOWS_CTE} SELECT source_file, count(*) AS scanned, count(*) FILTER (label <> 'BENIGN') AS kept "
    "FROM flows GROUP BY source_file"
)
def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    return r.scan_report(flows(spark, sf), label="label", file="source_file")


@query(
    f"WITH {FLOWS_CTE} SELECT count(*) AS scanned, count(*) FILTER (label <> 'BENIGN') AS kept, "
    "count(*) FILTER (label = 'BENIGN') AS dropped FROM flows"
)
def observed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Counts taken by the job that writes the attack rows."""
    attacks, seen = r.observe_attacks(flows(spark, sf).select("row_key", "label", "f_qty"), label="label")
    stage(attacks, "attacks")
    return spark.createDataFrame([seen.get], "scanned long, kept long, dropped long")


@query(f"WITH {FLOWS_CTE} SELECT row_key, f_disc FROM flows WHERE f_disc IS NOT NULL")
def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return r.complete_rows(flows(spark, sf).select("row_key", "f_disc"))


@query(f"WITH {RAW_CTE} SELECT row_key, label_raw FROM raw WHERE label_raw IS NOT NULL")
def rows_with_any_label(spark: SparkSession, sf: str) -> DataFrame:
    return r.complete_rows(raw_flows(spark, sf).select("row_key", "label_raw"), ["label_raw"])


@query(f"WITH {RAW_CTE} SELECT DISTINCT * FROM raw")
def deduplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return raw_flows(spark, sf).dropDuplicates()


@query(
    f"WITH {FLOWS_CTE} SELECT source_file, label, f_qty, count(*) OVER (PARTITION BY source_file) AS left_in_file "
    "FROM (SELECT DISTINCT source_file, label, f_qty FROM flows)"
)
def deduplicate_per_file(spark: SparkSession, sf: str) -> DataFrame:
    unique = flows(spark, sf).select("source_file", "label", "f_qty").dropDuplicates()
    left = unique.groupBy("source_file").agg(F.count("*").alias("left_in_file"))
    return unique.join(left, "source_file")


@query("SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def distinct_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_values(table(spark, sf, "part"), "p_type")


@query(
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier"
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment")
    b = table(spark, sf, "supplier").selectExpr("s_acctbal AS balance", "s_suppkey AS id")
    return a.unionByName(b, allowMissingColumns=True)
