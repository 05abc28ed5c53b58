"""Value cleaning and imputation."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.fixed_values import TAXONOMY
from flowloom.functions.labels import canonical_label, label_key
from flowloom.functions.values import to_number, to_timestamp
from flowloom.operators import cleaning as c
from flowloom.operators.sampling import cap_benign
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, RAW_CTE, TIE, flows, label_sql, number_sql, raw_flows, time_sql

_FEATURES = ["f_qty", "f_price", "f_disc", "f_tax"]


@query(
    f"WITH {RAW_CTE} SELECT row_key, {label_sql('label_raw')} AS label, lower({label_sql('label_raw')}) AS label_key FROM raw"
)
def canonical_labels(spark: SparkSession, sf: str) -> DataFrame:
    return raw_flows(spark, sf).select(
        "row_key", canonical_label("label_raw").alias("label"), label_key("label_raw").alias("label_key")
    )


@query(f"WITH {RAW_CTE} SELECT row_key, {label_sql('label_raw')} AS label_raw FROM raw")
def normalized_labels(spark: SparkSession, sf: str) -> DataFrame:
    return c.normalize_labels(raw_flows(spark, sf).select("row_key", "label_raw"), "label_raw")


@query(f"WITH {RAW_CTE} SELECT upper(trim(label_raw)) AS label, count(*) AS n FROM raw GROUP BY 1")
def upper_labels(spark: SparkSession, sf: str) -> DataFrame:
    return raw_flows(spark, sf).groupBy(F.upper(F.trim("label_raw")).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {RAW_CTE} SELECT row_key, {number_sql('qty_raw')} AS qty FROM raw")
def coerced_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return raw_flows(spark, sf).select("row_key", to_number(F.col("qty_raw")).alias("qty"))


@query(f"WITH {RAW_CTE} SELECT row_key, file, {number_sql('qty_raw')} AS qty_raw FROM raw")
def coerced_table(spark: SparkSession, sf: str) -> DataFrame:
    return c.coerce_numbers(raw_flows(spark, sf).select("row_key", "file", "qty_raw"), ("row_key", "file"))


@query(f"WITH {RAW_CTE} SELECT row_key, {time_sql('ts_raw')} AS ts FROM raw")
def two_stage_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return raw_flows(spark, sf).select("row_key", to_timestamp(F.col("ts_raw")).alias("ts"))


@query(f"WITH {RAW_CTE} SELECT row_key, try_strptime(ts_raw, '%d/%m/%Y %H:%M:%S') AS ts FROM raw")
def plain_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return raw_flows(spark, sf).select("row_key", to_timestamp(F.col("ts_raw"), ["dd/MM/yyyy HH:mm:ss"]).alias("ts"))


@query(
    f"WITH {FLOWS_CTE}, m AS (SELECT median(f_disc) AS md FROM flows) "
    "SELECT row_key, f_qty, f_price, coalesce(f_disc, md) AS f_disc, f_tax, cast(0 AS double) AS f_empty FROM flows, m"
)
def impute_medians(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("row_key", *_FEATURES, F.lit(None).cast("double").alias("f_empty"))
    medians = c.fit_medians(df, [*_FEATURES, "f_empty"], exact=True)
    return c.impute(df, medians)


@query(
    f"WITH {FLOWS_CTE}, long AS (UNPIVOT (SELECT f_qty, f_price, f_disc, f_tax FROM flows) "
    "ON f_qty, f_price, f_disc, f_tax INTO NAME feature VALUE v) "
    "SELECT feature, round(median(v), 6) AS median FROM long GROUP BY feature"
)
def fitted_medians(spark: SparkSession, sf: str) -> DataFrame:
    medians = c.fit_medians(flows(spark, sf), _FEATURES, exact=True)
    rows = [(f, round(m, 6)) for f, m in medians.items()]
    return spark.createDataFrame(rows, "feature string, median double")


@query(f"WITH {FLOWS_CTE} SELECT row_key, coalesce(f_disc, 0.125) AS f_disc, f_qty FROM flows")
def apply_stored_medians(spark: SparkSession, sf: str) -> DataFrame:
    return c.impute(flows(spark, sf).select("row_key", "f_disc", "f_qty"), {"f_disc": 0.125, "f_qty": 1.0})


@query(
    f"WITH {FLOWS_CTE}, freq AS (SELECT dst, row_number() OVER (ORDER BY count(*) DESC, dst) - 1 AS code "
    "FROM flows GROUP BY dst) SELECT row_key, cast(code AS integer) AS dst FROM flows JOIN freq USING (dst)"
)
def frequency_codes(spark: SparkSession, sf: str) -> DataFrame:
    return c.encode_by_frequency(flows(spark, sf).select("row_key", "dst"), ["dst"])[0]


@query(
    f"WITH {RAW_CTE}, t AS (SELECT file, coalesce(trim(src_raw), 'nan') AS s, coalesce(trim(dst_raw), 'nan') AS d FROM raw) "
    "SELECT file, NOT bool_and((s = '0.0.0.0' OR lower(s) = 'nan') AND (d = '0.0.0.0' OR lower(d) = 'nan')) "
    "AND (count(DISTINCT s) > 1 OR count(DISTINCT d) > 1) AS usable FROM t GROUP BY file"
)
def usable_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return c.endpoint_report(raw_flows(spark, sf), ["file"], "src_raw", "dst_raw")


@query(
    f"WITH {FLOWS_CTE} SELECT row_key, source_file, "
    "row_number() OVER (PARTITION BY source_file ORDER BY ts, ok, ln, pk, sk, f_qty, f_price) - 1 AS row_index FROM flows"
)
def row_index_per_file(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("row_key", "source_file", "ts", *TIE)
    return c.row_index_per_file(df, ["ts", *TIE], "source_file").select("row_key", "source_file", "row_index")


@query()
def pseudo_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("row_key", "source_file", "ts", *TIE)
    return c.assign_endpoints(df, ["ts", *TIE], "source_file").select(
        "row_key", "source_file", "Source IP", "Destination IP"
    )


@query(
    f"WITH {RAW_CTE} SELECT row_key, trim(label_raw) AS original, CASE WHEN label_raw IS NULL THEN NULL "
    "WHEN upper(trim(label_raw)) = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS label_raw FROM raw"
)
def binary_labels(spark: SparkSession, sf: str) -> DataFrame:
    return c.to_binary(raw_flows(spark, sf).select("row_key", "label_raw"), "label_raw", "original")


_SECOND = (
    "CASE p_type WHEN 'ECONOMY' THEN 'Benign' WHEN 'STANDARD' THEN 'DDOS attack-HOIC' "
    "WHEN 'PROMO' THEN 'DoS attacks-Hulk' ELSE 'Infilteration' END"
)


@query(
    f"SELECT p_partkey, CASE {_SECOND} WHEN 'Benign' THEN 'BENIGN' WHEN 'DDOS attack-HOIC' THEN 'DDoS' "
    f"ELSE 'DoS Hulk' END AS label FROM part WHERE {_SECOND} <> 'Infilteration'"
)
def remapped_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", f"{_SECOND} AS label")
    return c.to_training_taxonomy(df, TAXONOMY, "label")


@query(
    f"WITH {FLOWS_CTE}, r AS (SELECT row_key, label, row_number() OVER (PARTITION BY label = 'BENIGN' "
    "ORDER BY md5('42|' || row_key), row_key) AS rn FROM flows) "
    "SELECT row_key, label FROM r WHERE label <> 'BENIGN' OR rn <= 5000"
)
def balanced_evaluation_set(spark: SparkSession, sf: str) -> DataFrame:
    return cap_benign(flows(spark, sf).select("row_key", "label"), 5000, ["row_key"], "label")
