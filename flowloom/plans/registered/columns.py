"""Schema operators."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.fixed_values import COLUMN_ALIASES, EXPLORATORY_DROPS, SHORT_IP_ALIASES
from flowloom.operators import columns as c
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, flows, table


@query('SELECT l_orderkey AS "Flow ID", l_quantity AS "Flow Bytes/s", l_returnflag AS "Label" FROM lineitem')
def clean_headers(spark: SparkSession, sf: str) -> DataFrame:
    padded = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS `  Flow   ID `", "l_quantity AS ` Flow  Bytes/s`", "l_returnflag AS `Label  `"
    )
    return c.clean_column_names(padded)


@query(
    'SELECT l_quantity AS "Flow Byts/s", l_quantity AS "Flow Bytes/s", l_tax AS "Pkt Len Max", '
    'l_discount AS "Max Packet Length", l_suppkey AS "Src IP", l_suppkey AS "Source IP" FROM lineitem'
)
def alias_columns(spark: SparkSession, sf: str) -> DataFrame:
    short = table(spark, sf, "lineitem").selectExpr(
        "l_quantity AS `Flow Byts/s`", "l_tax AS `Pkt Len Max`", "l_discount AS `Max Packet Length`",
        "l_suppkey AS `Src IP`",
    )
    return c.apply_aliases(short, COLUMN_ALIASES)


@query(
    'SELECT o_custkey AS "Src IP", o_orderkey AS "Dst IP", o_custkey AS "Source IP", '
    'o_orderkey AS "Destination IP" FROM orders'
)
def alias_short_ips(spark: SparkSession, sf: str) -> DataFrame:
    short = table(spark, sf, "orders").selectExpr("o_custkey AS `Src IP`", "o_orderkey AS `Dst IP`")
    return c.apply_aliases(short, SHORT_IP_ALIASES)


@query(
    f"WITH {FLOWS_CTE} SELECT f_qty, f_tax, cast(NULL AS double) AS f_null, cast(0 AS double) AS f_zero FROM flows"
)
def complete_features(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("f_qty", "f_tax")
    return c.ensure_features(c.ensure_features(df, ["f_qty", "f_null"]), ["f_zero"], 0.0)


@query(
    "SELECT user_id, '0.0.0.0' AS \"Source IP\", '0.0.0.0' AS \"Destination IP\", "
    "timestamp '2024-01-01 00:00:00' AS \"Timestamp\", 'unknown' AS \"SourceFile\", event_type AS \"Label\" FROM events"
)
def complete_meta(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").selectExpr("user_id", "event_type AS Label")
    return c.ensure_meta(df, now="2024-01-01 00:00:00")


@query(
    'SELECT l_quantity AS "Flow Bytes/s", l_returnflag AS "Label", l_tax AS "RST Flag Count" FROM lineitem'
)
def drop_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS `Flow ID`", "l_quantity AS `Flow Bytes/s`", "l_discount AS `Fwd PSH Flags`",
        "l_tax AS `Bwd Avg Bytes/Bulk`", "l_returnflag AS Label", "l_tax AS `RST Flag Count`",
    )
    return c.drop_designated(df)[0]


@query('SELECT l_quantity AS "Flow Bytes/s", l_returnflag AS "Label" FROM lineitem')
def drop_exploratory(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS `Flow ID`", "l_quantity AS `Flow Bytes/s`", "l_discount AS `Total Fwd Packets`",
        "l_returnflag AS Label", "l_tax AS `RST Flag Count`",
    )
    return c.drop_listed(df, EXPLORATORY_DROPS)


@query(
    f'WITH {FLOWS_CTE} SELECT f_price, f_qty, label AS "Label", source_file AS "SourceFile" FROM flows'
)
def keep_model_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).withColumnsRenamed({"label": "Label", "source_file": "SourceFile"})
    return c.keep_columns(df, ["f_price", "f_qty"])


@query(f"WITH {FLOWS_CTE} SELECT row_key, label, f_qty, f_price FROM flows")
def drop_non_model_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("row_key", "src", "dst", "ts", "label", "f_qty", "f_price")
    return c.drop_listed(df, ["src", "dst", "ts", "absent"])


@query(
    f"WITH {FLOWS_CTE}, wide AS (SELECT label, count(*) AS n_rows, count(f_disc) AS n_disc FROM flows GROUP BY label) "
    "SELECT label, 'n_rows' AS split_type, n_rows AS n FROM wide UNION ALL SELECT label, 'n_disc', n_disc FROM wide"
)
def melt_counts(spark: SparkSession, sf: str) -> DataFrame:
    wide = flows(spark, sf).groupBy("label").agg(F.count("*").alias("n_rows"), F.count("f_disc").alias("n_disc"))
    return c.melt(wide, ["label"], ["n_rows", "n_disc"], "split_type", "n")


@query(
    f"WITH {FLOWS_CTE} SELECT label AS class, round(avg(f_tax), 6) AS precision, count(*) AS support "
    "FROM flows GROUP BY label"
)
def map_entries_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    stats = F.struct(F.round(F.avg("f_tax"), 6).alias("precision"), F.count("*").alias("support"))
    per_label = flows(spark, sf).groupBy("label").agg(stats.alias("s"))
    one = per_label.agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("per_class"))
    return c.map_to_rows(one, "per_class", "class", ["precision", "support"])
