"""Exploratory profile."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import profile as p
from flowloom.operators.features import correlation_pairs
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, RAW_CTE, flows, raw_flows, table


@query("SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows"
       .replace("SELECT (SELECT", f"WITH {RAW_CTE} SELECT (SELECT", 1))
def duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    return p.duplicate_count(raw_flows(spark, sf))


@query(
    f"WITH {RAW_CTE} SELECT count(*) - count(DISTINCT (label_raw, qty_raw, ts_raw)) AS duplicate_rows FROM raw"
)
def duplicate_count_without_file(spark: SparkSession, sf: str) -> DataFrame:
    return p.duplicate_count(raw_flows(spark, sf), ["label_raw", "qty_raw", "ts_raw"])


@query(
    f"WITH {RAW_CTE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM raw"
        for c in ("row_key", "qty_raw", "label_raw", "ts_raw", "src_raw", "dst_raw", "file")
    )
)
def missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p.missing_counts(raw_flows(spark, sf))


@query(f"WITH {RAW_CTE} SELECT label_raw, count(*) AS count FROM raw GROUP BY label_raw")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return p.label_distribution(raw_flows(spark, sf), "label_raw")


@query("SELECT source, count(*) AS count FROM documents GROUP BY source")
def source_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return p.label_distribution(table(spark, sf, "documents"), "source")


@query(
    f"WITH {FLOWS_CTE} SELECT count(*) AS total, count(*) FILTER (label = 'BENIGN') AS benign, "
    "count(*) FILTER (label <> 'BENIGN') AS attack FROM flows"
)
def benign_attack_totals(spark: SparkSession, sf: str) -> DataFrame:
    return p.benign_attack_totals(flows(spark, sf), "label")


@query(
    f"WITH {FLOWS_CTE}, t(target) AS (VALUES ('BENIGN'), ('DDoS'), ('DoS Hulk'), ('PortScan'), ('Heartbleed')) "
    "SELECT target, count(label) AS count FROM t LEFT JOIN flows ON lower(label) = lower(target) GROUP BY target"
)
def target_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p.target_counts(flows(spark, sf), ["BENIGN", "DDoS", "DoS Hulk", "PortScan", "Heartbleed"], "label")


@query(
    "WITH c AS (SELECT p_name AS value, count(*) AS count FROM part GROUP BY p_name), "
    "top AS (SELECT * FROM c ORDER BY count DESC, value LIMIT 10) SELECT * FROM top "
    "UNION ALL SELECT concat('... (', cast(count(*) - 10 AS string), ' more)'), count(*) - 10 FROM c HAVING count(*) > 10"
)
def top_labels_with_rest(spark: SparkSession, sf: str) -> DataFrame:
    return p.top_values(table(spark, sf, "part"), "p_name", 10)


_DESCRIBED = ["o_totalprice", "o_custkey"]
_TEXT = ["o_orderstatus", "o_orderpriority"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, cast(NULL AS bigint) AS \"unique\", cast(NULL AS string) AS top, "
        f"cast(NULL AS bigint) AS freq, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"cast(min({c}) AS double) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, "
        f"round(quantile_cont({c}, 0.75), 4) AS p75, cast(max({c}) AS double) AS max FROM orders"
        for c in _DESCRIBED
    )
    + "".join(
        f" UNION ALL SELECT '{c}', sum(n)::BIGINT, count(*), arg_min(v, (-n, v)), max(n), NULL, NULL, NULL, NULL, NULL, NULL, NULL "
        f"FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in _TEXT
    )
)
def describe_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = p.describe(table(spark, sf, "orders"), _DESCRIBED, _TEXT)
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query(
    " UNION ALL ".join(
        f"SELECT cast({k} AS integer) AS ord, '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM customer"
        for k, (c, t) in enumerate(
            [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
             ("c_mktsegment", "string")]
        )
    )
)
def schema_profile(spark: SparkSession, sf: str) -> DataFrame:
    return p.schema_profile(table(spark, sf, "customer"))


@query("SELECT count(*) AS rows, cast(5 AS bigint) AS cols FROM customer")
def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    return p.shape(table(spark, sf, "customer"))


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM part"
        for a, b in (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))
    )
)
def profile_correlations(spark: SparkSession, sf: str) -> DataFrame:
    pairs = correlation_pairs(table(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"])
    return pairs.withColumn("corr", F.round("corr", 6))


@query(
    f"WITH {FLOWS_CTE} SELECT label, count(*) AS c, round(avg(f_qty), 6) AS m, round(stddev_samp(f_price), 4) AS sd, "
    "count(f_disc) AS nn FROM flows GROUP BY label"
)
def numeric_profile_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).groupBy("label").agg(
        F.count("*").alias("c"), F.round(F.avg("f_qty"), 6).alias("m"),
        F.round(F.stddev_samp("f_price"), 4).alias("sd"), F.count("f_disc").alias("nn"),
    )


@query(
    f"WITH {RAW_CTE} SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows, "
    "cast((count(row_key) < count(*))::int + (count(qty_raw) < count(*))::int + (count(label_raw) < count(*))::int "
    "+ (count(ts_raw) < count(*))::int + (count(src_raw) < count(*))::int + (count(dst_raw) < count(*))::int "
    "+ (count(file) < count(*))::int AS bigint) AS num_missing_columns FROM raw"
)
def profile_document(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON profile, read back."""
    doc = p.profile_document(raw_flows(spark, sf), "label_raw")
    d = F.from_json("profile", "struct<shape:struct<rows:bigint>,duplicate_rows:bigint,num_missing_columns:bigint>")
    return doc.select(d["shape"]["rows"].alias("rows"), d["duplicate_rows"].alias("duplicate_rows"),
                      d["num_missing_columns"].alias("num_missing_columns"))
