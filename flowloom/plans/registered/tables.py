"""Sources and sinks: written from the given tables and read back."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.fixed_values import ATTACK
from flowloom.operators.artifacts import Artifacts
from flowloom.operators.lookup import label_map
from flowloom.operators.ordering import dense_index
from flowloom.operators.rows import dropped_class_counts, other_class_counts, row_clean_report
from flowloom.plans.flows import build_training_table
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, INDEX_CTE, flows, raw_flows, table
from flowloom.scratch import scratch_path
from flowloom.sources import readers, window_store, writers

#: Rows of one CSV file; larger tables are written as more files.
ROWS_PER_FILE = 250_000


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def pruned_parquet(spark: SparkSession, sf: str) -> DataFrame:
    df, missing = readers.read_parquet(
        spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity", "absent"]
    )
    if missing != ["absent"]:
        raise ValueError(missing)
    return df


@query(
    f"WITH {FLOWS_CTE} SELECT row_key, label, round(f_price, 2) AS f_price, f_disc FROM flows"
)
def csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Several CSV files written and read as one table, headers, types and files intact."""
    path = scratch_path(spark, "csv-files")
    written = flows(spark, sf).select(
        "row_key", F.col("label").alias(" Label "), F.col("f_price").alias("Flow  Bytes/s"), "f_disc"
    )
    files = max(4, -(-written.count() // ROWS_PER_FILE))
    written.repartition(files, "row_key").write.option("header", True).csv(path)
    df, _ = readers.read_flow_csv(spark, path)
    return df.select(
        "row_key", F.col("Label").alias("label"), F.col("Flow Bytes/s").cast("double").alias("f_price"),
        F.col("f_disc").cast("double").alias("f_disc"),
    )


@query("SELECT c_custkey, c_mktsegment FROM customer")
def parquet_else_csv(spark: SparkSession, sf: str) -> DataFrame:
    """No parquet at the base name, so the CSV beside it is read, pruned to what exists."""
    base = scratch_path(spark, "fallback")
    table(spark, sf, "customer").write.option("header", True).csv(f"{base}.csv")
    df, missing = readers.read_table(spark, base, ["c_custkey", "c_mktsegment", "absent"])
    if missing != ["absent"]:
        raise ValueError(missing)
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment")


@query(f"WITH {FLOWS_CTE} SELECT label, count(*) AS n FROM flows WHERE label <> 'BENIGN' GROUP BY label")
def parquet_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Written partitioned by kind; only the attack partition is read."""
    path = scratch_path(spark, "by-kind")
    writers.write_by_kind(flows(spark, sf).select("label", "f_qty"), path, "label")
    return spark.read.parquet(path).filter(F.col("kind") == ATTACK).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {FLOWS_CTE} SELECT label, count(*) AS n FROM flows GROUP BY label")
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    counts = flows(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    writers.write_documents(counts, path)
    return spark.read.schema("label string, n long").json(path)


@query(
    f"WITH {FLOWS_CTE} SELECT count(*) - 96 AS windows, cast(0 AS bigint) AS repeated, cast(0 AS bigint) AS out_of_range, "
    "cast(0 AS bigint) AS stray_edges, cast(0 AS bigint) AS edge_gaps FROM flows"
)
def window_store_check(spark: SparkSession, sf: str) -> DataFrame:
    """Window store written, read back and checked."""
    path = scratch_path(spark, "window-store")
    df = flows(spark, sf).select("ts", "ok", "ln", "pk", "sk", "f_qty", "f_price", "src", "dst", "label")
    ix = dense_index(df, ["ts", "ok", "ln", "pk", "sk", "f_qty", "f_price"], name="flows")
    label2idx = label_map(["BENIGN", "DDoS", "DoS Hulk", "PortScan"])
    window_store.write_window_store(ix, ["f_qty"], "label", label2idx, "src", "dst", path, sequences=False)
    windows, edges, meta = window_store.read_window_store(spark, path)
    return window_store.store_integrity(windows, edges, meta["num_items"])


@query(
    f"WITH {INDEX_CTE}, tot AS (SELECT count(*) AS n FROM ix), w AS (SELECT i AS window_id FROM ix, tot WHERE i < greatest(1, n - 96)), "
    "q AS (SELECT i AS window_id, sum(f_qty) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS qty, "
    "count(*) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS n_edges FROM ix) "
    "SELECT window_id, cast(CASE l.label WHEN 'DDoS' THEN 1 WHEN 'DoS Hulk' THEN 2 WHEN 'PortScan' THEN 3 ELSE 0 END AS integer) AS y, "
    "n_edges, qty FROM w JOIN q USING (window_id) JOIN ix l ON l.i = window_id + 16"
)
def stored_window_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Stored windows joined with what their stored edges add up to, bucket by bucket."""
    path = scratch_path(spark, "window-store")
    df = flows(spark, sf).select("ts", "ok", "ln", "pk", "sk", "f_qty", "f_price", "src", "dst", "label")
    ix = dense_index(df, ["ts", "ok", "ln", "pk", "sk", "f_qty", "f_price"], name="flows")
    label2idx = label_map(["BENIGN", "DDoS", "DoS Hulk", "PortScan"])
    window_store.write_window_store(ix, ["f_qty"], "label", label2idx, "src", "dst", path, sequences=False)
    windows, edges, _ = window_store.read_window_store(spark, path)
    totals = edges.groupBy("block", "window_id").agg(F.count("*").alias("n_edges"), F.sum("f_qty").alias("qty"))
    return windows.join(totals, ["block", "window_id"]).select("window_id", "y", "n_edges", "qty")


@query(
    f"WITH {FLOWS_CTE}, d AS (SELECT DISTINCT source_file, label, src, dst, f_qty FROM flows) "
    "SELECT 'row cleaning' AS section, 'rows_before' AS item, count(*) AS value FROM flows "
    "UNION ALL SELECT 'row cleaning', 'rows_after', count(*) FROM d "
    "UNION ALL SELECT 'row cleaning', 'duplicate_rows_removed', (SELECT count(*) FROM flows) - count(*) FROM d "
    "UNION ALL SELECT 'row cleaning', unnest(['null_label_rows_removed', 'missing_source_ip_rows_removed', "
    "'missing_destination_ip_rows_removed', 'missing_timestamp_rows_removed']), 0 "
    "UNION ALL SELECT 'low-support classes', label, count(*) FROM d WHERE label = 'Bot' GROUP BY label "
    "UNION ALL SELECT 'other classes', label, count(*) FROM d WHERE label = 'PortScan' GROUP BY label "
    "UNION ALL SELECT 'features', 'numeric features', 1 UNION ALL SELECT 'dropped columns', 'f_const', NULL"
)
def preprocessing_report(spark: SparkSession, sf: str) -> DataFrame:
    df = flows(spark, sf).select("source_file", "label", "src", "dst", "f_qty")
    rows = row_clean_report(df, label="label", source="src", destination="dst", timestamp=None)
    unique = df.dropDuplicates()
    report = writers.preprocessing_report(
        rows,
        dropped_class_counts(unique, label="label"),
        other_class_counts(unique, ["Bot", "DDoS", "DoS Hulk"], label="label"),
        Artifacts(features=["f_qty"], dropped={"f_const": "near-zero variance"}),
    )
    return report.select("section", "item", "value")


@query()
def training_table(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty text to the scaled training table, profiled per label."""
    raw = raw_flows(spark, sf).selectExpr(
        "row_key AS `Flow ID`", "qty_raw AS `Flow Byts/s`", "label_raw AS Label", "ts_raw AS Timestamp",
        "src_raw AS `Src IP`", "dst_raw AS `Dst IP`", "file AS SourceFile",
    )
    built = build_training_table(raw)
    features = [f for f in built.artifacts.features if f in built.df.columns]
    return built.df.groupBy("Label").agg(F.count("*").alias("n"), *[F.round(F.avg(f"`{f}`"), 6).alias(f) for f in features])
