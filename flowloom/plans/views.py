"""Flow-shaped views over the shared test tables, as expressions both SQL dialects accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SRC = "concat('10.0.', cast(cast(floor(l_suppkey/256) as bigint) as string), '.', cast(l_suppkey % 256 as string))"
DST = "concat('192.168.0.', cast(l_partkey % 64 as string))"
ROW_KEY = (
    "concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
    "cast(l_suppkey as string), cast(cast(l_quantity as bigint) as string), "
    "cast(cast(round(l_extendedprice*100) as bigint) as string))"
)

# Clean, typed flows.
FLOWS = {
    "row_key": ROW_KEY,
    "ts": "l_shipdate",
    "src": SRC,
    "dst": DST,
    "label": (
        "CASE WHEN l_returnflag='N' THEN 'BENIGN' WHEN l_returnflag='A' AND l_linestatus='F' THEN 'DDoS' "
        "WHEN l_returnflag='A' THEN 'DoS Hulk' WHEN l_linestatus='F' THEN 'PortScan' ELSE 'Bot' END"
    ),
    "source_file": "concat('day_', cast(l_linenumber % 4 as string), '.csv')",
    "f_qty": "l_quantity",
    "f_price": "l_extendedprice",
    "f_disc": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END",
    "f_tax": "l_tax",
    "f_const": "cast(1 as double)",
    "f_qty_dup": "l_quantity*2+1",
    "ok": "l_orderkey",
    "ln": "l_linenumber",
    "pk": "l_partkey",
    "sk": "l_suppkey",
}
# Numeric columns that make the time order unique.
TIE = ["ok", "ln", "pk", "sk", "f_qty", "f_price"]
ORDER_SQL = "ts, ok, ln, pk, sk, f_qty, f_price"

# The same flows as dirty text.
RAW = {
    "row_key": ROW_KEY,
    "qty_raw": (
        "CASE l_linenumber WHEN 1 THEN 'Infinity' WHEN 2 THEN 'NaN' WHEN 3 THEN '12d' WHEN 4 THEN '' "
        "WHEN 5 THEN ' 7 ' WHEN 6 THEN '-inf' ELSE cast(cast(l_quantity as bigint) as string) END"
    ),
    "label_raw": (
        "CASE l_linenumber WHEN 1 THEN ' Web  Attack \u2013\u00a0XSS ' WHEN 2 THEN 'BENIGN ' "
        "WHEN 3 THEN 'Web Attack \u00c2\u2014 XSS' WHEN 4 THEN '' WHEN 5 THEN NULL "
        "WHEN 6 THEN 'DoS Hulk​' ELSE CASE WHEN l_partkey % 3 = 0 THEN 'Bot' ELSE 'DDoS' END END"
    ),
    "ts_raw": (
        "CASE WHEN l_suppkey % 7 = 0 THEN 'not a date' WHEN l_linenumber = 1 THEN '03/07/2017 08:55:58' "
        "WHEN l_linenumber = 2 THEN '3/7/2017 8:55' ELSE '13/07/2017 10:00:00' END"
    ),
    "src_raw": f"CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 13 = 1 THEN ' ' ELSE {SRC} END",
    "dst_raw": f"CASE WHEN l_partkey % 17 = 0 THEN '' ELSE {DST} END",
    "file": "concat('day_', cast(l_linenumber % 4 as string), '.csv')",
}

EVENTS = {
    "event_id": "event_id",
    "ts": "ts",
    "src": "concat('10.1.0.', cast(user_id as string))",
    "dst": "concat('10.1.0.', cast(event_id % 40 as string))",
    "label": "CASE WHEN event_type='view' THEN 'BENIGN' ELSE event_type END",
    "value": "value",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spec: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in spec.items()]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_select(FLOWS))


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty rows; the rows of line 3 come twice, so duplicates exist."""
    once = table(spark, sf_dir, "lineitem").selectExpr(*_select(RAW), "l_linenumber AS ln")
    return once.unionByName(once.filter("ln = 3")).drop("ln")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(EVENTS))


def _cte(name: str, spec: dict[str, str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(_select(spec))} FROM {source})"


FLOWS_CTE = _cte("flows", FLOWS, "lineitem")
RAW_CTE = (
    _cte("raw_once", RAW | {"ln": "l_linenumber"}, "lineitem")
    + ", raw AS (SELECT * EXCLUDE (ln) FROM raw_once UNION ALL SELECT * EXCLUDE (ln) FROM raw_once WHERE ln = 3)"
)
EVENTS_CTE = _cte("ev", EVENTS, "events")
INDEX_CTE = f"{FLOWS_CTE}, ix AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS i FROM flows)"
EVENT_INDEX_CTE = f"{EVENTS_CTE}, ix AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM ev)"


def label_sql(x: str) -> str:
    """DuckDB twin of the canonical label."""
    return (
        f"trim(regexp_replace(translate(replace(replace({x},'\u00c2',''),'\u200b',''),"
        f"'\u00a0\u2010\u2011\u2012\u2013\u2014\u2212',' ------'),'\\s+',' ','g'))"
    )


def number_sql(x: str) -> str:
    pattern = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN try_cast(trim({x}) AS double) END"


def time_sql(x: str) -> str:
    return f"coalesce(try_strptime({x}, '%d/%m/%Y %H:%M:%S'), try_strptime({x}, '%d/%m/%Y %H:%M'))"
