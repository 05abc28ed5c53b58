"""Risk summary and run choice."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import risk as r
from flowloom.plans.registry import query
from flowloom.plans.views import FLOWS_CTE, flows, table

_PRED = "CASE WHEN f_qty > 40 THEN 'DDoS' WHEN f_qty > 25 THEN label ELSE 'BENIGN' END"
_COUNTS = f"WITH {FLOWS_CTE}, c AS (SELECT source_file, {_PRED} AS pred_label, count(*) AS n FROM flows GROUP BY ALL)"


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).selectExpr("source_file", f"{_PRED} AS pred_label")


@query(_COUNTS + " SELECT pred_label, cast(sum(n) AS bigint) AS count FROM c GROUP BY pred_label")
def prediction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return r.prediction_counts(_predicted(spark, sf))


@query(
    _COUNTS + ", s AS (SELECT source_file, cast(sum(n) AS bigint) AS total_windows, "
    "cast(sum(n) FILTER (pred_label <> 'BENIGN') AS bigint) AS attack_windows, "
    "arg_min(pred_label, (-n, pred_label)) AS most_common, "
    "arg_min(pred_label, (-n, pred_label)) FILTER (pred_label <> 'BENIGN') AS top_attack, "
    "round(100 * sum(n) FILTER (pred_label <> 'BENIGN') / sum(n), 6) AS risk_score FROM c GROUP BY source_file) "
    "SELECT *, CASE WHEN risk_score < 10 THEN 'safe' WHEN risk_score < 40 THEN 'suspicious' ELSE 'high' END AS risk_level, "
    "CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 70 THEN 'medium' ELSE 'high' END AS gauge_band, "
    "CASE WHEN risk_score < 10 THEN 'Traffic appears normal. Continue routine monitoring.' "
    "WHEN risk_score < 40 THEN 'Potential attack indicators detected. Review suspicious traffic.' "
    "ELSE 'High attack activity detected. Immediate analyst investigation recommended.' END AS recommendation FROM s"
)
def risk_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r.risk_summary(_predicted(spark, sf), by=["source_file"]).withColumn("risk_score", F.round("risk_score", 6))


@query("SELECT event_id AS window_id, cast(event_type <> 'view' AS integer) AS attack_flag FROM events")
def attack_timeline(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").selectExpr(
        "event_id AS window_id", "CASE WHEN event_type = 'view' THEN 'benign' ELSE event_type END AS pred_label"
    )
    return r.attack_timeline(df)


_RUNS = (
    "SELECT concat(cast(conv_id AS string), CASE WHEN conv_id % 3 = 0 THEN '_binary' ELSE '' END) AS run_id, "
    "cast(CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 4 END AS integer) AS num_classes, turn, role FROM conversations"
)


@query(
    f"WITH runs AS ({_RUNS}), m AS (SELECT *, CASE WHEN num_classes = 2 OR run_id LIKE '%\\_binary' ESCAPE '\\' THEN 'binary' "
    "ELSE 'multi' END AS mode FROM runs) SELECT mode, max(run_id) AS run_id FROM m GROUP BY mode"
)
def latest_run_per_mode(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "conversations").selectExpr(
        "concat(cast(conv_id AS string), CASE WHEN conv_id % 3 = 0 THEN '_binary' ELSE '' END) AS run_id",
        "cast(CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 4 END AS int) AS num_classes",
    )
    return r.latest_runs(r.with_mode(runs)).select("mode", "run_id")


@query(
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn "
    "FROM conversations) WHERE rn = 1"
)
def latest_turn(spark: SparkSession, sf: str) -> DataFrame:
    last = F.max_by(F.struct("turn", "role"), F.struct("turn", "role", "text"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(last.alias("l")).select("conv_id", "l.*")
