"""Incremental jobs run to completion; their results equal the batch ones."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators.artifacts import Artifacts
from flowloom.operators.ordering import dense_index
from flowloom.operators.profile import value_counts
from flowloom.operators import sketches as sk
from flowloom.operators.rows import attacks_only
from flowloom.operators.windows import Geometry
from flowloom.plans.registry import query
from flowloom.plans.views import EVENTS_CTE, FLOWS_CTE, FLOWS, _select, event_flows, table
from flowloom.scratch import scratch_path
from flowloom.streaming import incremental as inc, replace, windows as live


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return inc.read_parquet_stream(spark, sf, schema, f"{name}.parquet")


def _flow_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, "lineitem").selectExpr(*_select(FLOWS))


@query(f"WITH {FLOWS_CTE} SELECT row_key, label, f_qty FROM flows WHERE label <> 'BENIGN'")
def streamed_attacks(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = scratch_path(spark, "attacks"), scratch_path(spark, "attacks-checkpoint")
    stream = _flow_stream(spark, sf).select("row_key", "label", "f_qty")
    inc.run(inc.materialize_attacks, stream, out, checkpoint, "label")
    return spark.read.parquet(out)


@query(f"WITH {FLOWS_CTE} SELECT label, count(*) AS count FROM flows GROUP BY label")
def streamed_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "counts-checkpoint")
    inc.run(inc.running_label_counts, _flow_stream(spark, sf).select("label"), out, checkpoint, "label")
    return spark.read.parquet(out)


@query(
    f"WITH {FLOWS_CTE} SELECT round((f_qty - 25.5) / 14.25, 6) AS f_qty, round((coalesce(f_disc, 0.05) - 0.05) / 0.03, 6) AS f_disc, "
    'label AS "Label", source_file AS "SourceFile" FROM flows'
)
def streamed_clean_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Stored medians and scaling applied chunk by chunk."""
    art = Artifacts(
        ["f_qty", "f_disc"], {"f_disc": 0.05}, {"f_qty": 25.5, "f_disc": 0.05}, {"f_qty": 14.25, "f_disc": 0.03}
    )
    out, checkpoint = scratch_path(spark, "chunks"), scratch_path(spark, "chunks-checkpoint")
    stream = _flow_stream(spark, sf).selectExpr(
        "cast(f_qty AS string) AS f_qty", "f_disc", "label AS Label", "source_file AS SourceFile"
    )
    inc.run(inc.clean_and_append, stream, art, out, checkpoint)
    return spark.read.parquet(out).withColumns({c: F.round(c, 6) for c in ("f_qty", "f_disc")})


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_deduplication(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats of a user and event type are dropped within a horizon longer than the table's time span."""
    out, checkpoint = scratch_path(spark, "dedup"), scratch_path(spark, "dedup-checkpoint")
    stream = _stream(spark, sf, "events").select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    inc.run(inc.deduplicate, stream, ["user_id", "event_type"], "ts", "400 days", out, checkpoint)
    return spark.read.parquet(out).select("user_id", "event_type")


@query(f"WITH {FLOWS_CTE} SELECT row_key, label, f_qty FROM flows WHERE label <> 'BENIGN'")
def refreshed_attacks(spark: SparkSession, sf: str) -> DataFrame:
    """Attack rows of a folder that grows between two refreshes; the second reads the new files alone."""
    folder, out = scratch_path(spark, "captures"), scratch_path(spark, "refreshed")
    rows = table(spark, sf, "lineitem").selectExpr(*_select(FLOWS), "l_orderkey % 2 AS half").select("row_key", "label", "f_qty", "half")
    for half in (0, 1):
        rows.where(F.col("half") == half).drop("half").write.mode("append").parquet(folder)
        replace.refresh(spark, folder, out, lambda s, paths: s.read.parquet(*paths), lambda df: attacks_only(df, label="label"), "*.parquet")
    return replace.read_rows(spark, out).drop(replace.FILE)


_SKETCHED = ["f_qty", "f_price", "f_disc"]
_SKETCHED_SQL = (
    "SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS count, count(*) - count({c}) AS missing, "
    "{mean} AS mean, {std} AS std, {low} AS min, {high} AS max FROM flows"
)


def _sketched_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of a folder that grows between two refreshes; the second sketches the new files alone."""
    folder, out = scratch_path(spark, "captures"), scratch_path(spark, "sketches")
    rows = table(spark, sf, "lineitem").selectExpr(*_select(FLOWS), "l_orderkey % 2 AS half").select("label", *_SKETCHED, "half")
    for half in (0, 1):
        rows.where(F.col("half") == half).drop("half").write.mode("append").parquet(folder)
        replace.refresh(
            spark, folder, out, lambda s, paths: s.read.parquet(*paths),
            lambda df: sk.file_sketches(df, replace.FILE, _SKETCHED, ["label"]), "*.parquet",
        )
    return sk.merged_profile(replace.read_rows(spark, out))


@query(
    f"WITH {FLOWS_CTE} " + " UNION ALL ".join(
        [_SKETCHED_SQL.format(c=c, mean=f"round(avg({c}), 4)", std=f"round(stddev_samp({c}), 4)", low=f"min({c})", high=f"max({c})")
         for c in _SKETCHED]
        + [_SKETCHED_SQL.format(c="label", mean="NULL", std="NULL", low="NULL", high="NULL")]
    )
)
def sketched_profile(spark: SparkSession, sf: str) -> DataFrame:
    """What merges exactly: counts, missing values, moments and extremes."""
    merged = _sketched_profile(spark, sf).select("column", "rows", "count", "missing", "mean", "std", "min", "max")
    return merged.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    f"WITH {FLOWS_CTE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS exact, true AS within FROM flows" for c in [*_SKETCHED, "label"]
    )
)
def sketched_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact distinct counts, and whether the merged sketches are within their stated error."""
    df = table(spark, sf, "lineitem").selectExpr(*_select(FLOWS))
    exact = value_counts(df, [*_SKETCHED, "label"]).groupBy("column").agg(F.count(F.lit(1)).alias("exact"))
    off = F.abs(F.col("distinct") - F.col("exact"))
    found = _sketched_profile(spark, sf).select("column", "distinct").join(exact, "column")
    return found.select("column", "exact", (off <= F.lit(sk.DISTINCT_ERROR) * F.col("exact")).alias("within"))


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", cast({p} AS double) AS p, true AS within" for c in _SKETCHED for p in (0.25, 0.5, 0.75))
)
def sketched_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the true rank of every merged quantile is within the stated error of the one asked for."""
    at = (0.25, 0.5, 0.75)
    probabilities = F.array(*[F.lit(p) for p in at])
    asked = (
        _sketched_profile(spark, sf).where("quantiles IS NOT NULL")
        .select("column", F.posexplode("quantiles").alias("_k", "value")).withColumn("p", F.get(probabilities, F.col("_k")))
    )  # one row per column and probability
    df = table(spark, sf, "lineitem").selectExpr(*_select(FLOWS)).select(*_SKETCHED)
    values = df.unpivot([], _SKETCHED, "column", "v").where("v IS NOT NULL")
    ranks = values.join(F.broadcast(asked), "column").groupBy("column", "p").agg(
        F.avg((F.col("v") < F.col("value")).cast("double")).alias("below"),
        F.avg((F.col("v") <= F.col("value")).cast("double")).alias("up_to"),
    )
    error = F.lit(sk.RANK_ERROR)
    return ranks.select("column", "p", ((F.col("p") >= F.col("below") - error) & (F.col("p") <= F.col("up_to") + error)).alias("within"))


# Three captures of the events; each arrives in parts, and the job is stopped and started again between them.
_CAPTURE = "concat('capture_', cast(event_id % 3 as string))"
_LIVE = Geometry(seq_len=16, graph_size=32, stride=8)
_LIVE_CTE = (
    f"{EVENTS_CTE}, cap AS (SELECT *, {_CAPTURE} AS capture FROM ev), "
    "ix AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM cap), "
    "win AS (SELECT capture, i // 8 AS window_id, i AS start FROM ix WHERE i % 8 = 0 AND i < n - 48)"
)


def _arriving(spark: SparkSession, sf: str, parts: int, start) -> DataFrame:
    """The result of a streaming job over the events, in ``parts`` time spans with a restart between them."""
    ix = dense_index(event_flows(spark, sf).selectExpr("*", f"{_CAPTURE} AS capture"), ["ts", "event_id"], name="events")
    folder, out, checkpoint = (scratch_path(spark, name) for name in ("arriving", "live", "live-checkpoint"))
    for k in range(parts):
        span = ix.df.where((F.col("i") * parts >= k * ix.n) & (F.col("i") * parts < (k + 1) * ix.n))
        span.drop("i").write.mode("append").parquet(folder)
        stream = inc.read_parquet_stream(spark, folder, ix.df.drop("i").schema)
        inc.run(inc.append_table, start(stream), out, checkpoint)
    return spark.read.parquet(out)


@query(
    f"WITH {_LIVE_CTE}, m AS (SELECT capture, i AS start, sum(value) OVER (PARTITION BY capture ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) / 16 AS v, "
    "lead(label, 8) OVER (PARTITION BY capture ORDER BY i) AS label FROM ix) "
    "SELECT capture, window_id, label, round(v, 6) AS value FROM win JOIN m USING (capture, start)"
)
def streamed_window_means(spark: SparkSession, sf: str) -> DataFrame:
    """Window means of captures that arrive in three parts."""
    means = _arriving(spark, sf, 3, lambda s: live.stream_window_means(s, "capture", ["ts", "event_id"], "label", ["value"], _LIVE))
    return means.withColumn("value", F.round("value", 6))


@query(
    f"WITH {_LIVE_CTE}, fr AS (SELECT win.capture, window_id, p, i, src, dst FROM win, (SELECT unnest(range(32)) AS p) "
    "JOIN ix ON ix.i = start + p AND ix.capture = win.capture), "
    "seen AS (SELECT capture, window_id, src AS host, p AS o FROM fr UNION ALL SELECT capture, window_id, dst, 32 + p FROM fr), "
    "hosts AS (SELECT capture, window_id, host, min(o) AS o FROM seen WHERE host IS NOT NULL GROUP BY ALL), "
    "nodes AS (SELECT capture, window_id, host, row_number() OVER (PARTITION BY capture, window_id ORDER BY o) - 1 AS node FROM hosts) "
    "SELECT capture, window_id, cast(row_number() OVER (PARTITION BY capture, window_id ORDER BY i) - 1 AS integer) AS edge_pos, "
    "cast(s.node AS integer) AS src_node, cast(d.node AS integer) AS dst_node, i AS flow_idx FROM fr "
    "JOIN nodes s USING (capture, window_id) JOIN nodes d USING (capture, window_id) WHERE s.host = src AND d.host = dst"
)
def streamed_window_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Window edges of captures that arrive in two parts."""
    return _arriving(spark, sf, 2, lambda s: live.stream_window_edges(s, "capture", ["ts", "event_id"], "src", "dst", _LIVE))
