"""Prototypes, few-shot episodes, window classifiers, prediction and model choice."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.operators import episodes as ep, evaluation, models as m, sampling as s
from flowloom.operators.artifacts import Artifacts
from flowloom.operators.features import fit_features
from flowloom.operators.lookup import label_index, label_map
from flowloom.operators.ordering import dense_index
from flowloom.operators.windows import Geometry
from flowloom.plans import flows as jobs
from flowloom.plans.registry import query
from flowloom.plans.views import EVENT_INDEX_CTE, TIE, event_flows, flows, table
from flowloom.scratch import scratch_path, stage
from flowloom.sources import runs

_CLASSES = list(range(10))
MEANS_CTE = (
    "e AS (SELECT vec_id, label, unnest(range(64)) AS pos, cast(unnest(embedding) AS double) AS v FROM embeddings), "
    "c AS (SELECT label, pos, avg(v) AS m FROM e GROUP BY label, pos), "
    "d AS (SELECT e.vec_id, e.label, c.label AS cls, -sqrt(sum((v - m) * (v - m))) AS score "
    "FROM e JOIN c USING (pos) GROUP BY e.vec_id, e.label, c.label)"
)


def scored_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors with their scores and predicted class; the prototypes come from the same table."""
    df = table(spark, sf, "embeddings")
    return m.Prototypes.fit(df, "embedding", "label", _CLASSES).predict(df, "embedding")


@query(f"WITH {MEANS_CTE} SELECT label, cast(pos AS integer) AS pos, round(m, 6) AS mean FROM c")
def class_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    means = m.class_means(table(spark, sf, "embeddings"), "embedding", "label")
    return means.select("label", "pos", F.round("mean", 6).alias("mean"))


@query(
    f"WITH {MEANS_CTE} SELECT vec_id, label, arg_max(cls, score) AS pred, round(max(score), 6) AS score FROM d GROUP BY vec_id, label"
)
def nearest_prototype(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_embeddings(spark, sf)
    return scored.select("vec_id", "label", "pred", F.round(F.array_max("scores"), 6).alias("score"))


@query(
    f"WITH {MEANS_CTE}, x AS (SELECT vec_id, cls, exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id) AS p FROM d) "
    "SELECT vec_id, cls, round(p, 6) AS p FROM x"
)
def class_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    scored = m.add_prediction(scored_embeddings(spark, sf), "scores", label_map(map(str, _CLASSES)))
    return scored.select("vec_id", F.posexplode_outer("probs").alias("cls", "p")).withColumn("p", F.round("p", 6))


@query(
    "WITH ways AS (SELECT label FROM (SELECT DISTINCT label FROM embeddings) ORDER BY md5('42|class|' || label), label LIMIT 5), "
    "r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS rn "
    "FROM embeddings WHERE label IN (SELECT label FROM ways)) "
    "SELECT vec_id, label, CASE WHEN rn <= 5 THEN 'support' ELSE 'query' END AS role FROM r WHERE rn <= 20"
)
def few_shot_episode(spark: SparkSession, sf: str) -> DataFrame:
    return m.few_shot_episode(table(spark, sf, "embeddings").select("vec_id", "label"), "label", ["vec_id"])


_EPISODES = 20
EPISODES_CTE = (
    f"ep AS (SELECT cast(unnest(range({_EPISODES})) AS integer) AS episode), "
    "ways AS (SELECT episode, label FROM (SELECT episode, label, row_number() OVER (PARTITION BY episode ORDER BY "
    "md5((42 + episode) || '|class|' || label), label) AS rn FROM ep, (SELECT DISTINCT label FROM embeddings)) WHERE rn <= 5), "
    "drawn AS (SELECT episode, vec_id, label, embedding, row_number() OVER (PARTITION BY episode, label ORDER BY "
    "md5((42 + episode) || '|' || vec_id), vec_id) AS rn FROM embeddings JOIN ways USING (label))"
)
EPISODE_SCORES_CTE = (
    f"{EPISODES_CTE}, xs AS (SELECT episode, vec_id, label, rn, unnest(range(64)) AS pos, cast(unnest(embedding) AS double) AS v FROM drawn WHERE rn <= 20), "
    "ctr AS (SELECT episode, label, pos, avg(v) AS m FROM xs WHERE rn <= 5 GROUP BY ALL), "
    "far AS (SELECT xs.episode, vec_id, xs.label, ctr.label AS cls, -sqrt(sum((v - m) * (v - m))) AS score FROM xs "
    "JOIN ctr ON ctr.episode = xs.episode AND ctr.pos = xs.pos WHERE rn > 5 GROUP BY ALL), "
    "best AS (SELECT episode, vec_id, label, arg_max(cls, score) AS pred, max(score) AS score FROM far GROUP BY ALL)"
)


def _drawn(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return ep.draw_episodes(table(spark, sf, "embeddings").select("vec_id", "label", *columns), "label", ["vec_id"], _EPISODES)


def _scored_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return ep.score_episodes(_drawn(spark, sf, "embedding"), "embedding", "label", ["vec_id"])


@query(
    f"WITH {EPISODES_CTE} SELECT episode, vec_id, label, CASE WHEN rn <= 5 THEN 'support' ELSE 'query' END AS role FROM drawn WHERE rn <= 20"
)
def few_shot_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Support and query rows of twenty episodes."""
    return _drawn(spark, sf)


@query(f"WITH {EPISODE_SCORES_CTE} SELECT episode, vec_id, label, pred, round(score, 6) AS score FROM best")
def few_shot_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every query row under the centroids of its own episode."""
    return _scored_episodes(spark, sf).withColumn("score", F.round("score", 6))


@query(
    f"WITH {EPISODE_SCORES_CTE} SELECT episode, count(*) AS queries, round(avg((pred = label)::int), 6) AS accuracy FROM best GROUP BY episode"
)
def few_shot_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    scores = ep.episode_accuracy(_scored_episodes(spark, sf), "label")
    return scores.withColumn("accuracy", F.round("accuracy", 6))


@query(
    f"WITH {EPISODE_SCORES_CTE}, a AS (SELECT episode, avg((pred = label)::int) AS accuracy FROM best GROUP BY episode) "
    "SELECT count(*) AS episodes, round(avg(accuracy), 6) AS mean, round(1.96 * stddev_samp(accuracy) / sqrt(count(*)), 6) AS half_width FROM a"
)
def few_shot_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Mean accuracy over the episodes and the half-width of its interval."""
    found = ep.accuracy_over_episodes(ep.episode_accuracy(_scored_episodes(spark, sf), "label"))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "half_width")})


@query(
    "WITH h AS (SELECT o_orderstatus AS run, cast(o_orderkey % 50 AS integer) AS epoch, round(avg(o_totalprice), 4) AS val_acc "
    "FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_acc DESC, epoch) AS rn FROM h) "
    "SELECT run, epoch, val_acc FROM r WHERE rn = 1"
)
def best_epoch_per_run(spark: SparkSession, sf: str) -> DataFrame:
    history = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderstatus").alias("run"), (F.col("o_orderkey") % 50).cast("int").alias("epoch"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("val_acc"))
    )
    return m.best_epoch(history, ["run"])


def _event_vectors(spark: SparkSession, sf: str) -> DataFrame:
    ix = dense_index(event_flows(spark, sf), ["ts", "event_id"], name="events")
    return stage(jobs.build_window_vectors(ix, ["value"], "src", "dst", "label"), "window-vectors")


_EVENT_LABELS = label_map(["BENIGN", "click", "error", "purchase", "signup"])


def _split_events(spark: SparkSession, sf: str) -> DataFrame:
    """Window vectors of the events in time blocks: about twenty, of at least 200 windows."""
    vectors = _event_vectors(spark, sf)
    return s.split_by_blocks(vectors, Geometry(), max(200, vectors.count() // 20))


@query(
    f"WITH {EVENT_INDEX_CTE}, w AS (SELECT i AS window_id FROM ix WHERE i < (SELECT greatest(1, count(*) - 96) FROM ix)), "
    "t AS (SELECT greatest(200, count(*) // 20) AS size FROM w), "
    "b AS (SELECT window_id, size, window_id // size AS block, window_id % size AS inside FROM w, t) "
    "SELECT window_id, CASE WHEN block % 5 = 4 THEN 'val' ELSE 'train' END AS split FROM b WHERE block % 5 = 4 "
    "OR NOT ((block % 5 = 3 AND inside + 96 > size) OR (block > 0 AND block % 5 = 0 AND inside < 96))"
)
def embargoed_split(spark: SparkSession, sf: str) -> DataFrame:
    """Training and validation windows that share no flow."""
    return _split_events(spark, sf).select("window_id", "split")


@query()
def window_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression on the training blocks: predicted against true labels of the validation blocks."""
    scored = m.fit_and_validate(_split_events(spark, sf), _EVENT_LABELS, maxIter=10)[1]
    return scored.groupBy("label", "pred_label").agg(F.count("*").alias("windows"))


@query()
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Classification report of the same classifier over the validation blocks."""
    scored = m.fit_and_validate(_split_events(spark, sf), _EVENT_LABELS, maxIter=10)[1]
    pairs = scored.withColumn("true_idx", label_index(F.col("label"), _EVENT_LABELS))
    matrix = evaluation.confusion(pairs, "true_idx", "pred_idx", sorted(_EVENT_LABELS.values()))
    return evaluation.classification_report(matrix)


@query()
def cross_validated_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Regularisation chosen by cross-validation over time blocks of the event windows."""
    vectors = _event_vectors(spark, sf)
    folds = s.fold_by_blocks(vectors, Geometry(), max(150, vectors.count() // 12), 3)
    return m.cross_validate(folds, _EVENT_LABELS, {"regParam": [1e-4, 1e-2], "maxIter": [5]})[1]


@query()
def registered_run_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs are stored, the latest is loaded, and the validation blocks are scored with it."""
    split, root = _split_events(spark, sf), scratch_path(spark, "runs")
    art = Artifacts(["value"], {}, {"value": 0.0}, {"value": 1.0})
    for run_id, rounds in (("20240101-000000", 1), ("20240102-000000", 10)):
        model = m.fit_and_validate(split, _EVENT_LABELS, maxIter=rounds)[0]
        runs.save_run(spark, root, run_id, model, art, _EVENT_LABELS, ["value"])
    run = runs.load_latest(spark, root, "multi", ["value"], list(_EVENT_LABELS))
    scored = m.score_windows(split.filter("split = 'val'"), run.model, run.label2idx)
    return scored.groupBy(F.lit(run.run_id).alias("run_id"), "label", "pred_label").agg(F.count("*").alias("windows"))


@query()
def training_loss(spark: SparkSession, sf: str) -> DataFrame:
    model = m.fit_window_classifier(_event_vectors(spark, sf), _EVENT_LABELS, maxIter=10)
    return m.loss_history(spark, model)


_FLOW_LABELS = label_map(["BENIGN", "Bot", "DDoS", "DoS Hulk", "PortScan"])
_COLUMNS = {
    "ts": "Timestamp", "src": "Source IP", "dst": "Destination IP", "label": "Label", "source_file": "SourceFile",
    "f_qty": "Flow Bytes/s", "f_price": "Flow Packets/s",
}
_MODEL_FEATURES = ["Flow Bytes/s", "Flow Packets/s"]


def _trained(spark: SparkSession, sf: str) -> tuple[DataFrame, Artifacts, object]:
    raw = flows(spark, sf).select(*_COLUMNS, "ok", "ln", "pk", "sk").withColumnsRenamed(_COLUMNS)
    art = fit_features(raw.select(*_MODEL_FEATURES), exact_medians=True)
    ready = jobs.prepare_for_scoring(raw, art, ["ok", "ln", "pk", "sk"], "2024-01-01 00:00:00")
    ix = jobs.index_flows(ready, ["ok", "ln", "pk", "sk", *_MODEL_FEATURES])
    vectors = jobs.build_window_vectors(ix, _MODEL_FEATURES, "Source IP", "Destination IP", "Label")
    return raw, art, m.fit_window_classifier(vectors, _FLOW_LABELS, maxIter=5)


@query()
def score_new_table(spark: SparkSession, sf: str) -> DataFrame:
    """A raw table through cleaning, windows and model to predicted label counts."""
    raw, art, model = _trained(spark, sf)
    scored = jobs.score_table(
        raw, art, model, _MODEL_FEATURES, _FLOW_LABELS, [c for c in TIE if not c.startswith("f_")], "2024-01-01 00:00:00"
    )
    return scored.windows.groupBy("pred_label").agg(F.count("*").alias("windows"))


@query()
def cross_dataset_report(spark: SparkSession, sf: str) -> DataFrame:
    """The flow model evaluated on the event table, seen as another capture without endpoints."""
    _, art, model = _trained(spark, sf)
    other = table(spark, sf, "events").selectExpr(
        "event_id", "ts AS Timestamp", "value AS `Flow Byts/s`", "'events.csv' AS SourceFile",
        "CASE event_type WHEN 'view' THEN 'Benign' WHEN 'click' THEN 'DDOS attack-HOIC' "
        "WHEN 'error' THEN 'DoS attacks-Hulk' ELSE 'Infilteration' END AS Label",
    )
    return jobs.evaluate_across(
        other, art, model, _MODEL_FEATURES, _FLOW_LABELS, ["event_id"], "2024-01-01 00:00:00",
    )
