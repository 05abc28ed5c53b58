"""Many few-shot episodes in one plan: draws, centroids per episode, scored queries, accuracy.

An episode draws ``n_way`` classes, ``k_shot`` support rows and ``n_query`` query rows per class. Episodes are independent and
follow from their seed alone. Nothing here grows with the table but its one scan: a row is copied into the episodes that chose its class,
and each partition keeps the few rows wanted per episode and class before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.fixed_values import K_SHOT, N_QUERY, N_WAY, SEED
from flowloom.functions.vectors import euclidean

EPISODE = "episode"


def _seeded(seed: int, *keys: Column | str) -> Column:
    """The random key of a row under the seed of its episode."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", (F.lit(seed) + F.col(EPISODE)).cast("string"), *parts))


def draw_episodes(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    episodes: int,
    n_way: int = N_WAY,
    k_shot: int = K_SHOT,
    n_query: int = N_QUERY,
    seed: int = SEED,
) -> DataFrame:
    """``(episode, role, *columns)``: support and query rows of ``episodes`` episodes, numbered from 0.

    Episode 0 draws what ``few_shot_episode`` draws under the same seed. ``key`` must identify a row. Rows without a
    label are never drawn; a class with fewer rows fills its support first.
    """
    if episodes < 1:
        raise ValueError("episodes must be positive")
    classes = df.select(label).dropna().distinct()
    by_class = Window.partitionBy(EPISODE).orderBy(_seeded(seed, F.lit("class"), label), label)
    ways = (
        classes.withColumn(EPISODE, F.explode(F.sequence(F.lit(0), F.lit(episodes - 1))))
        .withColumn("_rank", F.row_number().over(by_class))
        .filter(F.col("_rank") <= n_way)
        .groupBy(label)
        .agg(F.collect_list(EPISODE).alias("_episodes"))  # at most the number of episodes
    )
    by_row = Window.partitionBy(EPISODE, label).orderBy(_seeded(seed, *key), *key)
    picked = (
        df.select(label, *[k for k in key if k != label])
        .join(ways, label)
        .withColumn(EPISODE, F.explode("_episodes"))
        .withColumn("_rank", F.row_number().over(by_row))
        .filter(F.col("_rank") <= k_shot + n_query)
        .select(EPISODE, F.when(F.col("_rank") <= k_shot, "support").otherwise("query").alias("role"), *key)
    )
    return picked.join(df, list(key)).select(EPISODE, "role", *df.columns)


def episode_centres(drawn: DataFrame, vector: str, label: str) -> DataFrame:
    """``(episode, label, centre)``: the mean support vector of each class of each episode."""
    return (
        drawn.filter(F.col("role") == "support")
        .select(EPISODE, label, F.posexplode(vector).alias("_pos", "_v"))
        .groupBy(EPISODE, label, "_pos")
        .agg(F.avg(F.col("_v").cast("double")).alias("_mean"))
        .groupBy(EPISODE, label)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))), lambda p: p["_mean"]).alias("centre"))
    )


def score_episodes(drawn: DataFrame, vector: str, label: str, key: Sequence[str]) -> DataFrame:
    """``(episode, *key, label, pred, score)`` per query row: the nearest centroid of its own episode, the smaller class on ties."""
    centres = episode_centres(drawn, vector, label).withColumnRenamed(label, "_class")
    own = [k for k in key if k != label]
    queries = drawn.filter(F.col("role") == "query").select(EPISODE, *own, label, vector)
    nearest = F.min_by(F.struct("_class", "_far"), F.struct("_far", "_class"))
    return (
        queries.join(centres, EPISODE)
        .withColumn("_far", euclidean(F.col(vector), F.col("centre")))
        .groupBy(EPISODE, *own, label)
        .agg(nearest.alias("_best"))
        .select(EPISODE, *own, label, F.col("_best._class").alias("pred"), (-F.col("_best._far")).alias("score"))
    )


def episode_accuracy(scored: DataFrame, label: str) -> DataFrame:
    """``(episode, queries, accuracy)``."""
    hit = (F.col("pred") == F.col(label)).cast("double")
    return scored.groupBy(EPISODE).agg(F.count(F.lit(1)).alias("queries"), F.avg(hit).alias("accuracy"))


def accuracy_over_episodes(accuracy: DataFrame) -> DataFrame:
    """``(episodes, mean, half_width)``: the mean accuracy and the half-width of its 95 % interval (null for one episode)."""
    n = F.count(F.lit(1))
    half = F.lit(1.96) * F.stddev_samp("accuracy") / F.sqrt(n)
    return accuracy.agg(n.alias("episodes"), F.avg("accuracy").alias("mean"), half.alias("half_width"))
