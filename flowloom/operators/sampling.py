"""Reproducible sampling, class balancing and splits.

Random order means order by ``md5(seed|key)``. Exact quotas are met without
sorting a class as a whole: bucket counts locate the bucket in which a class
reaches its quota, only that bucket is ranked, and the last admitted key per
class becomes a filter on the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.fixed_values import ATTACK, BENIGN, LABEL, SEED, SOURCE_FILE
from flowloom.functions.labels import is_benign, label_key, label_key_text
from flowloom.functions.ordering import hash_share, random_key
from flowloom.functions.values import named
from flowloom.operators.lookup import join_counted, lookup_literal
from flowloom.operators.ordering import dense_index
from flowloom.operators.windows import Geometry

# Leading hex digits of the random key that form a bucket: 65,536 buckets.
BUCKET_DIGITS = 4
ROWS_PER_POSITION_BUCKET = 65_536


def last_admitted(
    df: DataFrame, group: str, quotas: Mapping, levels: Sequence[Column], order: Column
) -> DataFrame:
    """``(group, last)``: the ``quota``-th smallest ``order`` value of each group that has so many rows.

    ``levels`` are ever finer buckets that agree with ``order``. Each level
    counts rows per bucket and goes on with the one bucket per group in which
    the quota is reached.
    """
    quota = lookup_literal(F.col(group), quotas, F.lit(None).cast("int")).cast("long")
    rest = df.withColumn("_left", quota).filter("_left > 0")
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    for level in levels:
        rest = rest.withColumn("_bucket", level)
        counts = rest.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.first("_left").alias("_left"))
        crossing = (
            counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .filter("_before < _left AND _left <= _before + _n")
            .select(group, "_bucket", (F.col("_left") - F.col("_before")).alias("_left"))
        )
        # One bucket per group in the caller's quotas.
        rest = rest.drop("_left").join(F.broadcast(crossing), [group, "_bucket"]).drop("_bucket")
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_order"))
    return (
        rest.select(group, "_left", order.alias("_order"))
        .withColumn("_rank", rank)
        .filter("_rank = _left")
        .select(group, F.col("_order").alias("last"))
    )


def take_first(df: DataFrame, group: str, quotas: Mapping, levels: Sequence[Column], order: Column) -> DataFrame:
    """The first ``quota`` rows of each listed group; other groups and short groups stay whole."""
    empty = [g for g, q in quotas.items() if q <= 0]
    if empty:
        df = df.filter(~F.coalesce(F.col(group).isin(empty), F.lit(False)))
    last = last_admitted(df, group, quotas, levels, order)
    return (
        df.join(F.broadcast(last), group, "left")
        .filter(F.col("last").isNull() | (order <= F.col("last")))
        .select(*[named(c) for c in df.columns])
    )


def _random_order(seed: int, key: Sequence[str]) -> tuple[list[Column], Column]:
    drawn = random_key(seed, *key)
    return [F.substring(drawn, 1, BUCKET_DIGITS)], F.struct(drawn.alias("r"), *[F.col(k) for k in key])


def cap_classes(
    df: DataFrame, quotas: Mapping[str, int], key: Sequence[str], label: str = LABEL, seed: int = SEED
) -> DataFrame:
    """At most ``quota`` random rows of each listed class, all rows of the others."""
    levels, order = _random_order(seed, key)
    return take_first(df, label, quotas, levels, order)


def cap_benign(
    df: DataFrame, rows: int, key: Sequence[str], label: str = LABEL, seed: int = SEED
) -> DataFrame:
    """Balanced evaluation set: ``rows`` random benign rows and every attack."""
    tagged = df.withColumn("_class", F.when(label_key(label) == label_key_text(BENIGN), BENIGN).otherwise(ATTACK))
    levels, order = _random_order(seed, key)
    return take_first(tagged, "_class", {BENIGN: rows}, levels, order).drop("_class")


def sample_rows(df: DataFrame, rows: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly ``rows`` random rows, or all of them when there are fewer."""
    if rows <= 0:
        return df.limit(0)
    levels, order = _random_order(seed, key)
    last = last_admitted(df.withColumn("_all", F.lit(0)), "_all", {0: rows}, levels, order)
    limit = last.select("last").scalar()
    return df.filter(limit.isNull() | (order <= limit))


def first_of_each(
    df: DataFrame,
    n_benign: int,
    n_attack: int,
    file: str = SOURCE_FILE,
    position: str = "row_index",
    label: str = LABEL,
    check: bool = True,
) -> DataFrame:
    """The first benign and the first attack rows in file order; an error when either is short."""
    quotas = {BENIGN: n_benign, ATTACK: n_attack}
    tagged = df.withColumn("_class", F.when(F.coalesce(is_benign(label), F.lit(False)), BENIGN).otherwise(ATTACK))
    if check:
        found = {r["_class"]: r["n"] for r in tagged.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = {c: f"{found.get(c, 0)}/{q}" for c, q in quotas.items() if found.get(c, 0) < q}
        if short:
            raise ValueError(f"not enough rows: {short}")
    levels = [F.col(file), F.floor(F.col(position) / ROWS_PER_POSITION_BUCKET)]
    return take_first(tagged, "_class", quotas, levels, F.struct(file, position)).drop("_class")


def stratified_sample(
    df: DataFrame,
    rows: int,
    classes: Sequence[str],
    key: Sequence[str],
    label: str = LABEL,
    seed: int = SEED,
    max_classes: int | None = None,
) -> DataFrame:
    """``rows // classes`` random rows of each of the classes (the first ``max_classes`` if given), no row twice."""
    quota = max(1, rows // max(1, len(classes)))
    chosen = list(classes)[:max_classes]
    return cap_classes(df.filter(F.col(label).isin(chosen)), dict.fromkeys(chosen, quota), key, label, seed)


def draw_with_replacement(df: DataFrame, rows: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """``rows`` uniform draws with repetition, numbered by ``draw``; empty for an empty table."""
    ix = dense_index(df, [random_key(seed, *key), *key], index="_i", name="draws")
    if ix.n == 0:
        return ix.df.withColumnRenamed("_i", "draw")
    digits = F.conv(F.substring(random_key(seed, F.lit("draw"), F.col("draw")), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(rows).withColumnRenamed("id", "draw").withColumn("_i", F.pmod(digits, F.lit(ix.n)))
    return join_counted(ix.df, draws, rows, "_i", "inner").drop("_i")


def shuffle(df: DataFrame, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Global shuffle: a range sort on the random key."""
    return df.orderBy(random_key(seed, *key), *key)


def split(
    df: DataFrame, key: Sequence[str], train_share: float = 0.8, seed: int = SEED, out: str = "split"
) -> DataFrame:
    """Marks rows ``train`` or ``val`` by hash: no shuffle, same answer in every run."""
    return df.withColumn(
        out, F.when(hash_share(seed, *key) < int(train_share * 10_000), "train").otherwise("val")
    )


def split_by_time(
    windows: DataFrame, count: int, gap: int, train_share: float = 0.8, window: str = "window_id", out: str = "split"
) -> DataFrame:
    """Earlier windows train, later ones validate; windows within ``gap`` of the cut are left out.

    Overlapping windows share flows, so a random split leaks; a gap of the
    window length does not.
    """
    cut = int(count * train_share)
    w = F.col(window)
    return windows.withColumn(out, F.when(w < cut - gap, "train").when(w >= cut, "val")).filter(
        F.col(out).isNotNull()
    )


def split_by_blocks(
    windows: DataFrame,
    g: Geometry,
    block: int,
    every: int = 5,
    embargo: int | None = None,
    window: str = "window_id",
    out: str = "split",
) -> DataFrame:
    """Marks windows ``train`` or ``val`` by time block; the last of ``every`` blocks of ``block`` windows validates.

    Windows of stride one share nearly all their flows with their neighbours, so a random split tests on what was trained.
    Training windows that start within ``embargo`` flows (``seq_len + graph_size`` unless given) of a validation block are left
    out on both sides; no flow is then seen by both. A projection: no shuffle, and every validating block has training blocks around it.
    """
    reach = g.seq_len + g.graph_size if embargo is None else embargo
    length = block * g.stride
    if length <= 2 * reach or every < 2:
        raise ValueError(f"blocks of {length} flows leave no training windows beside an embargo of {reach}")
    start = F.col(window) * g.stride
    number, inside = F.floor(start / length), F.pmod(start, F.lit(length))

    def validates(at: Column) -> Column:
        return (at >= 0) & (F.pmod(at, F.lit(every)) == every - 1)

    purged = (validates(number + 1) & (inside + reach > length)) | (validates(number - 1) & (inside < reach))
    side = F.when(validates(number), "val").when(~purged, "train")
    return windows.withColumn(out, side).filter(F.col(out).isNotNull())


def fold_by_blocks(
    windows: DataFrame, g: Geometry, block: int, folds: int, embargo: int | None = None, window: str = "window_id", out: str = "fold"
) -> DataFrame:
    """Adds the fold 0, 1, ... of each window: time blocks of ``block`` windows in turn.

    Windows that start within ``embargo`` flows (``seq_len + graph_size`` unless given) before the end of a block are left out, so no flow
    is in two folds.
    """
    reach = g.seq_len + g.graph_size if embargo is None else embargo
    length = block * g.stride
    if length <= reach or folds < 2:
        raise ValueError(f"blocks of {length} flows leave no windows beside an embargo of {reach}")
    start = F.col(window) * g.stride
    inside = F.pmod(start, F.lit(length)) + reach <= length
    return windows.filter(inside).withColumn(out, F.pmod(F.floor(start / length), F.lit(folds)).cast("int"))


def shift_features(df: DataFrame, features: Sequence[str], scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """Affine change of the chosen features."""
    return df.withColumns({f: named(f) * F.lit(scale) + F.lit(shift) for f in features})
