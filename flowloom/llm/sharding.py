"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (operator 1).

1. Every source partition permutes its rows locally: a local sort by a random key, no exchange.
2. For all pairs of source partition and shard, the number of rows that go from one to the other is drawn exactly as a
   uniform permutation of all rows would have it: multivariate hypergeometric draws without replacement from the
   shards' free places. Rows of a partition take shards by their place in the local permutation.
3. One exchange brings the rows to their shards, where they are permuted again. A shard is laid out in buckets of a
   second random key, so no task holds a whole shard.

The matrix has at most ``MAX_SOURCES`` rows and one column per shard; it is all that the driver draws and broadcasts.
Everything else is DataFrame functions. Nulls in any column, repeated rows and columns of any name are
kept as they are; an empty table gives an empty table. Rows are never compared, so ties do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.rows import free_name
from flowloom.scratch import stage

#: Source partitions at most; more input splits are joined without an exchange.
MAX_SOURCES = 4096
#: Rows of a shard that one task orders, about.
BUCKET_ROWS = 1 << 20
LEAST_BUCKETS = 8


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` draws without replacement are good; weights by their ratios around the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = 20 + int(12 * (draws * (good / total) * (bad / total)) ** 0.5)
    up = np.arange(mode, min(high, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each source to each shard; row sums are ``sources``, column sums ``shards``."""
    if sum(sources) != sum(shards):
        raise ValueError("sources and shards differ in size")
    rng = np.random.Generator(np.random.PCG64(seed))
    free, matrix = list(shards), []
    for rows in sources:
        left, others, line = rows, sum(free), []
        for places in free:
            others -= places
            took = hypergeometric(rng, places, others, left)
            line.append(took)
            left -= took
        free = [a - b for a, b in zip(free, line)]
        matrix.append(line)
    return matrix


def shard_rows(df: DataFrame, n_shards: int, seed: int = 1, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (the row's place in its shard, gapless from 0): a uniform shuffle of all rows.

    Shard sizes differ by one at most. The rows are written once to the shared folder, so that every later step sees the
    same partitions whatever executor is lost. A new column whose name is taken gets underscores in front.
    """
    shard, slot = free_name(df, shard), free_name(df, slot)
    spark = df.sparkSession
    part, key, place, cuts, bucket, before = (free_name(df, n) for n in ("part", "key", "place", "cuts", "bucket", "before"))
    local = (
        df.coalesce(MAX_SOURCES)
        .withColumn(place, F.monotonically_increasing_id())
        .withColumn(key, F.xxhash64(F.lit(seed), F.col(place)))
        .sortWithinPartitions(key, place)
        .withColumn(part, F.spark_partition_id())
        .withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    local = stage(local.drop(key), "sources")
    counts = sorted(map(tuple, local.groupBy(part).count().collect()))
    n = sum(c for _, c in counts)
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([c for _, c in counts], sizes, seed)
    ends = [(p, np.cumsum(line).tolist()) for (p, _), line in zip(counts, matrix)]
    ends = spark.createDataFrame(ends, f"`{part}` int, `{cuts}` array<bigint>")  # MAX_SOURCES rows at most
    buckets = max(LEAST_BUCKETS, -(-n // (n_shards * BUCKET_ROWS)))
    sent = (
        local.join(F.broadcast(ends), part)
        .withColumn(shard, F.size(F.filter(cuts, lambda c: c <= F.col(place))))
        .withColumn(key, F.xxhash64(F.lit(seed + 1), part, place))
        .withColumn(bucket, F.pmod(F.col(key), F.lit(buckets)).cast("int"))
        .drop(cuts)
    )
    through = Window.partitionBy(shard).orderBy(bucket)
    offsets = sent.groupBy(shard, bucket).agg(F.count("*").alias(before))
    offsets = offsets.withColumn(before, F.sum(before).over(through) - F.col(before))
    within = Window.partitionBy(shard, bucket).orderBy(key, part, place)
    return (
        sent.withColumn(slot, F.row_number().over(within).cast("long"))
        .join(offsets, [shard, bucket])
        .withColumn(slot, F.col(slot) - 1 + F.col(before))
        .select(*df.columns, shard, slot)
    )


def sharding_digest(documents: DataFrame, n_shards: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document under the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    digest = documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = shard_rows(digest, n_shards, seed)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
