"""Cleaning a corpus in five stages, each written as Parquet and read again as the next one's documents.

Quality rules, line deduplication, near-duplicate removal, benchmark decontamination, BPE coding. All but the last
return the columns of documents; the last adds ``token_ids`` (packed little-endian unsigned 32-bit integers) and ``decoded``.
Null and empty texts fail the quality rules; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import bpe, containment, jaccard, lines, quality
from flowloom.llm.registered import documents, tokenizer_file
from flowloom.scratch import release, stage, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules think good."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines, long lines and one-line texts that stood earlier; those left without any line go. ``n_chars`` follows the text."""
    out = lines.dedup_lines(docs)
    n_lines, n_removed, _ = out.columns[-3:]
    kept = out.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard.keep_one_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    return containment.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the texts decoded from them."""
    return bpe.encode_and_decode(docs, bpe.read_spec(tokenizer_file("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_coding", bpe_coding),
]
#: Expectation-maximisation and BPE are beyond SQL; tests compare the operators of the stages with plain calculations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage staged, and its input, goes when its result is written."""
    docs, first = documents(spark, sf_dir), written()
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        release(spark, first, written() - 1)
    return docs
