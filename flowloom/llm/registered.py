"""The registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import bpe, chunks, containment, conversations, huffman, jaccard, lines, pieces, ppm, quality, sharding, spelling, suffixes
from flowloom.plans.registry import Query, Run

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register the function under its own name, apart from the library's other queries."""

    def register(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """A file of the installed public tokenizers."""
    return os.path.join(os.path.dirname(find_spec("public_tokenizers").origin), name)


@query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 16 shards."""
    return sharding.sharding_digest(documents(spark, sf_dir))


@query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that start at two places."""
    return suffixes.removal_digest(documents(spark, sf_dir))


@query()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return containment.containment_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that are linked by their 3-word shingles."""
    return jaccard.component_digest(documents(spark, sf_dir))


@query()
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a byte-context model and by word counts."""
    return ppm.scored(documents(spark, sf_dir), method="X", kinds=True)


@query()
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return quality.quality_digest(documents(spark, sf_dir))


@query()
def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that stood earlier."""
    return chunks.chunk_digest(documents(spark, sf_dir))


@query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without runs of lines, long lines and one-line texts that stood earlier."""
    return lines.line_digest(documents(spark, sf_dir), lines.ALONE)


@query()
def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of all documents."""
    vocabulary = pieces.read_pieces(tokenizer_file("piece_bpe_32k.model"))
    return pieces.piece_counts(documents(spark, sf_dir).select("doc_id", "text"), vocabulary).drop("text")


@query()
def op10_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the texts decoded from them, as digests."""
    return bpe.coding_digest(documents(spark, sf_dir), bpe.read_spec(tokenizer_file("byte_bpe_50k.json")))


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent words that they may misspell."""
    return spelling.variant_digest(documents(spark, sf_dir))


@query()
def op11_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in Huffman-coded blocks and read back."""
    return huffman.binary_digest(documents(spark, sf_dir), bpe.read_spec(tokenizer_file("word_bpe_49k.json")))


@query()
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return conversations.trie_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
