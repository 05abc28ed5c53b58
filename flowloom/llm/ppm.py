"""Language-model scoring by prediction by partial matching (operator 5).

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of what followed in the training texts,
pretrained on all of them. A byte's probability comes from the longest context that it was seen in: every longer one
gives its escape probability, and its symbols are excluded below. Method C estimates the escape by the number of distinct symbols, method
X by the number of those seen once, and one more. With ``kinds`` (update exclusion), the contexts below the longest count in how
many different longer contexts a symbol followed, not how often. The shortest context is the uniform one. Every text has an end symbol and starts after ``ORDER`` newlines.

A byte's probability is a function of the ``ORDER + 1`` bytes that end with it. Documents are dealt into blocks of bounded
size; a block asks once for each of its distinct strings and words. Spark sums the counts, joins a context with its
suffixes, and sends each block what it asked for; no task holds the trie. Only contexts of one byte or none, 257 at
most, are shipped with the tasks.

Null texts are empty texts: their one symbol is the end. Rows with a null id are training rows. Repeated rows count and are
scored as often as they stand there. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrays import text_groups, word_hashes, words
from flowloom.llm.rows import identified
from flowloom.scratch import stage

ORDER = 4
END = 255  # a byte that UTF-8 never has
#: Bytes of text after which a block is full; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
#: Bytes that are scored at once.
SCORED_BYTES = 1 << 20
#: Every symbol that the uniform context gives: 255 byte values and the end.
SYMBOLS = 256
FOLDS, HELD_OUT = 7, 2
GRAM, WORD = 0, 1
#: Contexts that are worked on at once.
CONTEXTS = 1024


def held_out(id: Column) -> Column:
    """Whether the row is left out of the training."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER + 1 bytes at every symbol of every text, end symbols included, as numbers; and document bounds."""
    n = len(offsets) - 1
    sizes = np.diff(offsets) + 1 + ORDER
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.full(int(bounds[-1]), 10, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) - offsets[row] + bounds[row] + ORDER] = data
    padded[bounds[1:] - 1] = END
    codes = np.zeros(max(0, len(padded) - ORDER), np.int64)
    for k in range(ORDER + 1):
        codes = codes << 8 | padded[k : k + len(codes)]
    at = bounds - ORDER * np.arange(n + 1)
    own = np.repeat(bounds[:-1] - at[:-1], sizes - ORDER) + np.arange(int(at[-1]))
    return codes[own], at


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = words(data, offsets)
    return (word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)).view(np.int64), bounds


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order of appearance, and which of them each key is."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The block of every row (uid, doc_id, held, text). It follows from the partition's rows alone, so every reading agrees."""
    start, done = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        start = batch.column(0)[0].as_py() if start is None else start
        sizes = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = done + np.cumsum(sizes) - sizes
        done += int(sizes.sum())
        yield start + before // BLOCK_BYTES, batch


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document with its block."""
    for blocks, batch in _in_blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(blocks), *batch.columns[1:]], names=["block", "doc_id", "held", "text"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block's distinct strings and words with their training counts."""
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []

    def full(block: int) -> Iterator[pa.RecordBatch]:
        for kind in (GRAM, WORD):
            mine = [p for p in parts if p[0] == kind]
            if mine:
                keys, which = distinct(np.concatenate([p[1] for p in mine]))
                n = np.bincount(which, np.concatenate([p[2] for p in mine]), len(keys)).astype(np.int64)
                columns = [np.full(len(keys), block), np.full(len(keys), kind, np.int32), keys, n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "kind", "key", "n"])

    block = None
    for blocks, batch in _in_blocks(batches):
        begins = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
        for begin, stop in zip(begins.tolist(), [*begins[1:].tolist(), len(blocks)]):
            if block is not None and blocks[begin] != block:
                yield from full(block)
                parts.clear()
            block, part = int(blocks[begin]), batch.slice(begin, stop - begin)
            held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in text_groups(part.column(3)):
                for kind, (keys, at) in ((GRAM, grams(data, offsets)), (WORD, word_keys(data, offsets))):
                    known, which = distinct(keys)
                    parts.append((kind, known, np.bincount(which, np.repeat(~held[first:end], np.diff(at)), len(known))))
    if block is not None:
        yield from full(block)


def _followers(counts: DataFrame, order: int, kinds: bool) -> DataFrame:
    """(c<order>, f<order>): what followed a context of ``order`` bytes in training, or with ``kinds``, in how many contexts of
    one byte more; 256 entries at most."""
    seen = counts.where("n > 0")
    if kinds:
        seen = seen.select(F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 2)) - 1)).alias("key")).distinct().withColumn("n", F.lit(1).cast("long"))
    cut = seen.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("k")).agg(F.sum("n").alias("n"))
    return cut.groupBy(F.shiftright("k", 8).alias(f"c{order}")).agg(F.collect_list(F.struct(F.col("k").bitwiseAND(F.lit(255)).cast("int").alias("s"), "n")).alias(f"f{order}"))


def log_probabilities(wanted: np.ndarray, chain: list[np.ndarray], method: str = "C") -> np.ndarray:
    """log10 probabilities, one row per context and one column per symbol, of the ``wanted`` ones (0 elsewhere).

    ``chain`` has the counts of every symbol after each row's contexts, from the longest context down.
    """
    out, escape = np.zeros(wanted.shape), np.zeros(len(wanted))
    free, todo = np.ones(wanted.shape, bool), wanted.copy()
    for counts in chain:
        seen = free & (counts > 0)
        n = seen.sum(1)
        total = np.where(seen, counts, 0).sum(1)
        weight = n if method == "C" else (seen & (counts == 1)).sum(1) + 1
        total = np.where(n > 0, total + np.where(free.sum(1) > n, weight, 0), 1)  # full rows have nothing left to escape to
        row, symbol = np.nonzero(todo & seen)
        out[row, symbol] = escape[row] + np.log10(counts[row, symbol] / total[row])
        todo &= ~seen
        free &= ~seen
        escape += np.log10(np.where(n > 0, weight, 1) / np.where(n > 0, total, 1))
    row, symbol = np.nonzero(todo)
    out[row, symbol] = escape[row] - np.log10(free.sum(1)[row])
    return out


def _gram_scores(counts: DataFrame, method: str, kinds: bool) -> DataFrame:
    """(key, value): the log10 probability of the last byte of every string after the others."""
    wanted = counts.groupBy(F.shiftright("key", 8).alias("context")).agg(
        F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("s"), "n")).alias("f4")
    )
    low1, low0 = np.zeros((256, SYMBOLS)), np.zeros(SYMBOLS)
    for context, followers in _followers(counts, 1, kinds).collect():
        for symbol, n in followers:
            low1[context, symbol] = n
            low0[symbol] += 1 if kinds else n
    for k in (3, 2):
        wanted = wanted.withColumn(f"c{k}", F.col("context").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(_followers(counts, k, kinds), f"c{k}", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CONTEXTS):
                yield scores(batch.slice(first, CONTEXTS))

    def scores(batch: pa.RecordBatch) -> pa.RecordBatch:
        contexts = batch.column(0).to_numpy()
        shape = len(contexts), SYMBOLS
        chain = []
        for k in (1, 2, 3):
            column = batch.column(k)
            row = np.repeat(np.arange(len(contexts)), column.value_lengths().fill_null(0).to_numpy())
            symbols, n = (column.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
            chain.append(np.zeros(shape))
            chain[-1][row, symbols] = n
            if k == 1:
                asked = np.zeros(shape, bool)
                asked[row, symbols] = True
        chain += [low1[contexts & 255], np.broadcast_to(low0, shape)]
        found = log_probabilities(asked, chain, method)
        row, symbols = np.nonzero(asked)
        return pa.RecordBatch.from_arrays([pa.array(symbols | contexts[row] << 8), pa.array(found[row, symbols])], names=["key", "value"])

    return wanted.select("context", "f4", "f3", "f2").mapInArrow(run, "key long, value double")


def scored(documents: DataFrame, id: str = "doc_id", text: str = "text", method: str = "C", kinds: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    if method not in ("C", "X"):
        raise ValueError(f"unknown escape method {method}")
    rows = documents.select(F.col(id).cast("long").alias("doc_id"), held_out(F.col(id)).alias("held"), F.col(text).cast("string").alias("text"))
    rows = identified(rows, "uid").select("uid", "doc_id", "held", "text")
    docs = rows.mapInArrow(_dealt, "block long, doc_id long, held boolean, text string")
    asked = stage(rows.mapInArrow(_asked, "block long, kind int, key long, n long"), "asked")
    counts = stage(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    train_docs = rows.where("not held").count()
    seen = counts.where(f"kind = {WORD} and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = seen[0] + train_docs, seen[1] + (train_docs > 0)
    values = _gram_scores(counts.where(f"kind = {GRAM}").select("key", "n"), method, kinds).select(F.lit(GRAM).alias("kind"), "key", "value")
    values = values.union(counts.where(f"kind = {WORD}").select("kind", "key", F.col("n").cast("double")))
    answers = asked.select("block", "kind", "key").join(stage(values, "values"), ["kind", "key"]).select(F.col("block").alias("for_block"), "kind", "key", "value")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    bottom = float(np.log10(float(tokens + distinct + 1)))
    end = float(np.log10(train_docs + 1)) - bottom

    def score(mine: pa.Table, answer: pa.Table) -> pa.Table:
        kinds, keys, found = (answer.column(k).to_numpy() for k in (1, 2, 3))
        tables = []
        for kind in (GRAM, WORD):
            tables.append((pa.array(keys[kinds == kind]), found[kinds == kind]))

        def looked_up(kind: int, keys: np.ndarray) -> np.ndarray:
            table, values = tables[kind]
            return values[pc.index_in(pa.array(keys), value_set=table).to_numpy()] if len(keys) else np.zeros(0)

        out = []
        for batch in mine.combine_chunks().to_batches():
            for first, stop, data, offsets in text_groups(batch.column(3), SCORED_BYTES):
                codes, at = grams(data, offsets)
                logs = np.concatenate([[0.0], looked_up(GRAM, codes)])
                hashes, bounds = word_keys(data, offsets)
                c = looked_up(WORD, hashes)
                sums = lambda x, b: np.array([x[i:j].sum() for i, j in zip(b[:-1], b[1:])])
                n = np.diff(bounds) + 1
                columns = [
                    batch.column(1).slice(first, stop - first), batch.column(2).slice(first, stop - first), pa.array(n, pa.int64()),
                    pa.array((sums(c > 0, bounds) + (train_docs > 0)).astype(np.int64)), pa.array(np.full(stop - first, tokens, np.int64)),
                    pa.array(sums(np.log10(c + 1) - bottom, bounds) + end), pa.array(sums(logs[1:], at)),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, names=names))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((k, pa.int64()) for k in names[2:5]), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, schema)

    types = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("block").cogroup(answers.groupBy("for_block")).applyInArrow(score, types)
