"""Token ids as canonical length-limited Huffman codes in independent blocks (operator 11).

The file format is a folder with two Parquet tables:

* ``code``: ``id``, ``length`` - bits of every id that occurs. The codes are canonical: in order of length, then id, every code is the
  one before plus one, shifted to its length. Lengths are the best ones of at most ``LIMIT`` bits for the counts of the whole corpus.
* ``blocks``: one row per block of up to ``BLOCK`` ids. ``part`` and ``first`` give its place: parts follow one another, ``first`` is the
  block's first id within its part. ``bits`` holds the codes, first bit highest; ``checkpoints`` the bit offset of every
  ``STEP``-th id, so reading may begin there. ``docs`` lists the documents in the block: ``doc_id``, ``row`` (number of the document within
  its part), ``n`` (ids in this block) and ``after`` (ids in later blocks). Blocks are read on their own, in any order.

Documents stand in ascending order of id (null first; ties by number of ids, then their checksum). A document may be
longer than a block; no task holds more than one document and one block. Every table is written by Spark's commit protocol, so
a lost executor costs its tasks alone. An empty table gives an empty folder format; ids are 0 to 2^32 - 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.arrays import text_groups
from flowloom.llm.word_ids import encoded, id_type
from flowloom.scratch import scratch_path, stage

LIMIT, BLOCK, STEP = 20, 1 << 14, 256
#: Blocks that are decoded at once.
TOGETHER = 64
_POLYNOMIAL = 0xEDB88320
_DOCS = "array<struct<doc_id: {0}, row: long, n: int, after: long>>"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per symbol with the least total over all codes of at most ``limit`` bits (package-merge). Counts are positive."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    items, singles = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        items = both[place]
        singles.append(place < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(singles):
        used = int(single[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, length, code) in canonical order."""
    order = np.lexsort((symbols, lengths))
    symbols, lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
    if len(symbols) == 0:
        return symbols, lengths, symbols
    deepest = int(lengths[-1])
    span = 1 << (deepest - lengths)  # leaves of the full tree below each code
    return symbols, lengths, (np.cumsum(span) - span) >> (deepest - lengths)


class Code:
    """Tables for writing and reading; made once per task."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols, self.lengths, codes = canonical_codes(symbols, lengths)
        top = int(self.symbols.max()) + 1 if len(self.symbols) else 0
        self.left, self.length = np.zeros(top, np.uint64), np.zeros(top, np.int64)  # codes begin at the highest bit
        self.left[self.symbols], self.length[self.symbols] = codes.astype(np.uint64) << (64 - self.lengths).astype(np.uint64), self.lengths

    def reader(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Bits looked at, and for every value of them the symbol and length of the code they begin with."""
        bits = int(self.lengths[-1]) if len(self.lengths) else 1
        span = 1 << (bits - self.lengths)
        rest = (1 << bits) - int(span.sum())  # only a lone symbol leaves some
        return bits, np.append(np.repeat(self.symbols, span), np.zeros(rest, np.int64)).astype(np.uint32), np.append(np.repeat(self.lengths, span), np.zeros(rest, np.int64)).astype(np.uint8)

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids`` one after another, and the bit offset of every ``STEP``-th id."""
        length = self.length[ids]
        end = np.cumsum(length)
        at = end - length
        word = at >> 5
        window = self.left[ids] >> (at & 31).view(np.uint64)  # at most 31 + 20 bits
        words = np.zeros(int(end[-1] + 31 >> 5) + 1, np.uint64)
        begin = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
        place, found = word[begin], np.bitwise_or.reduceat(window, begin)
        words[place] = found >> np.uint64(32)
        words[place + 1] |= found & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], at[::STEP]


def read_blocks(reader: tuple[int, np.ndarray, np.ndarray], bits: list[bytes], checkpoints: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """Ids of several blocks; all their checkpoints are followed at once, one id per step."""
    look, symbol, length = reader
    entry = symbol.astype(np.uint32 if int(symbol.max(initial=0)) < 1 << 27 else np.uint64) << 5 | length  # LIMIT fits in five bits
    starts = np.cumsum([0, *(len(b) for b in bits)])
    data = np.frombuffer(b"".join(bits) + bytes(8 + -int(starts[-1]) % 4), ">u4").astype(np.uint64)
    wide = data[:-1] << np.uint64(32) | data[1:]  # 64 bits from every fourth byte on: at most 31 + 20 are looked at
    at = np.concatenate([c + 8 * s for c, s in zip(checkpoints, starts[:-1])]).astype(np.int64)
    lanes = np.array([len(c) for c in checkpoints])
    left = np.full(len(at), STEP)
    last = np.cumsum(lanes) - 1
    left[last] = sizes - STEP * (lanes - 1)
    out = np.zeros((STEP, len(at)), np.uint32)
    mask, drop = np.uint64((1 << look) - 1), 64 - look
    for k in range(int(left.max())):
        if k == left.min():
            live = np.flatnonzero(left > k)
            rows, at, left = (live, at[live], left[live]) if k == 0 or out.shape[1] == len(at) else (rows[live], at[live], left[live])
        elif k == 0:
            rows = np.arange(len(at))
        value = entry[(wide[at >> 5] >> (drop - (at & 31)).view(np.uint64) & mask).view(np.int64)]
        out[k, rows] = value >> 5
        at = at + (value & 31).astype(np.int64)
    out, ends = np.ascontiguousarray(out.T), np.cumsum(lanes)
    return [out[e - n : e].reshape(-1)[:s] for e, n, s in zip(ends, lanes, sizes)]


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, highest power in the lowest bit."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def shifted_crc(crc: int, behind: int) -> int:
    """What ``crc`` adds (by exclusive or) to the checksum of a text in which ``behind`` more bytes follow."""
    power, n = 0x00800000, behind  # one byte: x^8
    while n:
        if n & 1:
            crc = _times(power, crc)
        power, n = _times(power, power), n >> 1
    return crc


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all packed ids; every task counts its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, packed, _ in text_groups(batch.column(0)):
                if kind == "<u2":
                    n = np.bincount(packed.view(kind))
                    if len(n) > len(seen):
                        seen, n = n, seen
                    seen[: len(n)] += n
                else:
                    value, n = np.unique(packed.view(kind), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"id": pa.array(value.astype(np.int64)), "n": pa.array(n)})
        value = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"id": pa.array(value), "n": pa.array(seen[value])})

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(code: tuple[np.ndarray, np.ndarray], kind: str, id_field: pa.DataType):
    entry = pa.struct([("doc_id", id_field), ("row", pa.int64()), ("n", pa.int32()), ("after", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Code(*code)
        part, row, first, held, parts, docs = 0, 0, 0, 0, [], []

        def block() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            bits, checkpoints = writer.write(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([bits], pa.binary()),
                 pa.array([checkpoints.tolist()], pa.list_(pa.int32())), pa.array([docs], pa.list_(entry))],
                names=["part", "first", "n", "bits", "checkpoints", "docs"],
            )

        for batch in batches:
            for name, packed, place in zip(*batch.columns):
                part, name = place.as_py(), name.as_py()
                ids, at = np.frombuffer(packed.as_buffer(), kind), 0
                while at < len(ids):
                    n = min(len(ids) - at, BLOCK - held)
                    parts.append(ids[at : at + n])
                    held, at = held + n, at + n
                    docs.append({"doc_id": name, "row": row, "n": n, "after": len(ids) - at})
                    if held == BLOCK:
                        yield block()
                        first, held, parts, docs = first + held, 0, [], []
                row += 1
        if held:
            yield block()

    return run


def write_ids(ids: DataFrame, path: str, kind: str) -> None:
    """Write (doc_id, ids) in the file format above. ``ids`` (packed, at least one each) must be a staged table.

    One row per id that occurs reaches the driver: the vocabulary bounds it, not the corpus.
    """
    counts = id_counts(ids, kind).toArrow()
    symbols = counts.column("id").to_numpy()
    lengths = code_lengths(counts.column("n").to_numpy())
    code = pa.table({"id": pa.array(symbols, pa.int64()), "length": pa.array(lengths, pa.int32())})
    spark = ids.sparkSession
    spark.createDataFrame(code).coalesce(1).write.parquet(f"{path}/code")
    keys = [F.col("doc_id").asc_nulls_first(), F.octet_length("ids"), F.crc32("ids"), F.col("uid")]
    ordered = ids.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids", F.spark_partition_id().alias("part"))
    kind_of_id = ids.schema["doc_id"].dataType.simpleString()
    schema = f"part int, first long, n int, bits binary, checkpoints array<int>, docs {_DOCS.format(kind_of_id)}"
    id_field = pa.int64() if kind_of_id == "bigint" else pa.int32() if kind_of_id == "int" else pa.string()
    ordered.mapInArrow(_blocks((symbols, lengths), kind, id_field), schema).write.parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of the code; as many rows as the vocabulary has at most."""
    code = spark.read.parquet(f"{path}/code").toArrow()
    return code.column("id").to_numpy(), code.column("length").to_numpy()


def read_pieces(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """(part, first, doc_id, row, n, after, crc, ids): what each block holds of each document, decoded.

    ``first`` is the place of the piece's first id in its part, ``crc`` what the piece adds (by exclusive or) to the CRC-32 of the document's
    ids as little-endian unsigned 32-bit integers. ``ids`` are packed so, and null without ``keep_ids``.
    """
    code = read_code(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(low, TOGETHER)
                reader = reader or Code(*code).reader()
                checkpoints = [np.array(c.as_py()) for c in some.column(4)]
                found = read_blocks(reader, [b.as_py() for b in some.column(3)], checkpoints, some.column(2).to_numpy())
                docs = some.column(5)
                entries, held = docs.flatten(), docs.value_lengths().to_numpy()
                n, after = (entries.field(k).to_numpy().astype(np.int64) for k in ("n", "after"))
                flat = np.concatenate(found).astype("<u4").tobytes()
                ends = 4 * np.cumsum(n)
                crc = [zlib.crc32(flat[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist())]
                crc = [shifted_crc(c, 4 * a) if a else c for c, a in zip(crc, after.tolist())]
                sizes = some.column(2).to_numpy().astype(np.int64)
                inside = np.cumsum(n) - n - np.repeat(np.cumsum(sizes) - sizes, held)
                first = np.repeat(some.column(1).to_numpy(), held) + inside
                ids = pa.array([flat[e - 4 * k : e] for e, k in zip(ends.tolist(), n.tolist())] if keep_ids else [None] * len(n), pa.binary())
                columns = [pa.array(np.repeat(some.column(0).to_numpy(), held)), pa.array(first), *(entries.field(k) for k in ("doc_id", "row")), pa.array(n), pa.array(after), pa.array(crc, pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "doc_id", "row", "n", "after", "crc", "ids"])

    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    schema = f"part int, first long, doc_id {kind}, row long, n long, after long, crc long, ids binary"
    return blocks.select("part", "first", "n", "bits", "checkpoints", "docs").mapInArrow(decode, schema)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, start): ids in all parts before; one row per written partition, so it may be broadcast."""
    sizes = sorted(spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect())
    parts = np.array([r["part"] for r in sizes], np.int32)
    ends = np.cumsum([r["n"] for r in sizes], dtype=np.int64)
    return spark.createDataFrame(pa.table({"part": pa.array(parts), "start": pa.array(np.concatenate([[0], ends[:-1]])[: len(parts)].astype(np.int64))}))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every written document, from the decoded blocks."""
    pieces = read_pieces(spark, path, keep_ids=False).drop("ids", "after")
    whole = pieces.groupBy("part", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
    )
    placed = whole.join(F.broadcast(part_starts(spark, path)), "part")
    return placed.select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def binary_digest(docs: DataFrame, spec: str, end_id: int = 1) -> DataFrame:
    """The result of the query: encode ``documents``, write the files, read them back."""
    spark, kind = docs.sparkSession, id_type(spec, end_id)
    ids = stage(encoded(docs, spec, end_id, "doc_id", "text").withColumn("uid", F.monotonically_increasing_id()), "ids")
    path = scratch_path(spark, "binary-ids")
    write_ids(ids, path, kind)
    return read_summary(spark, path)
