"""N-gram Jaccard join by parity sketches (operator 4).

A document is the set of its word n-grams. Sets are cut into bands by size. Within a band, every n-gram falls into one of
``m`` blocks by its hash, and a block's sketch is the XOR of the hashes in it: the parity of each bit. Two sets that differ
in ``d`` n-grams differ in at most ``d`` blocks, so the number of differing sketches is a lower bound of the symmetric
difference. Linked sets of a band differ in ``d`` n-grams at most; with ``m = d + 1 + e`` blocks they have ``e + 1``
sketches in common (pigeonhole), and sets that share a sketch are verified exactly on their n-gram hashes. Blocks of one
n-gram or none say little, so every set leaves out its ``e`` blocks of fewest n-grams, in one order for all sets. No link is lost:
the last of ``e + 1`` common sketches in that order has ``e`` others before it in both sets. ``e`` is chosen by the size of the blocks,
so that those of one n-gram or none are left out.

Before texts are compared, one more parity sketch of each whole set decides: every n-gram flips one bit of it, so the Hamming
distance of two sketches is at most the sets' symmetric difference, and a pair beyond the linked difference is dropped
without its texts.

Groups of any size stay distributed. Equal sets are one node from the start. A shared sketch is a run of a
range-sorted table, which may go over many partitions; its nodes are first compared with the run's first node only. Nodes
that end up in one component need no further comparison. What is left of a shared sketch - nodes of several components - is
dealt into tiles; tiles are compared in pairs by their bit sketches, and only pairs that pass become rows, each under the
smallest of the sketches that it shares. Sketches shared by the very same nodes are compared once. No link is lost.

Hashes have 62 bits or more and equal hashes count as equal n-grams and equal sets. A document without words links with nothing;
one with fewer words than n has its whole sequence as its one n-gram. Null texts have no words. Repeated rows,
null ids and columns of any name are kept; a new column whose name is taken gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrays import mix, sets_of, shingles, text_groups, word_hashes, words
from flowloom.llm.components import components
from flowloom.llm.hot import spread_join
from flowloom.llm.rows import free_name, identified
from flowloom.scratch import discard, stage

_U = np.uint64
BAND_GROWTH = 1.25
#: The largest share of a band's blocks that may be left out.
MOST_SPARE = 0.3
#: Members that are compared with one node in one group of rows.
CHUNK = 256
#: Nodes of a tile, and the most bits of a set's own sketch.
TILE, MOST_BITS = 1024, 1 << 17


class Bands:
    """Size bands for sets with ``den * intersection >= num * union``."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be above 0 and at most 1")
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND_GROWTH)))
        self._spare: dict[int, int] = {}

    def spare(self, band: int, differing: int) -> int:
        """Blocks to leave out: those of one member or none that the smallest sets of the band will have, and some more by chance."""
        if band not in self._spare:
            spare = 1 + differing // 20
            while spare < MOST_SPARE * (differing + 1 + spare):
                blocks = differing + 1 + spare
                filling = self.lows[band] / blocks
                weak = blocks * (1 + filling) * exp(-filling)
                if weak + 2 * sqrt(weak) <= spare:
                    break
                spare += 1 + spare // 16
            self._spare[band] = spare
        return self._spare[band]

    def of(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(band, blocks, blocks that are left out) for every band in which a set of size n can have a partner.

        Band j has the pairs whose smaller set has lows[j] to lows[j + 1] - 1 members.
        """
        j = int(np.searchsorted(self.lows, n, "right")) - 1
        while j >= 0:
            small = self.lows[j + 1] - 1
            large = small * self.den // self.num
            if n > large:
                return
            differing = (small + large) * (self.den - self.num) // (self.den + self.num)
            spare = self.spare(j, differing)
            yield j, differing + 1 + spare, spare
            j -= 1

    def keys(self, members: np.ndarray) -> np.ndarray:
        """The sketch keys of a sorted set of hashes."""
        found = []
        sums = np.zeros(len(members) + 1, np.uint64)
        np.bitwise_xor.accumulate(members, out=sums[1:])
        high = members >> _U(32)
        for band, blocks, spare in self.of(len(members)):
            which = (high * _U(blocks)) >> _U(32)
            edges = np.searchsorted(which, np.arange(blocks + 1, dtype=np.uint64))
            sketch = sums[edges[1:]] ^ sums[edges[:-1]]
            keys = mix(sketch + mix(np.arange(blocks, dtype=np.uint64) + _U(band << 40)))
            found.append(keys[np.lexsort((keys, np.diff(edges)))[spare:]])  # equal sketches are of equal blocks, so the order is the same for all
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    starts, ends, bounds = words(data, offsets)
    return sets_of(*shingles(word_hashes(data, starts, ends), bounds, size))


def _bits(members: np.ndarray) -> bytes:
    """The parity sketch of a whole set, two to four bits per member; half of it folded on the other is the sketch of half the size."""
    size = min(MOST_BITS, max(64, 1 << (2 * len(members) - 1).bit_length()))
    odd = np.bincount((members & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _node(members: np.ndarray) -> int:
    total = np.add.reduce(mix(members ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(mix(np.array([total + _U(len(members))]))[0].astype(np.int64))


def described(df: DataFrame, uid: str, text: str, size: int, bands: Bands) -> DataFrame:
    """(uid, n, node, bits, keys) of every row: set size, set identity (null without words), the set's own sketch, and sketch keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_groups(batch.column(1)):
                sets = _sets(data, offsets, size)
                keys = [bands.keys(s) for s in sets]
                lengths = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array([_bits(s) if len(s) else None for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                    names=["uid", "n", "node", "bits", "keys"],
                )

    return df.select(F.col(uid).alias("uid"), F.col(text).alias("text")).mapInArrow(run, "uid long, n long, node long, bits binary, keys array<long>")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, node): (key, first node of the run, other node); the ends of the partition also as (key, first node, null)."""
    names = ["key", "a", "b"]
    last_key = leader = None
    for batch in batches:
        keys, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if len(keys) == 0:
            continue
        begins = np.ones(len(keys), bool)
        begins[1:] = keys[1:] != keys[:-1]
        if last_key is None:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:1]), pa.array(nodes[:1]), pa.array([None], pa.int64())], names=names)
        elif keys[0] == last_key:
            begins[0] = False
        at = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
        first = np.where(at >= 0, nodes[at], leader if leader is not None else 0)
        fresh = first != nodes
        fresh[1:] &= begins[1:] | (nodes[1:] != nodes[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[fresh]), pa.array(first[fresh]), pa.array(nodes[fresh])], names=names)
        last_key, leader = keys[-1], first[-1]
    if last_key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last_key]), pa.array([leader]), pa.array([None], pa.int64())], names=names)


def shared_sketches(rows: DataFrame) -> DataFrame:
    """(key, a, b): node b shares a sketch with a, the first node of the key; every node of a shared key is there."""
    keyed = rows.select(F.explode("keys").alias("key"), "node")
    found = stage(keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_stars, "key long, a long, b long"), "stars")
    ends = found.where("b is null").groupBy("key").agg(F.min("a").alias("m"), F.max("a").alias("x")).where("m <> x")
    across = found.where("b is null").join(ends, "key").where("a <> m").select("key", F.col("m").alias("a"), F.col("a").alias("b"))
    return found.where("b is not null").union(across)


def _dealt(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """(a, chunk, role, node, ...): the payload of b beside that of a, sorted; a's row comes first in every chunk.

    A node's payload goes once to every chunk of nodes that it is compared with, so a popular node is spread.
    """
    counted = pairs.groupBy("a").agg(F.count("*").alias("c"), F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = spread_join(pairs, counted, ["a"], "c", ["b"]).withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks"))
    roles = dealt.select(F.col("b").alias("node"), "a", "chunk", F.lit(1).alias("role")).union(
        dealt.select(F.col("a").alias("node"), "a", "chunk", F.lit(0).alias("role")).distinct()
    )
    values = [c for c in payload.columns if c != "node"]
    rows = payload.join(roles, "node").select("a", "chunk", "role", "node", *values)
    return rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role", "node")


def near_enough(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose bit sketches differ no more than linked sets may. ``sketches`` has node, n and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, size = None, 0
        for batch in batches:
            at, roles, nodes, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
            found: list[tuple[int, int]] = []
            for k, raw in enumerate(batch.column(5)):
                bits = np.frombuffer(raw.as_buffer(), np.uint64)
                if roles[k] == 0:
                    mine, size = bits, sizes[k]
                    continue
                words = min(len(mine), len(bits))
                apart = int(np.bitwise_count(_folded(mine, words) ^ _folded(bits, words)).sum())
                if apart <= (size + sizes[k]) * (den - num) // (den + num):
                    found.append((at[k], nodes[k]))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _dealt(pairs, sketches.select("node", "n", "bits")).mapInArrow(run, "a long, b long")


def near_in_tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different roots under one key whose bit sketches are near enough, each pair once.

    ``members`` has key, c (members of the key), node, root, n and bits. A pair is found under the smallest key that both have:
    every row carries the smaller keys of its node, which are no more than the sketches of one set.
    """
    keys = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    members = members.join(keys, "node").withColumn("before", F.filter("keys", lambda k: k < F.col("key")))
    tiles = F.ceil(F.col("c") / TILE)
    own = F.pmod(F.xxhash64("node"), tiles)
    rows = members.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1))})
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root", "n", "bits", "before")

    def compared(group: pa.Table) -> pa.RecordBatch:
        low, high, own, nodes, roots, n = (group.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6))
        bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(7).combine_chunks()]
        words = min(map(len, bits))
        table = np.stack([_folded(x, words) for x in bits])
        before = [frozenset(x) for x in group.column(8).to_pylist()]
        a, b = [], []
        for k in range(len(nodes) - 1):
            rest = slice(k + 1, None)
            apart = np.bitwise_count(table[rest] ^ table[k]).sum(axis=1, dtype=np.int64)
            near = (apart <= (n[rest] + n[k]) * (den - num) // (den + num)) & (roots[rest] != roots[k])
            if low[k] != high[k]:
                near &= own[rest] != own[k]
            for m in (np.flatnonzero(near) + k + 1).tolist():
                if before[k].isdisjoint(before[m]):
                    a.append(min(nodes[k], nodes[m]))
                    b.append(max(nodes[k], nodes[m]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
            name = [rows.column(k).to_numpy() for k in (0, 1, 2)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in name], axis=0)) + 1
            edges = [0, *change.tolist()]
            for start, end in zip(edges[:-1], edges[1:]):
                yield compared(rows.slice(start, end - start))
            waiting = rows.slice(edges[-1])  # the last group may go on
        if waiting is not None:
            yield compared(waiting)

    group = ["key", "low", "high"]
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked. ``texts`` has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            at, roles, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            links: list[tuple[int, int]] = []
            for first, end, data, offsets in text_groups(batch.column(4)):
                for k, members in zip(range(first, end), _sets(data, offsets, size)):
                    if roles[k] == 0:
                        mine = members
                        continue
                    common = len(np.intersect1d(mine, members, assume_unique=True))
                    if den * common >= num * (len(mine) + len(members) - common):
                        links.append((at[k], nodes[k]))
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _dealt(pairs, texts.select("node", "text")).mapInArrow(run, "a long, b long")


def linked_groups(df: DataFrame, text: str, size: int, num: int, den: int, uid: str) -> DataFrame:
    """(uid, n, node, root) of every row of ``df``, whose ``uid`` must be repeatable.

    Rows are in one group when links lead from one to the other; root is null for nodes without links to others.
    """
    sets = stage(described(df, uid, text, size, Bands(num, den)), "sets")
    rows = stage(sets.drop("keys"), "rows")
    shared = stage(shared_sketches(sets), "shared")
    discard(sets)  # the sketches of blocks are the larger part, and nothing reads them any more
    pairs = shared.select("a", "b").distinct()
    first = stage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    nodes = shared.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = F.min(F.struct("uid", "n", "bits")).alias("one")
    holders = stage(rows.where("node is not null").groupBy("node").agg(one).join(nodes, "node").select("node", "one.*"), "holders")
    texts = df.select(F.col(uid).alias("uid"), F.col(text).alias("text"))

    def linked(pairs: DataFrame) -> DataFrame:
        near = stage(near_enough(pairs, holders, num, den), "near")
        return stage(verified(near, _texts_of(near, holders, texts), size, num, den), "links")

    links = linked(first)
    roots = components(links)
    # Whatever shares a sketch and is not in one component by now.
    links = links.union(linked(_apart(pairs, roots).join(first, ["a", "b"], "left_anti")))
    roots = components(links)
    members = shared.select("key", "a").union(shared.select("key", "b")).distinct().withColumnRenamed("a", "node")
    placed = stage(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c"), *same).where("x <> y and c > 2")
    mixed = mixed.groupBy("c", "s1", "s2").agg(F.min("key").alias("key")).select("key", "c")
    rest = spread_join(placed, mixed, ["key"], "c", ["node"]).join(holders.drop("uid"), "node")
    across = near_in_tiles(rest, num, den).join(pairs, ["a", "b"], "left_anti")  # those are compared already; a is the smaller there too
    across = stage(across, "across")
    links = links.union(stage(verified(across, _texts_of(across, holders, texts), size, num, den), "links"))
    return rows.select("uid", "n", "node").join(components(links), "node", "left")


def _texts_of(pairs: DataFrame, holders: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``pairs``; which rows are needed is staged, so texts move only if those are too many to broadcast."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return texts.join(stage(holders.select("node", "uid").join(nodes, "node"), "needed"), "uid")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def with_components(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, num: int = 9, den: int = 10, names: tuple[str, str] = ("n_shingles", "component_id")) -> DataFrame:
    """Add the set size and the smallest id reachable by links, the row's own included (null if all ids of the group are null)."""
    names = tuple(free_name(df, name) for name in names)
    uid = free_name(df, "uid")
    rows = identified(df, uid)
    groups = linked_groups(rows, text, size, num, den, uid).select(F.col("uid").alias(uid), F.col("n").alias(names[0]), F.coalesce("root", "node").alias("_group"))
    groups = stage(rows.select(uid, F.col(id).alias("_id")).join(groups, uid), "groups")
    least = groups.where("_group is not null").groupBy("_group").agg(F.min("_id").alias("_least"), F.count("*").alias("_size")).where("_size > 1")
    found = groups.join(least, "_group", "left").select(uid, names[0], F.coalesce("_least", "_id").alias(names[1]))
    if set(df.columns) == {id}:
        return found
    return rows.join(found, uid).select(*df.columns, *names)


def keep_one_each(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Of every group of linked rows, the one of the smallest id (nulls first, then the first row); rows without words stay."""
    uid = free_name(df, "uid")
    rows = identified(df, uid)
    groups = linked_groups(rows, text, size, num, den, uid).select("uid", F.coalesce("root", "node").alias("group"))
    groups = stage(rows.select(F.col(uid).alias("uid"), F.col(id).alias("id")).join(groups, "uid"), "groups")
    first = groups.where("group is not null").groupBy("group").agg(F.min(F.struct("id", "uid")).alias("first")).select("first.uid")
    kept = first.union(groups.where("group is null").select("uid")).withColumnRenamed("uid", uid)
    return rows.join(kept, uid, "left_semi").select(*df.columns)


def component_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: 3-word shingles, similarity 0.9."""
    rows = identified(documents.select("doc_id", "text"), "uid")
    groups = linked_groups(rows, "text", 3, 9, 10, "uid").withColumn("_group", F.coalesce("root", "node"))
    groups = stage(rows.select("uid", "doc_id").join(groups, "uid").select("doc_id", F.col("n").alias("n_shingles"), "_group"), "groups")
    least = groups.where("_group is not null").groupBy("_group").agg(F.min("doc_id").alias("least"))
    return groups.join(least, "_group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
