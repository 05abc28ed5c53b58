"""Prefix trie of conversations by block digests (operator 12).

A turn's code is a 128-bit hash of its place, role and text. A prefix is known by the exclusive or of its turns' codes, so prefixes
of any length come from running totals over range partitions, however long one conversation is.

Conversations are grouped first by their prefixes at every ``BLOCK``-th turn. Below a prefix with one continuing block all members go on alike:
one of them gives the block's turns with the group's count. Only blocks in which siblings differ are read for all their
members, and grouped turn by turn. A node is named by its smallest member and its depth. All sums over a subtree are sums over the
members of its top: a member adds the bytes of those nodes of its path below that a smaller member names, and one leaf if it names a
childless node. So nothing walks the trie, and its height does not matter.

Rows without a conversation are left out. Null roles and texts are empty. Turns of equal number (null first) are ordered by
the digest of role and text; equal rows are turns of their own. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.hot import spread_join
from flowloom.operators.ordering import running_totals
from flowloom.scratch import stage

#: Turns of a block.
BLOCK = 8
#: Members whose numbers travel as one row to the task that hashes a node's list.
LISTED = 1 << 14
ZERO = "cast(0 AS bigint)"


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, i, d, size): every turn's conversation, place from 0, digest of role and text, and UTF-8 bytes of the text."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    turns = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), digest.alias("d"), F.octet_length(said).cast("long").alias("size"),
        F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("uid"),
    )
    placed = running_totals(stage(turns, "turns"), [F.col("turn").asc_nulls_first(), "d", "uid"], {"one": "i"}, restart_by="c", name="turns")
    return stage(placed.select("c", (F.col("i") - 1).alias("i"), "d", "size"), "turns")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where a conversation's first turns are those of the first one of its five.

    Conversation c takes the first crc32(c) mod 9 turns of conversation c - c mod 5, then its own behind as many. The second result is
    (c) of all conversations, those that are left without turns included.
    """
    sizes = stage(turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "conversations")
    family = sizes.select("c", "n", F.expr("c - pmod(c, 5)").alias("base"), F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(9)).alias("h"))
    heads = turns.where("i < 8").withColumnRenamed("c", "base")
    first = family.join(heads, "base").where("i < h").select("c", "i", "d", "size")
    there = sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    taken = family.join(there, "base", "left").select("c", "n", "h", F.least("h", F.coalesce("base_n", F.expr(ZERO))).alias("k"))
    own = spread_join(turns, taken, ["c"], "n", ["i"]).where("i >= h").select("c", (F.col("i") - F.col("h") + F.col("k")).alias("i"), "d", "size")
    return stage(first.unionByName(own), "rebuilt"), sizes.select("c")


def _code(seed: int) -> Column:
    return F.xxhash64("d", "i", F.lit(seed))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, t1, t2, ends_sha256) of every node at which conversations end; (c, depth, t1, t2) has each once.

    Sorted numbers are joined to strings of bounded size in range partitions; the strings of a node are hashed one after another.
    """
    node = ["depth", "t1", "t2"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def close() -> None:
            if held:
                out.append((*key, held[0], ",".join(map(str, held))))

        for batch in batches:
            for *at, c in zip(*(column.to_pylist() for column in batch.columns)):
                if at != key or len(held) == LISTED:
                    close()
                    key, held = at, []
                held.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*node, "low", "list"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*node, "low", "list"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *at, part in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if at != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*node, "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=[*node, "ends_sha256"])

    keys = "depth long, t1 long, t2 long"
    rows = ends.select(*node, "c")
    lists = rows.repartitionByRange(*node, "c").sortWithinPartitions(*node, "c").mapInArrow(joined, f"{keys}, low long, list string")
    lists = stage(lists, "ends")  # else the second shuffle would sort the ranges anew
    return lists.repartition(*node).sortWithinPartitions(*node, "low").mapInArrow(hashed, f"{keys}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every distinct prefix.

    ``turns`` (c, i, d, size) and ``conversations`` (c) must be staged tables; places run from 0 without gaps.
    """
    coded = turns.select("c", "i", F.expr(f"i div {BLOCK}").alias("b"), "size", _code(1).alias("z1"), _code(2).alias("z2"))
    blocks = coded.groupBy("c", "b").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    totals = {"z1": "p1", "z2": "p2", "size": "bytes", "n": "depth"}
    paths = running_totals(blocks, ["b"], totals, restart_by="c", name="blocks", xor=["z1", "z2"])
    paths = stage(
        paths.select(
            "c", "b", "p1", "p2", "bytes", "depth", F.expr("p1 ^ z1").alias("q1"), F.expr("p2 ^ z2").alias("q2"),
            (F.col("bytes") - F.col("size")).alias("before"),
        ),
        "blocks",
    )

    # Groups of conversations by the prefix before a block: those with one continuing block need one member's turns.
    above = ["b", "q1", "q2"]
    kinds = paths.groupBy(*above, "p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.first("before").alias("before"))
    groups = stage(
        kinds.groupBy(*above).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.min("c").alias("least"), F.first("before").alias("before")),
        "groups",
    )
    several = spread_join(paths.select("c", *above, "before"), groups.where("n > 1").select(*above, "kinds", "n", "least"), above, "n", ["c"])
    several = stage(several, "members")
    alike = groups.where("kinds = 1").select(F.col("least").alias("c"), *above, "before", F.col("n").alias("w"))
    parted = several.where("kinds > 1").select("c", *above, "before", F.lit(1).cast("long").alias("w"))
    read = alike.unionByName(parted)

    # Turns of these blocks, with the prefix up to each.
    inside = "(PARTITION BY c, b ORDER BY i)"
    rows = coded.join(read, ["c", "b"]).selectExpr(
        "c", "b", "i + 1 AS depth", "size", "w", "z1", "z2",
        f"q1 ^ bit_xor(z1) OVER {inside} AS t1", f"q2 ^ bit_xor(z2) OVER {inside} AS t2", f"before + sum(size) OVER {inside} AS bytes",
    )
    rows = stage(rows, "prefixes")
    node = ["depth", "t1", "t2"]
    nodes = stage(
        rows.groupBy(*node).agg(
            F.sum("w").alias("n_convs"), F.min("c").alias("conv_id"), F.first("size").alias("size"), F.first("bytes").alias("bytes"),
            F.first(F.expr("t1 ^ z1")).alias("u1"), F.first(F.expr("t2 ^ z2")).alias("u2"),
        ),
        "nodes",
    )

    # Every node's parent and number of children; the root is beside the table.
    up = [(F.col("depth") - 1).alias("depth"), F.col("u1").alias("t1"), F.col("u2").alias("t2")]
    kids = stage(nodes.select(*up).groupBy(*node).agg(F.count(F.lit(1)).alias("n_children")), "children")
    parents = nodes.select(*node, F.col("conv_id").alias("parent_conv_id")).join(kids, node)
    root = conversations.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    below = nodes.where("depth > 1").select(*up, F.col("conv_id").alias("child"))
    links = spread_join(below, parents, node, "n_children", ["child"])
    links = links.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")

    # Of each conversation: bytes of its path that smaller conversations name, and whether it names a leaf.
    named = nodes.join(kids, node, "left").groupBy(F.col("conv_id").alias("c")).agg(
        F.min_by(F.col("bytes") - F.col("size"), "depth").alias("others"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf")
    )
    last = paths.groupBy("c").agg(F.max(F.struct("depth", "p1", "p2", "bytes")).alias("end"), F.count(F.lit(1)).alias("blocks"))
    ending = stage(
        conversations.join(last, "c", "left").join(named, "c", "left").select(
            "c", F.coalesce("end.depth", F.expr(ZERO)).alias("depth"), F.coalesce("end.p1", F.expr(ZERO)).alias("t1"), F.coalesce("end.p2", F.expr(ZERO)).alias("t2"),
            F.coalesce("others", "end.bytes", F.expr(ZERO)).alias("others"), F.coalesce("leaf", F.expr(ZERO)).alias("leaf"), F.coalesce("blocks", F.expr(ZERO)).alias("blocks"),
        ),
        "conversations",
    )

    # Sums over members, of whole groups where they go on alike, else turn by turn.
    shares = spread_join(several, ending.select("c", "others", "leaf", "blocks"), ["c"], "blocks", ["b"])
    shares = stage(shares.select("c", *above, "kinds", "least", "others", "leaf"), "shares")
    mine = F.when(F.col("c") == F.col("least"), F.col("others")).otherwise(F.expr(ZERO))
    whole = shares.where("kinds = 1").groupBy(F.col("least").alias("c"), "b", "q1", "q2").agg(F.sum("others").alias("others"), F.sum("leaf").alias("leaf"), F.sum(mine).alias("own"))
    single = shares.where("kinds > 1").select("c", *above, "others", "leaf", F.col("others").alias("own"))
    sums = whole.unionByName(single).select("c", "b", "others", "leaf", "own")
    summed = rows.select("c", "b", *node).join(sums, ["c", "b"]).groupBy(*node).agg(
        F.sum("others").alias("others"), F.sum("leaf").alias("n_leaves"), F.min(F.struct("c", "own")).alias("least")
    )
    saved = F.col("others") - F.col("least.own") - (F.col("n_convs") - 1) * (F.col("bytes") - F.col("size"))
    ends = ends_digest(ending)
    empty = F.lit(hashlib.sha256().hexdigest())
    out = nodes.join(summed, node, "left").join(kids, node, "left").join(ends, node, "left").join(links, ["conv_id", "depth"], "left")
    out = out.select(
        "conv_id", "depth",
        F.when(F.col("depth") == 1, F.lit(root["conv_id"])).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.expr(ZERO)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(saved, F.expr(ZERO)).alias("saved_tokens"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    top = ending.agg(F.sum("leaf").alias("leaves"), F.sum("others").alias("saved"), F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0")
    top = top.withColumn("depth", F.expr(ZERO)).join(kids.where("depth = 0").select("depth", "n_children"), "depth", "left")
    top = top.join(ends.where("depth = 0").select("depth", "ends_sha256"), "depth", "left")
    top = top.select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.expr(ZERO)).alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    return out.unionByName(top)


def trie_digest(rows: DataFrame) -> DataFrame:
    """The result of the query: the trie of the rebuilt ``conversations``."""
    return prefix_trie(*rebuilt_turns(ordered_turns(rows)))
