"""Inputs whose rows change places, clashing names, crowded anchors and shared shingles, against plain calculations."""

import random
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from flowloom.llm import chunks, containment, hot, lines, quality, repeats, rows, sharding, suffixes
from flowloom.scratch import stage

random.seed(5)
WORDS = ["".join(random.choices("abcdefghé", k=random.randint(2, 8))) for _ in range(200)]


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


PASSAGE = prose(70)
TEXTS = [prose(random.randint(3, 60)) for _ in range(30)] + [f"{prose(k)} {PASSAGE} {prose(3)}" for k in range(8)] + [PASSAGE] * 6 + [None, "", "x" * 900, "short", "short"]
TEXTS += [f"{prose(5)}\n{PASSAGE}\n{prose(4)}", f"{prose(6)}\n{PASSAGE}\n{prose(2)}"]
DOCS = list(enumerate(TEXTS))
SCHEMA = "doc_id long, text string"


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return stage(spark.createDataFrame(DOCS, SCHEMA).repartition(3), "fixture")


UNSTEADY = {
    "shuffled": lambda d: d.repartition(3),
    "limited": lambda d: d.limit(25),
    "sampled": lambda d: d.sample(0.5, 3),
    "ordered": lambda d: d.orderBy(F.rand(1)),
    "filtered at random": lambda d: d.where(F.rand(2) < 0.7),
    "united": lambda d: d.union(d),
}


@pytest.mark.parametrize("kind", sorted(UNSTEADY))
def test_only_steady_scans_are_numbered_in_place(docs, kind):
    assert rows._steady(docs) and rows._steady(docs.select("text", "doc_id").where("doc_id > 3").alias("x"))
    changed = UNSTEADY[kind](docs)
    assert not rows._steady(changed)
    numbered = rows.identified(changed, "uid")
    first = {r.uid: r.text for r in numbered.collect()}
    again = numbered.select("uid", "text").repartition(5).collect()
    assert len(first) == len(again) and all(first[r.uid] == r.text for r in again)


def test_shuffled_and_sampled_rows_lose_their_own_bytes(docs):
    for change in ("shuffled", "ordered"):
        assert result(suffixes.removal_digest(UNSTEADY[change](docs))) == sorted(plain.cut_bytes(DOCS, 200))


@pytest.mark.parametrize("crowd", [2, 4])
def test_crowded_anchors_give_the_same(docs, monkeypatch, crowd):
    want = result(chunks.chunk_digest(docs))
    monkeypatch.setattr(repeats, "CROWD", crowd)
    assert result(suffixes.removal_digest(docs)) == sorted(plain.cut_bytes(DOCS, 200))
    assert result(lines.line_digest(docs)) == sorted(plain.cut_lines(DOCS, 2))
    assert result(chunks.chunk_digest(docs)) == want


def test_gear_hash_rolls():
    values = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    for gram in (1, 3, 32, 50, 64):
        h, want = 0, []
        for k, v in enumerate(values.tolist()):
            h = ((h << 1) + v - ((int(values[k - gram]) << gram) if k >= gram else 0)) % (1 << 64)
            want += [h] if k >= gram - 1 else []
        assert chunks.gear(values, gram).tolist() == want
    assert len(chunks.gear(values[:5], 6)) == 0


@pytest.mark.parametrize("spread", [2, 4096])
def test_items_of_a_common_phrase(spark, monkeypatch, spread):
    monkeypatch.setattr(hot, "SPREAD", spread)
    phrase = prose(9)
    items = [(k, f"{phrase} {prose(12)}") for k in range(12)] + [(20, phrase), (21, phrase), (None, phrase), (22, prose(25))]
    texts = [f"{prose(10)} {phrase} {prose(10)}" for _ in range(25)] + [f"{prose(4)} {t} {prose(4)}" for _, t in items] + [items[0][1]] * 5 + [None, "", "a"]
    table = list(enumerate(texts))
    df, benchmark = spark.createDataFrame(table, SCHEMA).repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = containment.containment_digest(df, benchmark).collect()
    want = plain.items_inside(table, items)
    assert sorted((*r,) for r in got if r.item_id is not None) == sorted(w for w in want if w[1] is not None)
    assert sum(r.item_id is None for r in got) == sum(w[1] is None for w in want) > 25
    assert {r[0] for r in containment.decontaminate(df, benchmark).collect()} == set(range(len(table))) - {w[0] for w in want}


def test_clashing_names(spark):
    columns = ["doc_id", "shard", "slot", "n_words", "_n_words", "Kept", "quality", "_words", "base_failed", "part", "key", "place"]
    data = [(k, *(f"{c}{k}" for c in columns[1:]), prose(70) if k % 2 else None) for k in range(9)]
    df = spark.createDataFrame(data, [*columns, "text"])
    placed = sharding.shard_rows(df, 4)
    assert placed.columns == [*df.columns, "_shard", "_slot"]
    assert sorted(tuple(r)[:-2] for r in placed.collect()) == sorted(data)
    out = quality.judged(df)
    assert out.columns[: len(columns)] == columns and len({c.lower() for c in out.columns}) == len(out.columns)
    assert sorted(tuple(r)[: len(columns)] for r in out.collect()) == sorted(d[:-1] for d in data)
    assert {(r["doc_id"], r["__n_words"]) for r in out.collect()} == {(k, 70 if k % 2 else 0) for k in range(9)}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and set(map(tuple, kept.collect())) <= set(data)


def test_whole_sharding(spark):
    table = [(k if k % 7 else None, t) for k, t in enumerate([None, "", "é", *(prose(k % 5) for k in range(300))])]
    got = sharding.sharding_digest(spark.createDataFrame(table, SCHEMA).repartition(5), 16).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in table)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.sharding_digest(spark.createDataFrame([], SCHEMA), 16).count() == 0


def test_margins_of_the_matrix():
    sources, shards = [5, 0, 17, 40], [16, 16, 15, 15]
    for seed in range(20):
        matrix = sharding.communication_matrix(sources, shards, seed)
        assert [sum(line) for line in matrix] == sources and [sum(c) for c in zip(*matrix)] == shards


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.Generator(np.random.PCG64(3))
    draws = np.array([sharding.hypergeometric(rng, 30, 50, 20) for _ in range(4000)])
    assert abs(draws.mean() - 7.5) < 0.15 and abs(draws.var() - 20 * 0.375 * 0.625 * 60 / 79) < 0.3
