"""The operators over a small table with nulls, empty and repeated rows, ties and near copies, against plain calculations."""

import random

import plain
import pytest

from flowloom.llm import bpe, chunks, containment, jaccard, lines, pieces, ppm, quality, repeats, sharding, suffixes
from flowloom.llm.registered import tokenizer_file

random.seed(7)
VOCABULARY = ["".join(random.choices("abcdefghé", k=random.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


SHARED = prose(60)
LINES = [prose(12) for _ in range(6)]
NEAR = prose(80).split(" ")
ITEMS = [(1, prose(20)), (2, SHARED), (3, ""), (4, None), (5, "one Two three"), (6, prose(9))]


def _table():
    rows = [prose(random.randint(5, 90)) for _ in range(20)]
    rows += [prose(30) + " " + SHARED + " " + prose(30), SHARED + prose(9), "x" * 700, "ab" * 300, "", None, " \n ", "word", "word", "ONE two  three"]
    rows += [" ".join([*NEAR[:k], "new", *NEAR[k + 1 :]]) for k in (0, 40, 79)] + [" ".join(NEAR)] * 3
    rows += ["\n".join([prose(4), *LINES[a:b], "", prose(5)]) for a, b in ((0, 6), (1, 4), (2, 4), (3, 4))]
    rows += ["\n".join(["same line"] * 5), "\n".join(["  same line\t"] * 3), f"{ITEMS[0][1]} tail", " ".join(ITEMS[0][1].split(" ")[:18] + ["other"]), prose(20000)]
    return list(enumerate(rows))


DOCS = _table()
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_suffix_dedup(docs):
    assert rows(suffixes.removal_digest(docs)) == sorted(plain.cut_bytes(DOCS, 200))


def test_line_dedup(docs):
    assert rows(lines.line_digest(docs)) == sorted(plain.cut_lines(DOCS, 2))


def test_large_anchor_groups_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(repeats, "LARGE_GROUP", 2)
    assert rows(suffixes.removal_digest(docs)) == sorted(plain.cut_bytes(DOCS, 200))
    assert rows(lines.line_digest(docs)) == sorted(plain.cut_lines(DOCS, 2))


def test_jaccard_components(docs):
    assert rows(jaccard.component_digest(docs)) == sorted(plain.components(DOCS, 3, 9, 10))


def test_one_of_each_near_group_stays(docs):
    group = {i: g for i, _, g in plain.components(DOCS, 5, 8, 10)}
    kept = [r[0] for r in jaccard.keep_one_each(docs).collect()]
    assert sorted(kept) == sorted(i for i in group if group[i] == i)


def test_decontamination(docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted(plain.items_inside(DOCS, ITEMS))
    assert rows(containment.containment_digest(docs, items)) == expected
    clean = {i for i, _ in DOCS} - {e[0] for e in expected}
    assert {r[0] for r in containment.decontaminate(docs, items).collect()} == clean


def test_scoring(docs):
    got, want = rows(ppm.scored(docs)), sorted(plain.score_all(DOCS))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_chunk_dedup(docs):
    got = {r.doc_id: r for r in chunks.dedup_chunks(docs).collect()}
    texts = dict(DOCS)
    for i, r in got.items():
        assert (r.text is None) == (texts[i] is None)
        assert len((r.text or "").encode()) == r.n_bytes - r.n_removed and r.n_bytes == len((texts[i] or "").encode())
    assert all(got[i].n_removed == 0 for i in range(20))  # clean ones stay
    near = [i for i, t in DOCS if t == " ".join(NEAR)]
    assert [got[i].text for i in near[1:]] == ["", ""]  # later copies go, whole
    assert got[21].n_removed >= 100  # the passage moved to the front of another text


def test_codes_match_the_library(docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    model, texts = Tokenizer.from_file(path), dict(DOCS)
    for r in bpe.encode_and_decode(docs, bpe.read_spec(path)).collect():
        ids = model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.token_ids) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert r.decoded == model.decode(ids, skip_special_tokens=False)


def test_piece_counts_match_plain_longest_match(docs):
    vocabulary = ["▁", "▁a", "a", "b", "ab", "abc", "▁ab", *"cdefgh", "de", "def", "hé", "é", "x", "xx", *"nwsomlitr"]
    known = set(vocabulary)

    def count(word):
        word, n = "▁" + word, 0
        while word:
            size = next((k for k in range(len(word), 0, -1) if word[:k] in known and (n == 0 or word[0] != "▁")), 0)
            if not size:
                return None
            word, n = word[size:], n + 1
        return n

    texts = dict(DOCS)
    for r in pieces.piece_counts(docs, vocabulary).collect():
        each = [count(w) for w in plain.WORD.findall(texts[r.doc_id] or "")]
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(each), sum(1 if n is None else n for n in each), each.count(None))


def test_quality_measures_and_shards(docs):
    got = {r.doc_id: r for r in quality.quality_digest(docs).collect()}
    for i, t in DOCS:
        w = plain.WORD.findall(t or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        inside = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)} if len(w) < 500 else None
        assert got[i].n_words == len(w) and got[i].word_chars == sum(map(len, w))
        if inside is not None:
            assert got[i].n_repeat_words == len(inside)
            assert got[i].base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (got[i].base_failed and got[i].kept)
    shards = sharding.sharding_digest(docs).collect()
    sizes = [sum(r.shard == k for r in shards) for k in range(16)]
    assert sum(sizes) == len(DOCS) and max(sizes) - min(sizes) <= 1
    for k in range(16):
        assert sorted(r.slot for r in shards if r.shard == k) == list(range(sizes[k]))


OPERATORS = {
    "suffixes": suffixes.removed_bytes,
    "lines": lines.dedup_lines,
    "chunks": chunks.dedup_chunks,
    "jaccard": jaccard.with_components,
    "one_each": jaccard.keep_one_each,
    "pieces": lambda df: pieces.piece_counts(df, ["▁", "a"]),
    "bpe": lambda df: bpe.encode_and_decode(df, bpe.read_spec(tokenizer_file("byte_bpe_50k.json"))),
    "quality": quality.keep_good,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_null_ids_and_no_rows(spark, name):
    columns = "doc_id long, text string, uid string, found int, n_bytes int, n_lines int, n_words string, component_id int, token_ids int"
    some = [(None, "a b c d e f", "u", 1, 1, 1, "w", 1, 1), (None, None, None, None, None, None, None, None, None), (1, "", "u", 1, 1, 1, "w", 1, 1)] * 2
    for data in (some, []):
        df = spark.createDataFrame(data, columns)
        out = OPERATORS[name](df)
        got = out.collect()
        assert out.columns[: len(df.columns)] == df.columns and len(set(out.columns)) == len(out.columns)
        if name not in ("one_each", "quality"):
            assert len(got) == len(data)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ppm.scored(none).count() == 0
    assert containment.containment_digest(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("items", [ITEMS, [(3, ""), (4, None)], []])
def test_items_without_words_remove_nothing(docs, spark, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {i for i, *_ in plain.items_inside(DOCS, items)}
    assert containment.decontaminate(docs, table).count() == len(DOCS) - len(found)
