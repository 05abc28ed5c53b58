"""Binary ids, the prefix trie and spelling variants against plain calculations and exact round trips."""

import random
import struct
import zlib

import numpy as np
import plain
import pytest

from flowloom.llm import conversations, hot, huffman, spelling, word_ids
from flowloom.llm.bpe import read_spec
from flowloom.llm.registered import tokenizer_file
from flowloom.scratch import scratch_path, stage

SPEC = read_spec(tokenizer_file("word_bpe_49k.json"))


def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(SPEC)
    model.no_truncation()
    model.no_padding()
    return model


def test_word_coder_is_the_library():
    random.seed(3)
    signs = [*"aAzZéÉßΣσİıŁ'’´.,;!? \t\n\r\x0b\x0c\x1c\x85\xa0 　́​#<|>09٣漢가ᄀᆨ😀×÷ªµ", "<|endoftext|>", "'s", "'ll", " "]
    model, coder = library(), word_ids.WordCoder(SPEC, "<u2")
    for _ in range(2000):
        text = "".join(random.choices(signs, k=random.randint(0, 30)))
        ids = model.encode(text, add_special_tokens=False).ids
        assert coder.encode(text.encode()) == struct.pack(f"<{len(ids)}H", *ids), repr(text)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(word_ids, "PIECE", 50)
    monkeypatch.setattr(word_ids, "WORDS", 20)
    monkeypatch.setattr(word_ids, "RUNS", 20)
    random.seed(4)
    text = " ".join("".join(random.choices("abcé,", k=random.randint(1, 90))) for _ in range(200))
    ids = library().encode(text, add_special_tokens=False).ids
    assert word_ids.WordCoder(SPEC, "<u2").encode(text.encode()) == struct.pack(f"<{len(ids)}H", *ids)


def test_groups_of_texts(monkeypatch):
    monkeypatch.setattr(word_ids, "GROUP", 300)
    monkeypatch.setattr(word_ids, "PIECE", 100)
    random.seed(9)
    words = ["Don't", "É1,2", "x", "漢字", "<|endoftext|>", "ÀÉß", "!!", "12", "\x85", "\n", "σς", "long" * 40]
    texts = [" ".join(random.choices(words if k % 3 else ["a1b", "É!", "z"], k=random.choice([0, 1, 5, 60]))) for k in range(80)]
    model = library()
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    got = word_ids.WordCoder(SPEC, "<u2").encode_texts(t.encode() for t in texts)
    assert got == [struct.pack(f"<{len(ids)}H", *ids) for ids in want]


def test_runs_are_looked_up_once_a_group(monkeypatch):
    asked = []
    codes = word_ids.Memory.codes
    monkeypatch.setattr(word_ids.Memory, "codes", lambda self, names, *rest: asked.extend(names) or codes(self, names, *rest))
    word_ids.WordCoder(SPEC, "<u2").encode_texts([b"One two, two one.\n" * 50] * 200)
    assert sorted(asked) == [b",", b".", b"one", b"two"]


def test_frequent_runs_stay_known(monkeypatch):
    monkeypatch.setattr(word_ids, "RUNS", 40)
    learned = []
    code = word_ids.WordCoder._coded_run
    monkeypatch.setattr(word_ids.WordCoder, "_coded_run", lambda self, run: learned.append(run) or code(self, run))
    coder = word_ids.WordCoder(SPEC, "<u2")
    for k in range(60):
        coder.encode(f"the {chr(97 + k % 26)}q{chr(97 + k // 26)} {'zw' * (1 + k % 30)}".encode())
    assert learned.count(b"the") == 1 and len(coder.runs.young) + len(coder.runs.old) <= 46


@pytest.mark.parametrize("counts", [[5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 1 << 40], list(range(1, 900)), [7] * 33])
def test_code_lengths_are_best_and_limited(counts):
    counts = np.array(counts)
    for limit in (6, 10, 20):
        if len(counts) > 1 << limit:
            continue
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and (len(counts) == 1 or sum(2.0**-lengths) == 1)
        if limit == 20 and len(counts) > 1:  # wide enough for the unlimited optimum: the sum of all merged weights
            heap, total = sorted(counts.tolist()), 0
            while len(heap) > 1:
                merged = heap[0] + heap[1]
                total += merged
                heap = sorted([*heap[2:], merged])
            assert (lengths * counts).sum() == total


def test_checksums_join():
    a, b = b"some bytes", bytes(range(256)) * 300
    assert huffman.shifted_crc(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_ids_come_back(spark, monkeypatch, block):
    monkeypatch.setattr(huffman, "BLOCK", block)
    monkeypatch.setattr(huffman, "STEP", 3 if block == 7 else huffman.STEP)
    random.seed(5)
    docs = [(k, " ".join("".join(random.choices("abcdé", k=3)) for _ in range(random.choice([0, 1, 30])))) for k in range(60)]
    docs += [(200, None), (201, ""), (None, "no number"), (7, "again 7"), (7, "again 7"), (-5, "<|endoftext|> x"), (300, "long " * 4000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, ids int").repartition(4)
    model = library()
    want = [(i, model.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs]
    packed = [(i, struct.pack(f"<{len(x)}I", *x)) for i, x in want]
    order = lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(r[1]))
    got = sorted(map(tuple, huffman.binary_digest(frame, SPEC).collect()), key=lambda r: r[1])
    start, expected = 0, []
    for (i, raw) in sorted(packed, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]))):
        expected.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    # Ties go by the checksum of the packed form that was written; sizes and places do not depend on it.
    assert [g[1:3] for g in got] == [e[1:3] for e in expected]
    assert sorted(g[::3] for g in got if g[0] is not None) == sorted(e[::3] for e in expected if e[0] is not None)
    if block == 7:
        ids = stage(word_ids.encoded(frame, SPEC, 1, "doc_id", "text").selectExpr("*", "monotonically_increasing_id() AS uid"), "ids")
        path = scratch_path(spark, "ids")
        huffman.write_ids(ids, path, "<u2")
        pieces = huffman.read_pieces(spark, path).orderBy("part", "first").collect()
        text = {}
        for p in pieces:
            text[p.part, p.row] = text.get((p.part, p.row), b"") + bytes(p.ids)
        assert sorted(text.values()) == sorted(raw for _, raw in sorted(packed, key=order))


def test_no_documents(spark):
    assert huffman.binary_digest(spark.createDataFrame([], "doc_id long, text string"), SPEC).count() == 0


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _conversations():
    random.seed(6)
    rows = [(None, 1, "u", "nobody")]
    for c in range(-10, 120):
        if random.random() < 0.15:
            continue
        for t in range(random.choice([1, 1, 2, 3, 8, 9, 17, 40])):
            text = random.choice(["x", "yé", None, ""]) if t > c % 12 or c % 4 == 0 else "same"
            rows.append((c, None if t == 0 and c % 3 == 0 else t, random.choice(["u", None]) if c % 7 else "u", text))
    return rows + [(500 + c, t, "u", f"copy {t}") for c in range(0, 200, 5) for t in range(12)]


@pytest.mark.parametrize("spread", [4096, 4])
def test_trie(spark, monkeypatch, spread):
    monkeypatch.setattr(hot, "SPREAD", spread)
    monkeypatch.setattr(conversations, "LISTED", 3)
    rows = _conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, c string").repartition(5)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in conversations.trie_digest(df).collect()), key=lambda r: r[:2])
    assert got == plain.trie(rows)


@pytest.mark.parametrize("rows", [[], [(7, 0, "u", "a")], [(1, 0, None, None)]])
def test_small_tries(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in conversations.trie_digest(df).collect()), key=lambda r: r[:2])
    assert got == plain.trie(rows)


@pytest.mark.parametrize("most", [1024, 1])
def test_spelling_variants(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_PAIRS", most)
    monkeypatch.setattr(spelling, "PIECE", 40)
    monkeypatch.setattr(spelling, "COUNTED", 100)
    random.seed(8)
    words = ["".join(random.choices("abé", k=random.randint(4, 8))) for _ in range(60)] + ["Straße", "ÀÉÎõüÿ", "x×÷yzz", "common"]
    docs = [(k, " ".join(random.choices(words, k=60)).replace(" ", random.choice([" ", ", ", "\n", "9"]))) for k in range(40)]
    docs += [(None, "common common common"), (900, None), (901, ""), (902, "Z" * 500), (902, "Z" * 500), (903, "common " * 300)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(4)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variant_digest(df).collect())
    assert got == plain.spelling(docs)


def test_no_words(spark):
    assert spelling.variant_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
