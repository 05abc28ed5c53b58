"""Texts whose hashes agree under a polynomial modulo a power of two: Thue-Morse strings and their complements."""

import plain
import pytest

from flowloom.llm import arrays, bpe, containment, jaccard, lines, pieces, ppm
from flowloom.llm.registered import tokenizer_file


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def pair(n):
    return thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([t for n in (1024, 2048, 8192) for t in zip((n, n + 1), pair(n))], "doc_id long, text string").repartition(1)


def table(docs):
    return sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_substrings(n):
    import numpy as np

    a, b = (np.frombuffer(x.encode(), np.uint8) for x in pair(n))
    h = arrays.Substrings(arrays.TABLE[np.concatenate([a, b])])(np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]


def test_operators(spark, docs):
    from tokenizers import Tokenizer

    rows = table(docs)
    assert table(jaccard.component_digest(docs)) == sorted(plain.components(rows, 3, 9, 10))
    item = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    assert table(containment.containment_digest(docs, item)) == sorted(plain.items_inside(rows, [(1, rows[0][1])]))
    assert table(lines.line_digest(docs)) == sorted(plain.cut_lines(rows, 2))
    got, want = table(ppm.scored(docs)), sorted(plain.score_all(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    path = tokenizer_file("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    for r in bpe.encode_and_decode(docs, bpe.read_spec(path)).collect():
        assert len(r.token_ids) // 4 == len(model.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids) and r.decoded == dict(rows)[r.doc_id]
    counts = {r.doc_id: r.n_pieces for r in pieces.piece_counts(docs, ["▁", "a", "b", "ab", "ba", "aab"]).collect()}
    for i, text in rows:
        word, n = text, 1
        while word:
            size = next(k for k in (3, 2, 1) if word[:k] in ("a", "b", "ab", "ba", "aab"))
            word, n = word[size:], n + 1
        assert counts[i] == n
