"""Groups of near copies that are not all linked, compared in tiles of any size."""

import random

import plain
import pytest

from flowloom.llm import hot, jaccard


def _documents():
    random.seed(9)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(400)]
    base, rows = random.choices(vocabulary, k=150), []
    for _ in range(120):
        words = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            words[random.randrange(150)] = random.choice(vocabulary)
        rows.append(" ".join(words))
    passage = " ".join(random.choices(vocabulary, k=60))
    return list(enumerate(rows + [" ".join(random.choices(vocabulary, k=random.randint(20, 200))) + " " + passage for _ in range(40)]))


@pytest.mark.parametrize("tile, spread", [(16, 8)])
def test_components(spark, monkeypatch, tile, spread):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(hot, "SPREAD", spread)
    docs = _documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard.component_digest(df).collect()))
    assert got == sorted(plain.components(docs, 3, 9, 10))
