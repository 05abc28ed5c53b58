"""The scoring model with escapes by symbols seen once and update exclusion, by definition."""

import math
import random
import zlib
from collections import Counter

import pytest

from flowloom.llm import ppm

random.seed(9)
WORDS = ["".join(random.choices("abcdé", k=random.randint(1, 6))) for _ in range(60)]
DOCS = [(k, " ".join(random.choices(WORDS, k=random.randint(0, 40)))) for k in range(40)] + [(40, None), (None, "a null id"), (41, bytes(range(1, 128)).decode() * 3)]


def plain_scores(docs, method, kinds, order=4):
    padded = [b"\n" * order + (t or "").encode() + b"\xff" for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    strings = [Counter(b[p - k : p + 1] for b, h in zip(padded, held) if not h for p in range(order, len(b))) for k in range(order + 1)]
    follow = []
    for k in range(order + 1):
        table = {}
        if kinds and k < order:
            for s in strings[k + 1]:
                table.setdefault(s[1:-1], Counter())[s[-1]] += 1
        else:
            for s, n in strings[k].items():
                table.setdefault(s[:-1], Counter())[s[-1]] += n
        follow.append(table)

    def log_p(before, x):
        gone, logs = set(), 0.0
        for k in range(order, -1, -1):
            seen = {s: n for s, n in follow[k].get(before[order - k :], {}).items() if s not in gone}
            if seen:
                escape = len(seen) if method == "C" else list(seen.values()).count(1) + 1
                total = sum(seen.values()) + (escape if 256 - len(gone) > len(seen) else 0)
                if x in seen:
                    return logs + math.log10(seen[x] / total)
                logs += math.log10(escape / total)
                gone |= set(seen)
        return logs - math.log10(256 - len(gone))

    return [(i, sum(log_p(b[p - order : p], b[p]) for p in range(order, len(b)))) for (i, _), b in zip(docs, padded)]


@pytest.mark.parametrize(("method", "kinds"), [("X", True), ("X", False), ("C", True), ("C", False)])
def test_scores_by_definition(spark, method, kinds):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in ppm.scored(df, method=method, kinds=kinds).collect()}
    want = dict(plain_scores(DOCS, method, kinds))
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(2)
    chain = [rng.integers(0, 3, (5, 256)) * (rng.random((5, 256)) < p) for p in (0.01, 0.05, 0.3)]
    chain[2][4] = 1  # nothing left to escape to
    for method in "CX":
        assert (10 ** ppm.log_probabilities(np.ones((5, 256), bool), chain, method)).sum(1) == pytest.approx(np.ones(5))


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="escape"):
        ppm.scored(spark.createDataFrame(DOCS, "doc_id long, text string"), method="Z")
