"""Repeats that no run of lines and no run of chunks shows, against plain calculations."""

import random

import plain
import pytest

from flowloom.llm import chunks, lines

random.seed(11)


def prose(n, least=2):
    return " ".join("".join(random.choices("abcdefghé", k=random.randint(least, 8))) for _ in range(n))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cut_all_lines(docs, run, alone):
    """Like ``plain.cut_lines``, and single lines of ``alone`` words or that are the whole text."""
    seen, out = set(), []
    for i, text in docs:
        raw = (text or "").split("\n")
        spoken = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(raw) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(spoken)):
            part = spoken[k : k + run]
            if len(part) == run:
                key = tuple(x for _, x in part)
                gone |= {m for m, _ in part} if key in seen else set()
                seen.add(key)
            m, x = spoken[k]
            if len(plain.WORD.findall(x)) >= alone or len(spoken) == 1:
                gone |= {m} if ("alone", x) in seen else set()
                seen.add(("alone", x))
        flags = [k in gone for k, _ in spoken]
        spans = sum(g and (k == 0 or not flags[k - 1]) for k, g in enumerate(flags))
        out.append((i, len(spoken), len(gone), spans, plain.sha("\n".join(x for k, x in enumerate(raw) if k not in gone).encode())))
    return out


PASSAGE, EXACT, SHORT = prose(60), prose(50), prose(49)
TEXTS = [
    *[f"{prose(4)}\n{PASSAGE}\n{prose(5)}" for _ in range(4)], PASSAGE, f"  {PASSAGE}\t",  # a long line between other lines, and alone
    *[f"{prose(4)}\n{line}\n{prose(5)}" for line in (EXACT, EXACT, SHORT, SHORT, "again", "again")],
    "one line", "one line ", prose(3), f"one line\n{prose(3)}", "\n one line\n\n", "a\nb", "a\nb", None, "", " ", *["hot"] * 20,
]
LINE_DOCS = list(enumerate(TEXTS))


@pytest.mark.parametrize("order", [1, -1])
def test_single_long_lines_and_one_line_copies_go(spark, order):
    docs = LINE_DOCS if order == 1 else [(len(TEXTS) - i, t) for i, t in LINE_DOCS][::-1]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = cut_all_lines(docs, 2, lines.ALONE)
    assert rows(lines.line_digest(df, lines.ALONE)) == sorted(want)
    if order == 1:
        removed = {i: n for i, _, n, _, _ in want}
        assert [removed[i] for i in range(12)] == [0, 1, 1, 1, 1, 1, 0, 1, 0, 0, 0, 0]
        assert sum(removed[i] for i, t in docs if t == "hot") == 19


def cut_passages(docs, size):
    """Bytes of strings of ``size`` bytes and of whole shorter texts that stood earlier go, but for parts of characters."""
    seen, out = set(), []
    for i, text in docs:
        t = (text or "").encode()
        gone = [False] * len(t)
        for p in range(max(1, len(t) - size + 1)):
            key = t[p : p + size] if len(t) >= size else ("whole", t)
            if key in seen:
                gone[p : p + size] = [True] * len(t[p : p + size])
            seen.add(key)
        at, kept = 0, []
        for c in text or "":
            n = len(c.encode())
            kept += [] if all(gone[at : at + n]) else [c]
            at += n
        out.append((i, None if text is None else "".join(kept), len(t), len(t) - len("".join(kept).encode())))
    return out


def test_no_passage_of_51_words_is_missed(spark):
    docs, passages = [], {}
    for n in range(120):
        shared = prose(51, 1) if n % 2 else " ".join(random.choices("abcdé", k=51))
        docs.append((2 * n, f"{prose(n % 37)} {shared} {prose(20)}"))
        docs.append((2 * n + 1, f"{prose(3 + n % 23)}{'xyz'[: n % 4]} {shared}\n{prose(15)}"))
        passages[2 * n + 1] = len(shared.encode())
    docs += [(1000 + k, t) for k, t in enumerate(["a short text"] * 30 + ["other", "", "", None, "é" * 60, "è" * 60, "é" * 49, "é" * 49])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text, r.n_bytes, r.n_removed) for r in chunks.dedup_chunks(df).collect())
    assert got == sorted(cut_passages(docs, chunks.PASSAGE))
    removed = {g[0]: g[3] for g in got}
    assert all(removed[i] >= size for i, size in passages.items())
    assert [removed[1000 + k] for k in range(31)] == [0] + [12] * 29 + [0]
