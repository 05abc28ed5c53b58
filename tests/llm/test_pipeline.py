"""``corpus_pipeline.run`` against a plain calculation of all five stages, each over what the one before kept."""

import math
import os
import random
import struct

import plain
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowloom.llm import lines, quality
from flowloom.llm.registered import documents, tokenizer_file

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def base_failed(text):
    words = plain.WORD.findall(text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w, n in plain.Counter(windows).items() if n > 1}
    repeated = {k + d for k, w in enumerate(windows) if w in twice for d in range(3)}
    return len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def posteriors(ballots):
    """Expectation-maximisation document by document, where the library counts patterns."""
    share, keep, reject = quality.PRIOR, quality.ACCURACY / 2, (1 - quality.ACCURACY) / 2
    n = len(ballots[0]) if ballots else 0
    good = [{1: keep, -1: reject, 0: 0.5} for _ in range(n)]
    bad = [{1: reject, -1: keep, 0: 0.5} for _ in range(n)]

    def belief(ballot):
        for_it = math.log(share) + sum(math.log(good[k][v]) for k, v in enumerate(ballot))
        against = math.log(1 - share) + sum(math.log(bad[k][v]) for k, v in enumerate(ballot))
        return 1 / (1 + math.exp(min(700.0, against - for_it)))

    for _ in range(quality.ROUNDS):
        now = [belief(b) for b in ballots]
        for k in range(n):
            for rates, weights in ((good, now), (bad, [1 - p for p in now])):
                mass = {v: 1 + sum(w for b, w in zip(ballots, weights) if b[k] == v) for v in (1, -1, 0)}
                rates[k] = {v: m / sum(mass.values()) for v, m in mass.items()}
        share = (sum(now) + 1) / (len(ballots) + 2)
    return [belief(b) for b in ballots]


def without_repeated_lines(docs):
    """(id, text, spoken lines, removed lines) in order of ids: later runs of two lines, long lines and lone lines go."""
    seen, out = set(), []
    for i, text in docs:
        raw = text.split("\n")
        spoken = [k for k, x in enumerate(raw) if x.strip(BLANKS)]
        bare, gone = [raw[k].strip(BLANKS) for k in spoken], set()
        for k, line in enumerate(bare):
            keys = [((line, bare[k + 1]), {k, k + 1})] if k + 1 < len(bare) else []
            if len(plain.WORD.findall(line)) >= lines.ALONE or len(bare) == 1:
                keys.append((line, {k}))
            for key, places in keys:
                gone |= places if key in seen else set()
                seen.add(key)
        lost = {spoken[k] for k in gone}
        out.append((i, "\n".join(x for k, x in enumerate(raw) if k not in lost), len(spoken), len(gone)))
    return out


def by_definition(spark, rows, items, sf):
    """{doc_id: (text, n_chars, token_ids, decoded)} of the documents that stay, and how many each stage kept."""
    kept = []
    voted = quality.measured(documents(spark, sf)).select("doc_id", *(v.alias(f"v{k}") for k, v in enumerate(quality.votes())))
    ballots = {r[0]: tuple(r[1:]) for r in voted.collect()}
    order = sorted(rows)
    beliefs = dict(zip(order, posteriors([ballots[i] for i in order])))
    docs = [(i, rows[i][0]) for i in order if not base_failed(rows[i][0]) and beliefs[i] >= 0.5]
    kept.append(len(docs))
    size = {i: rows[i][1] for i, _ in docs}
    cut = [c for c in without_repeated_lines(docs) if not c[3] or c[3] < c[2]]
    size |= {i: len(text) for i, text, _, removed in cut if removed}
    docs = [(i, text) for i, text, _, _ in cut]
    kept.append(len(docs))
    firsts = {i for i, _, group in plain.components(docs, 5, 8, 10) if group == i}
    docs = [(i, t) for i, t in docs if i in firsts]
    kept.append(len(docs))
    leaked = {i for i, *_ in plain.items_inside(docs, items)}
    docs = [(i, t) for i, t in docs if i not in leaked]
    kept.append(len(docs))
    codec, out = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), {}
    codec.no_truncation()
    codec.no_padding()
    for i, text in docs:
        ids = codec.encode(text, add_special_tokens=False).ids
        out[i] = (text, size[i], struct.pack(f"<{len(ids)}I", *ids), codec.decode(ids, skip_special_tokens=False))
    return out, kept


def check(spark, sf):
    rows = {r.doc_id: (r.text, r.n_chars) for r in documents(spark, sf).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want, kept = by_definition(spark, rows, items, sf)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*documents(spark, sf).columns, "token_ids", "decoded"]
    found = got.collect()
    assert {r.doc_id: (r.text, r.n_chars, bytes(r.token_ids), r.decoded) for r in found} == want
    assert len(found) == len(want)
    return [len(rows), *kept]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_given_tables(spark):
    sizes = check(spark, SF)
    assert sizes[0] > sizes[1] > sizes[-1] > 0


random.seed(23)
POOL = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(POOL, k=n))


def write(spark, folder, docs, items):
    docs = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_every_stage_decides_something(spark, tmp_path):
    passage, near, item = prose(60), prose(120).split(" "), prose(25)
    texts = [prose(random.randint(55, 120)) for _ in range(30)]
    texts += [f"{prose(40)}\n{passage}\n{prose(40)}" for _ in range(3)]  # a long line in several documents
    texts += [" ".join([*near[:k], "new", *near[k + 1 :]]) for k in (0, 60, 119)]  # near copies
    texts += [texts[3]] * 2 + [f"{prose(50)} {item} {prose(50)}", " ".join(item.split(" ")[:12]) + " " + prose(60)]
    texts += [None, "", " \n", prose(10), "# $ % " * 40, ("one two three " * 30), "AB<>|& " * 70]
    write(spark, tmp_path, list(enumerate(texts)), [(1, item), (2, ""), (3, None)])
    sizes = check(spark, str(tmp_path))
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes


def test_no_documents(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert check(spark, str(tmp_path)) == [0] * 5
