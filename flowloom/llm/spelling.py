"""Spelling variants of the words of a corpus (operator 13).

Words are counted in the tasks that read the texts; only each task's distinct words are shuffled. Two words are near if one
code point was inserted, deleted or replaced. They are found by asymmetric chunks: the shorter word is cut into two disjoint
chunks, of which one edit leaves one whole, at the front or shifted by the difference in length (nought or one) at the back; the
longer word gives its grams at those places for both lengths that its partner may have. Words that share a chunk meet, and the
edit is verified. A chunk that so many words share that it would make more than ``MOST_PAIRS`` pairs makes none: what it leaves open in
the middle is cut in two by the same rule, until one code point is open. So the pairs made follow the pairs that are near.

Null texts have no words. A null id counts as empty in the rule for mistyped runs. An empty table gives no words. Repeated rows
count as often as they stand. Other columns of the documents are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.hot import spread_join
from flowloom.scratch import stage

#: Every code point up to U+00FF as one byte: letters (U+00C0 to U+00FF among them) stay, A-Z in lower case, all else is a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Code points of a text that are split into words at once; the cut is moved to the next blank.
PIECE = 1 << 20
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18
#: One run in so many is mistyped, by its document and letters.
MISTYPED = 97
MOST_PAIRS = 1024


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters in Latin-1, in pieces of bounded size."""
    flat = text.encode("latin-1", "replace").translate(LETTERS)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def written(run: bytes, begin: int) -> bytes:
    """``run``, or the run without one code point if its checksum says so; ``begin`` is the checksum of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
    if h % MISTYPED:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of all words of at least so many code points that occur at least so often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            words = [w for w in total if len(w) >= least_length]
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in words], pa.string()), "n": pa.array([total[w] for w in words], pa.int64())})

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                begin = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for piece in runs(body.as_py() or ""):
                    for run, n in Counter(piece).items():
                        word = written(run, begin)
                        total[word] = total.get(word, 0) + n
                if len(total) > COUNTED:
                    yield counted()
                    total.clear()
        yield counted()

    texts = docs.select(F.col(doc_id).cast("string"), text).where(F.col(text).isNotNull())
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halved(rows: DataFrame) -> DataFrame:
    """Cut what is open between the first ``front`` and the last ``back`` code points in two chunks; either may be the whole one."""
    half = F.expr("(size - front - back) div 2").cast("int")
    rest = F.col("size") - F.col("front") - F.col("back") - half
    both = F.array(F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back")), F.struct(F.col("front").alias("front"), (F.col("back") + rest).alias("back")))
    cut = rows.withColumn("cut", F.explode(both)).select("word", "n", "size", "longer", "cut.front", "cut.back")
    head, tail = F.expr("substring(word, 1, front)"), F.expr("right(word, back)")
    return cut.withColumns({"head": head, "tail": tail})


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words (with their counts) that one edit tells apart, once; ``a`` is the shorter or the smaller.

    Words must be distinct and not empty.
    """
    size = F.length("word")
    roles = F.array(F.struct(size.alias("size"), F.lit(False).alias("longer")), F.struct((size - 1).alias("size"), F.lit(True).alias("longer")))
    zero = F.lit(0)
    open_ = words.withColumn("role", F.explode(roles)).select("word", "n", "role.size", "role.longer", zero.alias("front"), zero.alias("back"))
    keys, found = ["size", "front", "back", "head", "tail"], None
    while True:
        rows = stage(_halved(open_), "chunks")
        sides = rows.groupBy(*keys).agg(F.count_if(~F.col("longer")).alias("s"), F.count_if("longer").alias("l"))
        sides = sides.withColumns({"pairs": F.expr("s * (s - 1) div 2 + s * l"), "all": F.col("s") + F.col("l")}).where("pairs > 0").drop("s", "l")
        rows = stage(spread_join(rows, sides, keys, "all", ["word"]).drop("all"), "chunks")
        heavy = (F.col("pairs") > MOST_PAIRS) & (F.col("size") - F.col("front") - F.col("back") > 1)
        light = rows.where(~heavy)
        left = light.where(~F.col("longer")).select(*keys, F.col("word").alias("a"), F.col("n").alias("a_n"))
        right = light.select(*keys, "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
        met = left.join(right, keys).where(F.col("longer") | (F.col("a") < F.col("b")))
        met = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")
        found = met if found is None else found.unionByName(met)
        open_ = rows.where(heavy).drop("head", "tail", "pairs")
        if open_.isEmpty():
            return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) links without cycles, by pointer doubling: the rounds follow the logarithm of the longest chain."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left")
        now = stage(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all ``words`` (word, n).

    ``form`` is the near word of the largest count (ties: the first in code-point order) if that is at least twice the word's own.
    Counts at least double along forms, so chains are short and have no cycles.
    """
    pairs = stage(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    twice = -F.col("best.less") >= 2 * F.col("n")
    known = stage(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(twice, F.col("best.near")).alias("form"), F.when(twice, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    return known.join(roots(known.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variant_digest(docs: DataFrame) -> DataFrame:
    """The result of the query: all words of ``documents`` with at least five code points and three occurrences."""
    return spelling_variants(stage(word_counts(docs), "words"))
