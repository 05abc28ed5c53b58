"""Quality rules by weak supervision (operator 6).

Each rule looks at one measure of a document and votes to keep it, votes to reject it, or abstains. No rule decides
alone: expectation-maximisation over the vote patterns of all documents estimates how often each rule votes what on
good and on bad documents, and the posterior probability of being good replaces all-must-pass filtering.

Measures and votes are column expressions. A vote pattern is one of ``3 ** rules``, so the pattern counts that the driver
works on are bounded whatever the corpus. The posterior is a sum of per-rule log odds, again a column expression.

Null and empty texts have no words: all measures are 0 and the document fails the base rule. Repeated
rows get equal verdicts; all other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.rows import free_name, identified
from flowloom.scratch import stage

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
KEEP, REJECT, ABSTAIN = 1, -1, 0
#: Rule: (measure, keep up to, reject from); in between it abstains.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 0.03, 0.15),
    "marks": ("n_marks / greatest(n_words, 1)", 0.08, 0.2),
    "capitals": ("n_upper / greatest(n_alnum, 1)", 0.15, 0.5),
    "letters": ("1 - n_alnum / greatest(word_chars, 1)", 0.06, 0.1),
    "bare": ("n_bare_words / greatest(n_words, 1)", 0.02, 0.1),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", 0.1, 0.3),
    "length": ("word_chars / greatest(n_words, 1)", 9.0, 14.0),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alnum", "n_marks", "n_bare_words")
#: Share of good documents and accuracy of every rule that the estimation starts from; one pseudo-vote of each kind is added.
PRIOR, ACCURACY, ROUNDS = 0.8, 0.85, 60


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that are found twice or more: sort the windows by hash, keep those equal to a neighbour, and measure what they cover."""

    def windows(w: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
            )
        )

    def places(s: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last"))
    return F.aggregate(let(let(words, windows), places), start, covered, lambda a: a["n"]).cast("long")


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text, all long."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    spoken = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    solid = F.translate(text, BLANKS, "")
    # One array of words serves three measures.
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_bare_words"),
        ),
    )
    lines = let(spoken, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "_words": counted,
        "_lines": lines,
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_alnum": F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")).cast("long"),
        "n_marks": _count_of(text, "!?|$%&*#<>{}[]="),
    }


def _hidden(df: DataFrame, text: str) -> tuple[DataFrame, str, dict[str, str]]:
    """``df`` without names that are needed here, the name of its text, and the new names of what was renamed."""
    own = {*MEASURES, "_words", "_lines", "base_failed", "quality", "kept"}
    new: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in own:
            name = f"_{c}"
            while name.lower() in own | {x.lower() for x in (*df.columns, *new.values())}:
                name = f"_{name}"
            new[c] = name
    return df.withColumnsRenamed(new), new.get(text, text), new


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of ``text``; a column of ``df`` that is called like one of them comes back with underscores in front."""
    df, text, _ = _hidden(df, text)
    out = df.withColumns(measures(F.col(text)))
    return out.select(*df.columns, *(F.col(f"_words.{c}") if c in ("n_words", "n_repeat_words", "n_bare_words") else F.col(f"_lines.{c}") if c in ("n_lines", "n_dup_lines") else F.col(c) for c in MEASURES))


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> list[Column]:
    """Each rule's vote on a measured document; a document without words is rejected by none."""
    return [
        F.when(F.col("n_words") == 0, ABSTAIN).when(F.expr(m) <= keep, KEEP).when(F.expr(m) >= reject, REJECT).otherwise(ABSTAIN)
        for m, keep, reject in RULES.values()
    ]


class Model:
    """Share of good documents, and per rule the probability of each vote on good and on bad documents."""

    def __init__(self, prior: float, rates: list[dict[bool, dict[int, float]]]):
        self.prior, self.rates = prior, rates

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(r[True][v] / r[False][v]) for r, v in zip(self.rates, pattern))

    def column(self) -> Column:
        """The posterior probability of being good, from the measures."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rate, vote in zip(self.rates, votes()):
            weigh = {v: math.log(rate[True][v] / rate[False][v]) for v in (KEEP, REJECT, ABSTAIN)}
            odds = odds + F.when(vote == KEEP, weigh[KEEP]).when(vote == REJECT, weigh[REJECT]).otherwise(weigh[ABSTAIN])
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: dict[tuple[int, ...], int], n_rules: int) -> Model:
    """Expectation-maximisation over pattern counts.

    It starts from rules that are right more often than not, which settles which of the two classes is the good one.
    Abstaining is a vote like the others, but starts out as telling nothing.
    """
    start = {True: {KEEP: ACCURACY / 2, REJECT: (1 - ACCURACY) / 2, ABSTAIN: 0.5}, False: {KEEP: (1 - ACCURACY) / 2, REJECT: ACCURACY / 2, ABSTAIN: 0.5}}
    model = Model(PRIOR, [start] * n_rules)
    total = sum(patterns.values())
    for _ in range(ROUNDS if total else 0):
        good = {p: 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(p))))) for p in patterns}
        share = sum(n * good[p] for p, n in patterns.items())
        rates = []
        for r in range(n_rules):
            seen = {side: {v: 1.0 for v in (KEEP, REJECT, ABSTAIN)} for side in (True, False)}
            for p, n in patterns.items():
                seen[True][p[r]] += n * good[p]
                seen[False][p[r]] += n * (1 - good[p])
            rates.append({side: {v: x / sum(s.values()) for v, x in s.items()} for side, s in seen.items()})
        model = Model((share + 1) / (total + 2), rates)
    return model


def fit(measured_df: DataFrame) -> Model:
    """Estimate from the votes on all documents; the driver gets one row per vote pattern, ``3 ** rules`` at most."""
    names = [f"v{k}" for k in range(len(RULES))]
    counts = measured_df.select(*(v.alias(n) for v, n in zip(votes(), names))).groupBy(*names).count().collect()
    return estimate({tuple(r[:-1]): r[-1] for r in counts}, len(names))


def _verdicts(rows: DataFrame, threshold: float) -> DataFrame:
    """Staged measured rows with ``base_failed``, ``quality`` (posterior) and ``kept``."""
    out = rows.withColumns({"base_failed": base_failed(), "quality": fit(rows).column()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def judged(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add the measures, ``base_failed``, ``quality`` (posterior) and ``kept`` to every row; the text goes.

    The text is measured once; the rows without it are written to the shared folder. A new column whose name is taken gets
    underscores in front.
    """
    hidden, own_text, new = _hidden(df, text)
    out = _verdicts(stage(measured(hidden, own_text).drop(own_text), "measures"), threshold)
    names = [m for m in out.columns if m not in hidden.columns]
    old = [c for c in df.columns if c != text]
    return out.select(*(F.col(new.get(c, c)).alias(c) for c in old), *(F.col(m).alias(free_name(df, m)) for m in names))


def keep_good(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that pass the base rule and are probably good, with their columns.

    Texts are measured once; the verdicts, one number a row, pick the rows of the second reading.
    """
    uid = free_name(df, "uid")
    rows = identified(df, uid)
    narrow = rows.select(F.col(uid).alias("uid"), F.col(text).alias("text"))
    good = _verdicts(stage(measured(narrow).drop("text"), "measures"), threshold).where("kept")
    return rows.join(good.select(F.col("uid").alias(uid)), uid, "left_semi").select(*df.columns)


def quality_digest(documents: DataFrame) -> DataFrame:
    """doc_id, the five base measures, base_failed and kept of every document."""
    rows = judged(documents.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
