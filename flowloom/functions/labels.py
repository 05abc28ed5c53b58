"""Label text: canonical form, comparison key, binary and cross-vintage classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from flowloom.fixed_values import ATTACK, BENIGN, TAXONOMY
from flowloom.functions.values import stripped

# The no-break blank and six dash forms, mapped one to one;
# the stray accented letter and the zero-width blank, removed.
_FROM = "\u00a0\u2010\u2011\u2012\u2013\u2014\u2212"
_TO = " ------"
_REMOVED = ("\u00c2", "\u200b")


def canonical_label(label: Column | str) -> Column:
    """Repair encoding artefacts, unify dashes and blanks, keep the casing."""
    c = F.col(label) if isinstance(label, str) else label
    for junk in _REMOVED:
        c = F.replace(c, F.lit(junk), F.lit(""))
    c = F.translate(c, _FROM, _TO)
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def label_key(label: Column | str) -> Column:
    """Lower-case canonical label, for membership tests."""
    return F.lower(canonical_label(label))


def label_key_text(label: str) -> str:
    """``label_key`` of a literal that needs no repair (the label sets of this library)."""
    return " ".join(label.split()).lower()


def label_keys(labels) -> list[str]:
    return sorted({label_key_text(x) for x in labels})


def is_benign(label: Column | str) -> Column:
    """Benign test used where only blanks and casing vary."""
    c = F.col(label) if isinstance(label, str) else label
    return F.upper(stripped(c)) == BENIGN


def binary_label(label: Column | str) -> Column:
    """BENIGN stays, any other non-null label is an ATTACK."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(is_benign(c), BENIGN).when(c.isNotNull(), ATTACK)


def mapped_label(label: Column | str, mapping: dict[str, str] | None = None) -> Column:
    """Label in the training taxonomy; null when it has no counterpart there."""
    key = label_key(label)
    branches = None
    for source, target in (mapping or TAXONOMY).items():
        hit = key == label_key_text(source)
        branches = F.when(hit, target) if branches is None else branches.when(hit, target)
    return branches


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC form; no built-in expression offers it."""
    return text.str.normalize("NFKC")
