"""Numbers, timestamps and pseudo-endpoints from dirty text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from flowloom.fixed_values import (
    ENDPOINT_MUL_X,
    ENDPOINT_MUL_Y,
    ENDPOINT_XOR,
    NUMBER_PATTERN,
    TIMESTAMP_FORMATS,
)

_WORD = 0xFFFFFFFF
_HALF = 0xFFFF


def finite(value: Column) -> Column:
    """NaN and both infinities become null, so every aggregate skips them."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def to_number(text: Column) -> Column:
    """Number or null; rejects suffixes and spellings only the JVM would accept."""
    return finite(F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double")))


def _shape(pattern: str) -> str:
    """Regular expression of texts that can match a timestamp pattern."""
    fields = {1: "[0-9]{1,2}"}
    runs = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z]+)", pattern)
    return "^" + "".join(
        re.escape(literal) if literal else fields.get(1 + len(more), f"[0-9]{{{1 + len(more)}}}")
        for _, more, literal in runs
    ) + "$"


def to_timestamp(text: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """First format that parses, else null.

    A failed parse is far dearer than a pattern match, so each format is tried only on texts of its shape.
    """
    tries = [F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_filled(text: Column) -> Column:
    return F.coalesce(stripped(text.cast("string")) != "", F.lit(False))


def _ipv4(word: Column) -> Column:
    octets = [F.shiftright(word, 16), F.shiftright(word, 8), word]
    return F.concat_ws(".", F.lit("10"), *[o.bitwiseAND(255).cast("string") for o in octets])


def pseudo_endpoints(source_file: Column, row_index: Column) -> tuple[Column, Column]:
    """Deterministic 10.a.b.c source and destination of a row without endpoints.

    Only the low 32 bits of the products matter, so every factor is cut to a
    size whose product fits a signed BIGINT.
    """
    crc = F.crc32(F.encode(source_file, "UTF-8"))
    row = row_index.cast("long").bitwiseAND(_WORD)
    x = (crc * F.lit(ENDPOINT_MUL_X & _WORD)).bitwiseAND(_WORD) + row
    x = x.bitwiseAND(_WORD)
    low = row * F.lit(ENDPOINT_MUL_Y & _HALF)
    high = (row * F.lit(ENDPOINT_MUL_Y >> 16)).bitwiseAND(_HALF) * F.lit(1 << 16)
    y = (crc + low + high).bitwiseAND(_WORD)
    y = F.when(x == y, y.bitwiseXOR(F.lit(ENDPOINT_XOR))).otherwise(y)
    return _ipv4(x), _ipv4(y)


def named(column: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col(f"`{column}`")
