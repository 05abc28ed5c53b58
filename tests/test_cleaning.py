"""Values, labels, imputation and endpoints."""

import datetime
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.fixed_values import ENDPOINT_MUL_X, ENDPOINT_MUL_Y, ENDPOINT_XOR
from flowloom.functions.labels import binary_label, canonical_label, mapped_label
from flowloom.functions.values import to_number, to_timestamp
from flowloom.operators import cleaning, columns, quantiles, rows


def one(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {dtype}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("x"))).collect()]


def test_numbers(spark):
    got = one(spark, ["1", " -2.5e3 ", ".5", "7.", "Infinity", "NaN", "12d", "0x1F", "", None, "1,2", "-inf", "1e999"], to_number)
    assert got == [1.0, -2500.0, 0.5, 7.0] + [None] * 9


def test_timestamps(spark):
    got = one(spark, ["03/07/2017 08:55:58", "3/7/2017 8:55", "2017-07-03 08:55:58", "31/31/2017 00:00:00", "x", None], to_timestamp)
    at = datetime.datetime(2017, 7, 3, 8, 55, 58)
    assert got == [at, at.replace(second=0), at, None, None, None]


def test_canonical_labels(spark):
    raw = ["  Web Attack – XSS ", "Web Attack Â— XSS", "a​b", "x‐y‑z‒−", None]
    assert one(spark, raw, canonical_label) == ["Web Attack - XSS", "Web Attack - XSS", "ab", "x-y-z--", None]


def test_normalize_labels_composes_unicode(spark):
    raw = ["Ｂｏｔ", "Bot", "é", "ﬁle", "BENIGN", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(raw)], "k int, Label string")
    got = [r["Label"] for r in cleaning.normalize_labels(df).orderBy("k").collect()]
    assert got == [unicodedata.normalize("NFKC", x) if x else None for x in raw]


def test_binary_and_mapped_labels(spark):
    assert one(spark, [" benign", "Bot", None], binary_label) == ["BENIGN", "ATTACK", None]
    got = one(spark, ["Benign", "DDOS  attack-HOIC", "DoS attacks-Hulk", "Infilteration", None], mapped_label)
    assert got == ["BENIGN", "DDoS", "DoS Hulk", None, None]


def test_pseudo_endpoints_equal_unsigned_arithmetic(spark):
    files = ["a.csv", "ü.csv", "Friday-02-03.csv"]
    data = [(f, k) for f in files for k in range(400)]
    df = spark.createDataFrame(data, "SourceFile string, pos long")
    got = {(r["SourceFile"], r["pos"]): (r["Source IP"], r["Destination IP"]) for r in cleaning.assign_endpoints(df, ["pos"]).collect()}
    mask = np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for f, k in data:
            h = np.uint64(zlib.crc32(f.encode()))
            x = (h * np.uint64(ENDPOINT_MUL_X) + np.uint64(k)) & mask
            y = (h + np.uint64(k) * np.uint64(ENDPOINT_MUL_Y)) & mask
            y = y ^ np.uint64(ENDPOINT_XOR) if x == y else y
            want = tuple(f"10.{(int(v) >> 16) & 255}.{(int(v) >> 8) & 255}.{int(v) & 255}" for v in (x, y))
            assert got[f, k] == want


def test_large_row_numbers(spark):
    from flowloom.functions.values import pseudo_endpoints

    df = spark.createDataFrame([("a.csv", 2**31 + 5), ("a.csv", 2**32 + 7), ("a.csv", 7)], "f string, i long")
    got = [r[0] for r in df.select(pseudo_endpoints(F.col("f"), F.col("i"))[1]).collect()]
    assert got[1] == got[2] != got[0]


@pytest.mark.parametrize(
    "data, usable",
    [
        ([("0.0.0.0", "0.0.0.0"), (None, "nan")], False),
        ([("1.1.1.1", "2.2.2.2")] * 3, False),
        ([("1.1.1.1", "2.2.2.2"), ("1.1.1.1", "3.3.3.3")], True),
        ([("0.0.0.0", "0.0.0.0"), ("1.1.1.1", "0.0.0.0")], True),
    ],
)
def test_usable_endpoints(spark, data, usable):
    df = spark.createDataFrame(data, "`Source IP` string, `Destination IP` string")
    assert cleaning.has_usable_endpoints(df) is usable


def test_usable_endpoints_are_kept(spark):
    df = spark.createDataFrame([("1.1.1.1", "2.2.2.2", "f", 1), ("1.1.1.1", "3.3.3.3", "f", 2)],
                               "`Source IP` string, `Destination IP` string, SourceFile string, pos int")
    assert sorted(cleaning.assign_endpoints(df, ["pos"]).collect()) == sorted(df.collect())


def test_medians_and_imputation(spark):
    df = spark.createDataFrame([(1.0, None, 5), (None, None, 5), (4.0, None, 7)], "a double, b double, c int")
    assert cleaning.fit_medians(df) == {"a": 2.5, "b": 0.0, "c": 5.0}
    filled = cleaning.impute(df, {"a": 2.5, "b": 0.0}).collect()
    assert [r["a"] for r in filled] == [1.0, 2.5, 4.0] and all(r["b"] == 0.0 for r in filled)


@pytest.mark.parametrize("accuracy", [10_000, 20, 3])
def test_exact_quantiles(spark, accuracy):
    """Also with a sketch so coarse that brackets are wide, and a value held by a third of the rows."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(5000) < 0.33, 7.0, rng.normal(size=5000) * 10)
    y = rng.integers(0, 4, 5000).astype(float)
    df = spark.createDataFrame([(float(a), float(b) if b else None) for a, b in zip(x, y)], "`x y` double, y double")
    probs = (0.25, 0.5, 0.9)
    got = quantiles.exact_quantiles(df, ["x y", "y"], probs, accuracy)
    for p in probs:
        assert got["x y", p] == pytest.approx(np.quantile(x, p))
        assert got["y", p] == pytest.approx(np.quantile(y[y > 0], p))


def test_exact_quantiles_ranked_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LOCAL_RANK_ROWS", 0)
    df = spark.range(1001).selectExpr("cast(id AS double) AS v", "cast(NULL AS double) AS e")
    assert quantiles.exact_quantiles(df, ["v", "e"], (0.5,)) == {("v", 0.5): 500.0, ("e", 0.5): None}


def test_frequency_codes_with_missing(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "b", None, "c", "a", "b"]], "x string")
    coded, sizes = cleaning.encode_by_frequency(df, ["x"])
    assert sorted(r["x"] for r in coded.collect()) == [0, 0, 0, 1, 1, 2, 3] and sizes == {"x": 4}


def test_meta_by_substring():
    assert cleaning.meta_by_substring(["Source IP", "Zip", "Timestamp", "label", "SourceFile", "Flow"]) == [
        "Source IP", "Zip", "Timestamp", "label", "SourceFile"]


def test_row_report_counts_in_sequence(spark):
    data = [("", None, "d", None), ("x", None, "d", None), ("x", "s", " ", None), ("x", "s", "d", None),
            ("x", "s", "d", 1), ("x", "s", "d", 1)]
    df = spark.createDataFrame(data, "l string, s string, d string, t int")
    got = {r["item"]: r["rows"] for r in rows.row_clean_report(df, label="l", source="s", destination="d", timestamp="t").collect()}
    assert got == {"rows_before": 6, rows.DUPLICATE: 1, rows.NULL_LABEL: 1, rows.NO_SOURCE: 1, rows.NO_DESTINATION: 1,
                   rows.NO_TIMESTAMP: 1, "rows_after": 1}


def test_aliases_never_overwrite(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Src IP` int, `Source IP` int, `Dst IP` int")
    assert columns.apply_aliases(df).first().asDict() == {"Src IP": 1, "Source IP": 2, "Dst IP": 3, "Destination IP": 3}


def test_repeated_headers():
    assert columns.unique_names([" a ", "b", "a", "b  c", "a"]) == (["a", "b", "a#1", "b c", "a#2"], ["a#1", "a#2"])
