"""Medians do not depend on how many columns there are."""

import statistics

import numpy as np

from flowloom.operators import cleaning


def test_wide_tables_have_exact_medians(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(1000, 12)).round(3)
    data[:, 3] = rng.integers(0, 3, 1000)
    names = [f"c{k}" for k in range(12)]
    rows = [[None if (i + k) % 11 == 0 else float(x) for k, x in enumerate(row)] for i, row in enumerate(data)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    want = {n: statistics.median([r[k] for r in rows if r[k] is not None]) for k, n in enumerate(names)}
    wide = cleaning.fit_medians(df)
    assert wide == want
    assert cleaning.fit_medians(df.select(names[:8])) == {n: wide[n] for n in names[:8]}
    few = spark.createDataFrame([tuple(float(k) for _ in range(9)) for k in (1, 2, 3, 4)], ", ".join(f"c{k} double" for k in range(9)))
    assert set(cleaning.fit_medians(few).values()) == {2.5} and set(cleaning.fit_medians(few, exact=False).values()) == {2.0}
