"""Running totals by exclusive or, over several partitions and with restarts."""

from functools import reduce
from operator import xor

from flowloom.operators.ordering import running_totals


def test_running_xor(spark):
    rows = [(k % 3, k, 1 << (k % 60), k) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, v long, w long").repartition(5)
    got = running_totals(df, ["k"], {"v": "x", "w": "s"}, restart_by="g", xor=["v"]).collect()
    for r in got:
        before = [x for x in rows if x[0] == r["g"] and x[1] <= r["k"]]
        assert r["x"] == reduce(xor, (x[2] for x in before)) and r["s"] == sum(x[3] for x in before)
    assert len(got) == 200
