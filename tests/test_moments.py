"""Moments of many columns per transition against plain NumPy."""

import math

import numpy as np
from pyspark.sql import functions as F


def _rows():
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        x = None if i % 11 == 0 else float(rnd.normal(1e6, 1.0))
        rows.append(("A" if i % 3 else None, "B", x, 0.1, math.nan if i % 7 == 0 else float(rnd.integers(0, 9)), None if i % 13 == 0 else float(rnd.normal())))
    return rows


def test_moments_equal_numpy_and_constants_vary_by_nothing(spark):
    from eventsurv.operators.moments import column_moments
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, l string, a double, b double, c double, y double").repartition(7)
    got = column_moments(df, ["a", "b", "c"], ["k", "l"], F.col("y"))
    plain = column_moments(df, ["a", "b", "c"], ["k", "l"])
    assert set(got) == {("A", "B"), (None, "B")}
    for key, m in got.items():
        for i in range(3):
            both = [(r[2 + i], r[5]) for r in rows if r[0] == key[0] and r[2 + i] is not None and not math.isnan(r[2 + i])]
            x = np.array([b[0] for b in both])
            p = plain[key][:, i]
            assert p[0] == len(x) and np.isclose(p[1], x.mean(), rtol=1e-14) and p[3] == x.min() and p[4] == x.max()
            assert np.isclose(p[2], ((x - x.mean()) ** 2).sum(), rtol=1e-9) if i != 1 else p[2] == 0.0
            x, y = np.array([b for b in both if b[1] is not None]).T
            assert m[0, i] == len(x) and np.isclose(m[6, i], ((y - y.mean()) ** 2).sum())
            assert np.isclose(m[7, i], ((x - x.mean()) * (y - y.mean())).sum(), atol=1e-8)


def test_statistics_unpivot_no_rows(spark):
    """no row is unpivoted over the columns, a constant column gives no correlation."""
    from eventsurv.operators.preprocess import column_stats
    from eventsurv.operators.selection import label_correlations
    df = spark.createDataFrame(_rows(), "k string, l string, a double, b double, c double, y double").where("k is not null")
    st = column_stats(df, ["a", "b", "c"], ["k", "l"])[("A", "B")]
    assert st["b"] == (0.1, 0.0, 0.1, 0.1)
    r = {x["feature"]: x["r"] for x in label_correlations(df.where("not isnan(c)"), ["a", "b", "c"], F.col("y"), ["k", "l"]).collect()}
    assert r["b"] is None and abs(r["a"]) < 0.2 and abs(r["c"]) < 0.2


def test_rounding_without_decimals(spark):
    from eventsurv.plans.catalog import rounded
    xs = [0.1234565001, -0.1234565001, 1.0000005, -0.0000001, 1e13 + 0.25, -2.5e15, 0.0, None, math.nan, math.inf]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r["x"] for r in rounded(df).collect()]
    assert got[:2] == [0.123457, -0.123457] and str(got[3]) == "0.0" and got[4:7] == [1e13 + 0.25, -2.5e15, 0.0]
    assert got[7] is None and math.isnan(got[8]) and got[9] == math.inf
