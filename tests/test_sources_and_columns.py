"""Readers and writers of the per-transition layout, preprocessing edges,
quantiles by counting and correlations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("pool", T.StringType()),
                       T.StructField("timeDiff", T.DoubleType()), T.StructField("status", T.IntegerType())])


def test_transition_csv_reader_takes_the_keys_from_the_path(spark, tmp_path):
    from eventsurv.sources.sinks import TEST_FILE, TRAIN_FILE, read_transition_csv
    for i, o, n in (("Borrow", "Repay", 3), ("Deposit", "Withdraw", 2)):
        d = tmp_path / i / o
        d.mkdir(parents=True)
        pd.DataFrame({"amount": [1.5 * k for k in range(n)], "pool": ["a,b"] * n, "timeDiff": [10.0] * n, "status": [1] * n}).to_csv(d / TRAIN_FILE, index=False)
        pd.DataFrame({"amount": [9.0], "pool": ["x"], "timeDiff": [1.0], "status": [0]}).to_csv(d / TEST_FILE, index=False)
    got = read_transition_csv(spark, str(tmp_path), TRAIN_FILE, SCHEMA)
    assert {(r[0], r[1], r["n"]) for r in got.groupBy("index_event", "outcome_event").agg(F.count("*").alias("n")).collect()} == {
        ("Borrow", "Repay", 3), ("Deposit", "Withdraw", 2)}
    assert got.where("pool = 'a,b'").count() == 5 and got.schema["amount"].dataType == T.DoubleType()
    assert read_transition_csv(spark, str(tmp_path), TEST_FILE, SCHEMA).count() == 2


def test_predictions_and_reduced_data_come_back(spark, tmp_path):
    from eventsurv.sources.sinks import prediction_table, write_predictions, write_reduced
    rows = [("Borrow", "Repay", i, float(-i)) for i in (3, 1, 2)] + [("Deposit", "Borrow", 7, 0.5)]
    scored = prediction_table(spark.createDataFrame(rows, "index_event string, outcome_event string, row_id long, score double").repartition(3))
    write_predictions(scored, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).select("index_event", "outcome_event", "row_id", "score")
    assert {tuple(r) for r in back.collect()} == set(rows)
    write_predictions(scored, str(tmp_path / "c"), csv=True)
    files = list((tmp_path / "c" / "index_event=Borrow" / "outcome_event=Repay").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().split() == ["-1.0", "-2.0", "-3.0"]       # no header, in row order
    write_reduced(scored, str(tmp_path / "r"), ["row_id", "score"])
    reduced = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert {(r["index_event"], r["row_id"], r["score"]) for r in reduced.collect()} == {(r[0], str(r[2]), str(r[3])) for r in rows}


def test_identifiers_go_and_test_columns_are_aligned(spark):
    from eventsurv.operators.preprocess import DROP_COLUMNS, Preprocessor
    train = spark.createDataFrame([("A", "B", i, 1.0, 1, "id", "u", float(i), float(i * i)) for i in range(10)],
                                  "index_event string, outcome_event string, row_id int, timeDiff double, status int, id string, user string, x double, gone double")
    model = Preprocessor().fit(train)
    out = model.transform(train)
    assert not set(out.columns) & set(DROP_COLUMNS) and {"x", "gone"} <= set(out.columns)
    test = spark.createDataFrame([("A", "B", 1, 4.5, 7.0)], "index_event string, outcome_event string, row_id int, x double, extra double")
    row = model.transform(test).first()
    sd = np.std(np.arange(10) ** 2)
    assert row["x"] == pytest.approx(0.0) and row["gone"] == pytest.approx(-np.mean(np.arange(10) ** 2) / sd) and "extra" not in row.asDict()


def test_a_transition_without_parameters_gets_the_default(spark):
    from eventsurv.plans import configs as C
    pairs = spark.createDataFrame([("Borrow", "Repay"), ("Mint", "Burn")], "index_event string, outcome_event string")
    got = {r["index_event"]: r for r in C.params_with_default(pairs).collect()}
    assert (got["Mint"]["rounds"], got["Mint"]["max_depth"], got["Mint"]["is_default"]) == (800, 6, True)
    assert (got["Borrow"]["rounds"], got["Borrow"]["max_depth"], got["Borrow"]["is_default"]) == (1000, 5, False)


def test_quantiles_by_counting_with_ties_and_caps(spark):
    from eventsurv.operators.capping import cap_diagnostics, exact_quantiles
    rng = np.random.default_rng(1)
    data = {("A", "B"): np.where(rng.random(400) < 0.9, 7.0, rng.exponential(20, 400)), ("C", "D"): rng.exponential(5, 31), ("E", "F"): np.array([3.0])}
    rows = [(*k, float(v), int(i % 2)) for k, x in data.items() for i, v in enumerate(x)] + [("A", "B", None, 1)]
    df = spark.createDataFrame(rows, "index_event string, outcome_event string, timeDiff double, status int")
    for r in exact_quantiles(df, "timeDiff", [0.0, 0.5, 0.98, 1.0]).collect():
        assert r["value"] == pytest.approx(np.quantile(data[r[0], r[1]], r["q"]))
    for r in cap_diagnostics(df.where("timeDiff is not null"), 0.9).collect():
        x = data[r[0], r[1]]
        cap = np.quantile(x, 0.9)
        assert (r["cap"], r["median_t"], r["median_t_capped"]) == pytest.approx((cap, np.median(x), np.median(np.clip(x, 0, cap))))


def test_pairwise_complete_correlations(spark):
    from eventsurv.operators.selection import correlation_matrix
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 1e6, 1e-3, 1] + [0, 1e9, 0, 5]
    x[:, 3] = 5.0
    x[rng.random((300, 4)) < 0.2] = np.nan
    cols = ["a", "b", "c", "flat"]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols))
    got = {(r[0], r[1]): r[2] for r in correlation_matrix(df.repartition(5), cols, fan_in=2).collect()}
    for i in range(3):
        for j in range(i + 1, 3):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[cols[i], cols[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert got["a", "flat"] is None and len(got) == 6
