"""Operator tests on small hand-made frames and the sf0.001 tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


# --- labels (D1) against the published counts ---------------------------------
FIXTURE_COUNTS_SF0001 = {("Repay", "Liquidated"): (210, 188), ("Withdraw", "Repay"): (202, 192),
                         ("Deposit", "Borrow"): (199, 186), ("Borrow", "Withdraw"): (188, 178)}


def test_transition_counts_match_fixtures(spark):
    import __spark_entry__ as E
    rows = {(r.index_event, r.outcome_event): (r.n_rows, r.n_events) for r in E.entry(spark).collect()}
    assert len(rows) == 16
    for k, v in FIXTURE_COUNTS_SF0001.items():
        assert rows[k] == v


def test_history_is_strictly_past(spark):
    """An event changes no earlier row: dropping the last event of every user
    leaves the history of the remaining rows unchanged."""
    from eventsurv.sources.events import load_events
    from eventsurv.operators.history import event_features, USER_HISTORY_COLUMNS
    ev = load_events(spark, SF_SMALL)
    full = event_features(ev).select("event_id", *USER_HISTORY_COLUMNS)
    last = ev.groupBy("user_id").agg(F.max("ts_us").alias("mx"))
    cut = ev.join(last, "user_id").where(F.col("ts_us") < F.col("mx")).drop("mx")
    part = event_features(cut).select("event_id", *USER_HISTORY_COLUMNS)
    a = full.join(part.select("event_id"), "event_id", "left_semi").exceptAll(part)
    assert a.count() == 0


def test_scans_do_not_depend_on_the_ranges(spark):
    from eventsurv.sources.events import load_events
    from eventsurv.operators import history as H
    ev = load_events(spark, SF_SMALL).select("event_id", "user_id", "ts_us", "action", "value")
    for scan, cols in ((H.market_scan, H.MARKET_HISTORY_COLUMNS), (H.user_scan, H.USER_HISTORY_COLUMNS + H.ACTIVITY_COLUMNS + list(H.NEXT_COLUMNS.values()))):
        one, many = (scan(ev, n).select("event_id", *cols) for n in (1, 23))
        assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_a_hot_user_day_and_a_burst_are_spread(spark):
    """90 % of the rows in one hour of one user: right counts, and no range holds them all."""
    from eventsurv.operators import history as H
    rnd = random.Random(4)
    hour = 3_600_000_000
    rows = [(i, 1, 10 * H.DAY_US + rnd.randrange(0, hour, 1_000_000) // (1 if i % 3 else 2), rnd.choice(H.ACTIONS), float(rnd.randint(1, 9))) for i in range(900)]
    rows += [(900 + i, rnd.randint(1, 6), rnd.randrange(0, 20 * H.DAY_US, 1_000_000), rnd.choice(H.ACTIONS), 2.0) for i in range(100)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts_us long, action string, value double").repartition(4)
    ranged = H._ranged(ev, ["user_id", "ts_us"], "test-ranges", 8)
    assert max(r["count"] for r in ranged.groupBy("_pid").count().collect()) < 400
    got = {r["event_id"]: r for r in H.user_scan(H.market_scan(ev, 8), 8).collect()}
    assert len(got) == 1000
    for e, u, t, _, _ in rows[::7]:
        before = [r for r in rows if r[1] == u and r[2] < t]
        days = {r[2] // H.DAY_US for r in rows if r[1] == u}
        g = got[e]
        assert g["userBorrowCount"] == sum(r[3] == "Borrow" for r in before) and g["userRepaySum"] == sum(r[4] for r in before if r[3] == "Repay")
        assert g["marketDepositCount"] == sum(r[3] == "Deposit" and r[2] < t for r in rows)
        assert g["userActiveDaysWeekly"] == sum(t // H.DAY_US - 7 <= d < t // H.DAY_US for d in days)
        assert g["userSecondsSincePreviousTransaction"] == ((t - max(r[2] for r in before)) // 1_000_000 if before else None)
        assert g["next_Repay_us"] == min((r[2] for r in rows if r[1] == u and r[2] > t and r[3] == "Repay"), default=None)


# --- running sums / ranks (§4.3a) ----------------------------------------------
@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_sums_partition_independent(spark, parts):
    from eventsurv.operators.prefix import running_sums
    rnd = random.Random(parts)
    rows = [(rnd.choice("ab"), i, rnd.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    out = running_sums(df, ["g"], [F.col("o")], ["v"], exclusive=True, partitions=parts).collect()
    exp = {}
    acc = {"a": 0, "b": 0}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        exp[(g, o)] = acc[g]
        acc[g] += v
    assert {(r.g, r.o): r.run_v for r in out} == exp


# --- C-index (§4.3c) --------------------------------------------------------------
def brute_force_pairs(df, group, time="timeDiff", event="status", score="score"):
    """The pair join itself."""
    a = df.select(*group, F.col(time).alias("ti"), F.col(event).alias("ei"), F.col(score).alias("si"))
    b = df.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col(time).alias("tj"),
                  F.col(event).alias("ej"), F.col(score).alias("sj"))
    cond = (F.col("ei") == 1) & ((F.col("ti") < F.col("tj")) | ((F.col("ti") == F.col("tj")) & (F.col("ej") == 0)))
    for g in group:
        cond = cond & (F.col(g) == F.col(f"_g_{g}"))
    p = a.join(b, cond, "inner")
    return p.groupBy(*group).agg(F.count_if(F.col("si") < F.col("sj")).alias("concordant"),
                                 F.count_if(F.col("si") == F.col("sj")).alias("tied"),
                                 F.count(F.lit(1)).alias("comparable"))


def test_cindex_matches_brute_force_with_ties(spark):
    from eventsurv.operators.concordance import pair_counts
    rnd = random.Random(7)
    rows = [(rnd.choice(["x", "y"]), float(rnd.randint(0, 12)), rnd.randint(0, 1), float(rnd.randint(0, 6)))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, timeDiff double, status int, score double")
    fast = {r.g: (r.concordant, r.tied, r.comparable) for r in pair_counts(df, ["g"]).collect()}
    slow = {r.g: (r.concordant, r.tied, r.comparable) for r in brute_force_pairs(df, ["g"]).collect()}
    assert fast == slow


def test_cindex_all_censored_is_null(spark):
    from eventsurv.operators.concordance import pair_counts
    df = spark.createDataFrame([("g", 1.0, 0, 1.0), ("g", 2.0, 0, 2.0)], "g string, timeDiff double, status int, score double")
    r = pair_counts(df, ["g"]).collect()
    assert r == [] or r[0].c_index is None


@pytest.mark.parametrize("cell_rows", [7, 50, 1 << 16])
def test_pair_counts_do_not_depend_on_the_cells(spark, cell_rows):
    """Frequent times and scores, NaN, odd statuses, null keys: equal to the brute force for every cut."""
    from eventsurv.operators.concordance import pair_counts
    rnd = random.Random(cell_rows)
    rows = [(rnd.choice("ab"), float(rnd.choice([0, 0, 1, 2, rnd.randint(3, 60)])), rnd.choice([0, 0, 1, 1, 1, 2]),
             rnd.choice([0.0, -0.0, 1.5, float("nan"), float("inf"), rnd.random(), rnd.random()])) for _ in range(300)]
    rows += [("one", 1.0, 1, 2.0), (None, 1.0, 1, 2.0), ("a", None, 1, 0.0), ("a", 1.0, None, 0.0), ("a", 1.0, 1, None)]
    df = spark.createDataFrame(rows, "g string, timeDiff double, status int, score double").repartition(3)
    got = {r.g: (r.concordant, r.tied, r.comparable, r.c_index) for r in pair_counts(df, ["g"], cell_rows=cell_rows).collect()}
    assert set(got) == {"a", "b", "one"} and got["one"] == (0, 0, 0, None)
    for g in "ab":
        of = [(t, 1 - d, (math.isnan(s), 0.0 if math.isnan(s) else s)) for k, t, d, s in rows if k == g and None not in (t, d, s)]
        pairs = [(x[2], y[2]) for x in of if x[1] == 0 for y in of if x[:2] < y[:2]]
        assert got[g][:3] == (sum(x < y for x, y in pairs), sum(x == y for x, y in pairs), len(pairs))


# --- preprocessing semantics ---------------------------------------------------------
def test_preprocess_nulls_constants_and_other(spark):
    from eventsurv.operators.preprocess import Preprocessor
    rows = [("A", "B", i, "train", 1.0, 1, float(i) if i % 3 else None, 5.0, ["p", "q", "r"][i % 3] if i % 4 else None)
            for i in range(30)]
    df = spark.createDataFrame(rows, "index_event string, outcome_event string, row_id int, split string, "
                                     "timeDiff double, status int, x double, const double, cat string")
    m = Preprocessor(top_k=2).fit(df)
    out = m.transform(df).collect()
    xs = [r.x for r in out]
    assert abs(sum(xs)) < 1e-9                      # mean 0, nulls -> 0
    assert all(r.const == 0.0 for r in out)         # constant column dropped (zeroed)
    assert {(r.column) for r in m.constant_columns().collect()} == {"const"}
    top = {r.level for r in m.top.collect()}
    assert len(top) == 2


def test_try_divide_denominator_minus_one(spark):
    from eventsurv.functions.features import d
    r = spark.range(1).select(d(F.lit(3.0), F.lit(-1.0) + 1).alias("v")).first()
    assert r.v is None


# --- Cox -------------------------------------------------------------------------------
def test_cox_score_equation_and_sign(spark):
    from eventsurv.operators.design import prepare_design
    from eventsurv.operators.linear_models import fit_cox_ridge
    from eventsurv.sources.materialize import Scratch
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=n)
    t = rng.exponential(1.0 / np.exp(0.8 * x))
    c = rng.exponential(2.0, size=n)
    rows = [("A", "B", float(min(ti, ci)), int(ti <= ci), float(xi)) for ti, ci, xi in zip(t, c, x)]
    df = spark.createDataFrame(rows, "index_event string, outcome_event string, timeDiff double, status int, x double")
    with Scratch(spark) as scratch:
        res = fit_cox_ridge(prepare_design(df, ["x"], scratch=scratch), penalizer=0.01)
    assert res.stats[0]["converged"] and res.stats[0]["score_norm"] < 1e-6
    assert res.coef[0][0] > 0.4


def test_cox_gradients_match_finite_differences(spark):
    """g = d loss / d margin for the Cox loss (Breslow), on tied data."""
    from eventsurv.operators.survival import cox_gradients
    rows = [("A", "B", i, float(t), s, m) for i, (t, s, m) in
            enumerate([(1, 1, 0.1), (1, 0, -0.2), (2, 1, 0.3), (2, 1, 0.0), (3, 0, 0.5), (4, 1, -0.4)])]
    df = spark.createDataFrame(rows, "index_event string, outcome_event string, row_id int, timeDiff double, status int, m double")
    g = {r.row_id: r.g for r in cox_gradients(df, F.col("m")).collect()}

    def loss(ms):
        tot = 0.0
        for i, (_, _, ri, ti, si, _) in enumerate(rows):
            if si:
                risk = sum(math.exp(ms[j]) for j, rr in enumerate(rows) if rr[3] >= ti)
                tot -= ms[i] - math.log(risk)
        return tot
    base = [r[5] for r in rows]
    for i in range(len(rows)):
        up = list(base); up[i] += 1e-6
        dn = list(base); dn[i] -= 1e-6
        assert abs((loss(up) - loss(dn)) / 2e-6 - g[i]) < 1e-5


# --- blends ---------------------------------------------------------------------------
def test_weighted_mean_renormalises(spark):
    from eventsurv.operators.ensemble import weighted_mean
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], "a double, b double, c double, d double, e double")
    w = [0.5, 0.2, 0.15, 0.1, 0.1]
    r = df.select(weighted_mean(list("abcde"), w).alias("m"), weighted_mean(list("abcde"), w, squared=True).alias("s")).first()
    assert abs(r.m - sum(x * y for x, y in zip(w, range(1, 6))) / 1.05) < 1e-12
    assert abs(r.s - sum(x * x * y for x, y in zip(w, range(1, 6))) / 1.05) < 1e-12


# --- F24-F30: rows travel narrow through the event scans ---------------------------
def test_the_written_event_table_holds_states_only(spark):
    """Only counts, sums and times are written; averages, logs and calendar columns follow on reading."""
    from eventsurv.operators import history as H
    from eventsurv.sources.events import load_events
    states = H.event_states(load_events(spark, SF_SMALL))
    assert len(states.columns) < 40 and not [c for c in states.columns if "Avg" in c or c.startswith(("sin", "cos", "log"))]
    assert set(H.FEATURE_COLUMNS) <= set(H.with_features(states).columns)


def test_a_cut_user_has_the_rows_of_an_uncut_one(spark):
    """A user cut by the time ranges, repeated rows, null times and null users: the same rows as in one range."""
    from eventsurv.operators import history as H
    rnd = random.Random(8)
    rows = [(i, 1 if i % 3 else rnd.randint(2, 9), rnd.randrange(0, 40 * H.DAY_US, 3_600_000_000), rnd.choice(H.ACTIONS), float(i % 7)) for i in range(400)]
    rows += rows[:50] + [(500, 1, None, "Borrow", 3.0), (501, None, H.DAY_US, "Repay", 2.0)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts_us long, action string, value double")
    one, cut = (H.user_scan(ev, n) for n in (1, 32))
    assert one.count() == 450 and one.exceptAll(cut).count() == 0 and cut.exceptAll(one).count() == 0


def test_row_std_needs_no_lambda(spark):
    from eventsurv.functions.features import row_std
    df = spark.createDataFrame([(1, 2, 6), (None, 4, 8), (None, None, 5)], "a long, b long, c long").select(row_std(F.col("a"), F.col("b"), F.col("c")).alias("s"))
    assert "lambda" not in df._jdf.queryExecution().toString()
    got = [r["s"] for r in df.collect()]
    assert got[0] == pytest.approx(7 ** 0.5) and got[1] == pytest.approx(8 ** 0.5) and got[2] is None


def test_selected_columns_are_not_unpivoted_first(spark):
    """a row gives its selected features only; nulls, repeated rows and foreign names included."""
    from eventsurv.operators.selection import select_long
    df = spark.createDataFrame([("A", "B", 1, "train", 1.0, None), ("A", "B", 1, "train", 1.0, None), ("A", "C", 2, "test", 3.0, 4.0), (None, "B", 3, "test", 5.0, 6.0)],
                               "index_event string, outcome_event string, row_id long, split string, x double, y double")
    sel = spark.createDataFrame([("A", "B", "x"), ("A", "B", "y"), ("A", "B", "y"), ("A", "C", "y"), ("A", "C", "z")], "index_event string, outcome_event string, feature string")
    out = select_long(df, sel, ["x", "y"], ["index_event", "outcome_event"])
    assert "Expand" not in out._jdf.queryExecution().toString()
    assert out.columns == ["index_event", "outcome_event", "row_id", "split", "feature", "value"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("A", "B", 1, "train", "x", 1.0), ("A", "B", 1, "train", "y", None)] * 2
                                                                + [("A", "C", 2, "test", "y", 4.0)], key=str)


def test_ordinal_rank_of_groups_cut_by_ranges(spark):
    """Ranks of groups cut by ranges, ties and null keys included."""
    from eventsurv.operators.ensemble import ordinal_rank
    from eventsurv.operators.prefix import row_numbers

    rows = [(g, i, "m", float(i * 7 % 5)) for g in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "index_event string, row_id long, model string, score double")
    for out in (row_numbers(df, ["index_event", "model"], [F.col("score"), F.col("row_id")], partitions=5), ordinal_rank(df, ["index_event"])):
        got = {(r["index_event"], r["row_id"]): r["rank"] for r in out.collect()}
        for g in ("a", None):
            order = sorted((s, i) for k, i, _, s in rows if k == g)
            assert [got[g, i] for _, i in order] == list(range(60))


def test_outcomes_of_an_index_event(spark):
    """An event has the outcomes of the labelled table."""
    from eventsurv.operators.history import event_features
    from eventsurv.operators.transitions import index_events, survival_table, with_outcomes
    from eventsurv.sources.events import action_col

    kinds = ["view", "signup", "click", "purchase", "error", "other", None]
    ev = spark.createDataFrame([(i, 10 ** 15 + i, i % 3, kinds[i % 7], float(i), None) for i in range(40)],
                               "event_id long, ts_us long, user_id long, event_type string, value double, props string")
    ev = ev.withColumn("ts", F.timestamp_micros("ts_us")).withColumn("action", action_col(F.col("event_type")))
    features = event_features(ev)
    names = ["index_event", "outcome_event", "row_id", "split"]
    want = survival_table(features, keep=[]).select(*names).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, with_outcomes(index_events(features)).select(*names).collect())) and want
