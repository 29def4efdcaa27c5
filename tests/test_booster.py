"""The booster against a plain NumPy version, and its M13-M18 behaviour."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventsurv.operators import boost_kernels as K
from eventsurv.operators import booster
from eventsurv.operators.boost_kernels import Run
from eventsurv.sources.materialize import Scratch

COLS = ["a", "b", "c", "dup"]
DDL = "index_event string, outcome_event string, row_id long, timeDiff double, status int, held boolean, " + ", ".join(f"{c} double" for c in COLS)


def rows(seed, n, group=("A", "B"), times=40, effect=1.0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, c = rng.normal(), float(rng.integers(0, 6)), rng.exponential()
        t = rng.exponential(np.exp(-effect * (a + (b > 3))))
        t = float(np.ceil(t * times))
        out.append((*group, 1000 * seed + i, t, int(rng.random() < 0.7), bool(i % 5 == 0), float(a), b, None if i % 11 == 0 else float(c), float(a)))
    return out


def plain_bins(x):
    """Quantile bins on the logarithmic grid, value by value."""
    mean = np.nanmean(x)
    cell = K.cells(np.where(np.isnan(x), mean, x))
    return np.array([int(np.floor((cell < v).sum() * K.BINS / len(cell))) for v in cell])


def plain_gradients(t, d, m):
    w = np.exp(m)
    s0 = np.array([w[t >= x].sum() for x in t])
    a = np.array([(d[t <= x] / s0[t <= x]).sum() for x in t])
    b = np.array([(d[t <= x] / s0[t <= x] ** 2).sum() for x in t])
    return w * a - d, w * a - w * w * b, float((d * (np.log(s0) - m)).sum() / d.sum())


def plain_tree(bins, g, h, run, node, depth, out, at):
    """Depth-first growth of one tree; ``out[at]`` takes the leaf values."""
    G, H = g[at].sum(), h[at].sum()
    best = (K.MIN_GAIN, None)
    if depth < run.max_depth:
        for f in range(len(bins)):
            for b in range(K.BINS - 1):
                left = bins[f, at] <= b
                gl, hl = g[at][left].sum(), h[at][left].sum()
                if hl < run.min_child_weight or H - hl < run.min_child_weight or left.sum() < run.min_leaf or (~left).sum() < run.min_leaf:
                    continue
                gain = round(float(K.split_score(gl, hl, run) + K.split_score(G - gl, H - hl, run) - K.split_score(G, H, run)), K.GAIN_DIGITS)
                if gain > best[0]:
                    best = (gain, (f, b))
    value = -run.eta * float(K.threshold(np.float64(G), run.alpha)) / (H + run.lam)
    if best[1] is None:
        out[at] = value
        return True, 0.0
    f, b = best[1]
    left = bins[f, at] <= b
    leaves = [plain_tree(bins, g, h, run, 2 * node + k, depth + 1, out, at[side])[0] for k, side in enumerate((left, ~left))]
    if all(leaves) and best[0] < run.gamma:
        out[at] = value
        return True, 0.0
    return False, best[0]


def plain_boost(data, run):
    t, d = np.array([r[3] for r in data]), np.array([r[4] for r in data], float)
    x = np.array([[np.nan if v is None else v for v in r[6:]] for r in data], float).T
    bins = np.array([plain_bins(c) for c in x])
    m, losses = np.zeros(len(t)), []
    for _ in range(run.rounds):
        g, h, loss = plain_gradients(t, d, m)
        losses.append(loss)
        out = np.zeros(len(t))
        plain_tree(bins, g, h, run, 1, 0, out, np.arange(len(t)))
        m = m + out
    return m, losses + [plain_gradients(t, d, m)[2]]


@pytest.mark.parametrize("block", [1 << 16, 16])
@pytest.mark.parametrize("gamma", [0.0, 2.0])
def test_cox_booster_equals_a_plain_one(spark, monkeypatch, block, gamma):
    monkeypatch.setattr(booster, "BLOCK_ROWS", block)
    monkeypatch.setattr(booster, "CHECKPOINT", 2)
    monkeypatch.setattr(booster, "FAN_IN", 1 if block == 16 else 256)
    data = {("A", "B"): rows(1, 160), ("C", "D"): rows(2, 90, ("C", "D"), times=3)}
    df = spark.createDataFrame(sum(data.values(), []), DDL)
    run = Run(0, 0, 0, rounds=5, max_depth=3, eta=0.5, lam=1.5, alpha=0.2, gamma=gamma, min_child_weight=1.0, min_leaf=3)
    with Scratch(spark) as scratch:
        b = booster.prepare(df, COLS, scratch=scratch)
        model = booster.train(b, [Run(**{**run.__dict__, "group": i}) for i in range(2)])
        got = {r["row_id"]: r["margin"] for r in model.margins(df).collect()}
    for i, (key, part) in enumerate(data.items()):
        want, losses = plain_boost(part, run)
        assert np.allclose([got[r[2]] for r in part], want, atol=1e-9)
        assert np.allclose([x for r, p, n, x in model.trace if r == i], losses, atol=1e-9)
        assert losses[1] < losses[0] and all(a >= b - 1e-12 for a, b in zip(losses, losses[1:]))


def test_squared_loss_leaves_and_falling_rmse(spark):
    data = rows(3, 200)
    df = spark.createDataFrame(data, DDL)
    with Scratch(spark) as scratch:
        b = booster.prepare(df, COLS, base=True, scratch=scratch)
        model = booster.train(b, [Run(0, 0, 0, objective="l2", rounds=4, max_depth=3, eta=0.5, lam=1.0, alpha=1.0, gamma=0.1, min_leaf=20, min_child_weight=0.0)])
        trace = [x for _, _, _, x in model.trace]
        got = {r["row_id"]: r["margin"] for r in model.margins(df).collect()}
    t = np.array([r[3] for r in data])
    assert abs(trace[0] - t.std()) < 1e-9 and all(a > b for a, b in zip(trace, trace[1:]))
    assert abs(trace[-1] - np.sqrt(np.mean((t - np.array([got[r[2]] for r in data])) ** 2))) < 1e-9
    leaves = [s for s in model.splits if s[3] < 0]
    assert all(s[6] >= 20 for s in leaves)


def test_a_poisoned_transition_leaves_the_others_equal(spark):
    good, bad = rows(1, 120), [(*r[:3], float("nan") if i == 7 else r[3], *r[4:]) for i, r in enumerate(rows(2, 60, ("C", "D")))]
    run = dict(slot=0, rounds=3, max_depth=3)
    with Scratch(spark) as scratch:
        alone = booster.train(booster.prepare(spark.createDataFrame(good, DDL), COLS, scratch=scratch), [Run(0, 0, **run)])
        both = booster.prepare(spark.createDataFrame(good + bad, DDL), COLS, expected=[("A", "B"), ("C", "D"), ("E", "F")], scratch=scratch)
        model = booster.train(both, [Run(0, g, **run) for g in range(3)])
        status = {(r["index_event"], r["status"], r["message"]) for r in model.status_table(spark).collect()}
        scored = {r["index_event"] for r in model.margins(spark.createDataFrame(good + bad, DDL)).collect()}
    assert status == {("A", "ok", ""), ("C", "error", "1 rows without a usable duration, status or row_id"), ("E", "error", "no training rows")}
    assert [s[1:] for s in model.splits] == [s[1:] for s in alone.splits] and model.trace == alone.trace and scored == {"A"}


def test_early_stopping_keeps_the_best_round(spark):
    df = spark.createDataFrame(rows(4, 200, effect=0.3), DDL)
    with Scratch(spark) as scratch:
        b = booster.prepare(df, COLS, valid=F.col("held"), scratch=scratch)
        model = booster.train(b, [Run(0, 0, 0, rounds=30, max_depth=5, eta=0.8, min_child_weight=0.1, patience=3)])
    valid = [x for _, p, _, x in model.trace if p == booster.VALID]
    assert len(model.trees[0]) == model.best_round[0] == int(np.argmin(valid)) and len(valid) == model.best_round[0] + 4 < 31
    train = [x for _, p, _, x in model.trace if p == booster.TRAIN]
    assert train[-1] < train[0]


def test_gain_importance_and_two_stages(spark):
    df = spark.createDataFrame(rows(5, 200), DDL)
    with Scratch(spark) as scratch:
        b = booster.prepare(df, COLS, scratch=scratch)
        first, top, second = booster.two_stage(b, [Run(0, 0, 0, rounds=3, max_depth=4)], 2)
        gains = {}
        for s in first.splits:
            if s[3] >= 0:
                gains.setdefault(b.features[s[3]], []).append(s[5])
        got = {r["feature"]: (r["gain"], r["n_splits"]) for r in first.importance(spark).collect()}
        best = {r["feature"] for r in top.collect()}
    assert {f: (pytest.approx(np.mean(v)), len(v)) for f, v in gains.items()} == got and all(v > 0 for v, _ in got.values())
    assert best == set(sorted(gains, key=lambda f: (-round(np.mean(gains[f]), 6), f))[:2])
    assert {b.features[s[3]] for s in second.splits if s[3] >= 0} <= best


def test_draws_are_hashed_and_near_their_share():
    ids = np.arange(20000)
    a = K.drawn(ids, 0.3, 42, 1)
    assert abs(a.mean() - 0.3) < 0.02 and (a[::2] == K.drawn(ids[::2], 0.3, 42, 1)).all() and (a != K.drawn(ids, 0.3, 42, 2)).any()
    assert K.column_draw(Run(0, 0, 0, colsample=0.5), 112, 1).sum() == 56
    assert K.column_draw(Run(0, 0, 0, colsample=0.5, features=(1, 5, 7)), 112, 1).sum() == 1


def test_empty_table(spark):
    with Scratch(spark) as scratch:
        b = booster.prepare(spark.createDataFrame([], DDL), COLS, expected=[("A", "B")], scratch=scratch)
        model = booster.train(b, [Run(0, 0, 0)])
        assert [r["status"] for r in model.status_table(spark).collect()] == ["error"]


def test_ensemble_blends_equal_weighted_members(spark):
    from eventsurv.operators.survival_ensemble import SurvivalEnsemble, train_ensemble_models
    data = rows(6, 120) + rows(7, 80, ("C", "D")) + [("E", "F", 9_000_000, None, 1, False, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, DDL)
    members = [({"max_depth": 2, "eta": 0.3, "seed": 1}, 3, 0.5), ({"max_depth": 3, "eta": 0.1, "subsample": 0.7, "lambda": 2.0, "seed": 2}, 2, 0.2)]
    blended, model = train_ensemble_models(df, COLS, df, members)
    member = {}
    for r in model.scores(df).collect():
        member.setdefault((r["index_event"], r["row_id"]), {})[r["run"]] = r["score"]
    assert {k[0] for k in member} == {"A", "C"} and all(s < 0 for m in member.values() for s in m.values())
    mean = {(r["index_event"], r["row_id"]): r["score"] for r in blended.collect()}
    square = {(r["index_event"], r["row_id"]): r["score"] for r in model.predict(df, blend="squared").collect()}
    for k, m in member.items():
        assert mean[k] == pytest.approx((0.5 * m["m1"] + 0.2 * m["m2"]) / 0.7)
        assert square[k] == pytest.approx((0.25 * m["m1"] + 0.04 * m["m2"]) / 0.7)
    want = {}
    for group in ("A", "C"):
        ids = [k for k in member if k[0] == group]
        for name, weight in (("m1", 0.5), ("m2", 0.2)):
            for place, k in enumerate(sorted(ids, key=lambda k: (member[k][name], k[1]))):
                want[k] = want.get(k, 0.0) + weight * place / 0.7
    rank = {(r["index_event"], r["row_id"]): r["score"] for r in model.predict(df, blend="rank").collect()}
    assert rank == {k: pytest.approx(v) for k, v in want.items()}
    # own members per transition: the run table decides who trains what
    own = SurvivalEnsemble().add_model({"max_depth": 1}, 1, 1.0, ("A", "B")).add_model({"max_depth": 2}, 2, 3.0, ("C", "D"))
    m = own.fit(df, COLS).boosted
    assert {(*m.binned.groups[r.group], r.rounds) for r in m.runs} == {("A", "B", 1), ("C", "D", 2)}


def test_rows_move_as_one_byte_a_feature(spark):
    """Rows are binned where they are read and move without their 8-byte values; blocks hold the same bins."""
    from unittest import mock
    rows = [("A", "B" if i % 3 else "C", i, float((i * 37) % 50), i % 2, None if i % 7 == 0 else float(i % 11), float(i % 5) if i % 4 else float("nan")) for i in range(200)]
    df = spark.createDataFrame(rows, "index_event string, outcome_event string, row_id long, timeDiff double, status int, a double, b double").repartition(3)
    seen, real = [], booster.in_time_ranges

    def watch(moved, times, sizes):
        seen.append((moved.schema["x"].dataType.simpleString(), times.columns, sizes))
        return real(moved, times, sizes)
    with Scratch(spark) as scratch, mock.patch.object(booster, "in_time_ranges", watch):
        b = booster.prepare(df, ["a", "b"], scratch=scratch)
        assert seen == [("binary", ["grp", "t"], {0: 133, 1: 67})]
        value = {r[2]: [np.nan if v is None else v for v in r[5:]] for r in rows}
        count = 0
        for r in b.blocks.collect():
            ids, t = np.frombuffer(r["row_id"], np.int64), np.frombuffer(r["t"])
            x = np.array([value[i] for i in ids])
            want = booster.K.to_bins(x, b.means[r["grp"]], b.cuts[r["grp"]])
            assert (np.frombuffer(r["bins"], np.uint8).reshape(2, r["n"]) == want).all() and (np.diff(t) <= 0).all()
            count += r["n"]
        assert count == 200
        for g in (0, 1):
            of = [r for r in rows if b.groups[g] == r[:2]]
            assert b.means[g].tolist() == pytest.approx([np.mean([r[5] for r in of if r[5] is not None]), np.nanmean([r[6] for r in of])])


def test_first_split_moves_bytes_and_equals_a_direct_search(spark):
    """rows meet their gradients with one byte a feature; nulls count for no bin."""
    from eventsurv.operators.boosting import best_first_split, equal_width_bins
    rows = [("A", "B", i, float(i % 9), None if i % 5 == 0 else float(i * i % 23), 2.0, (i % 4) - 1.3, 0.5 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "index_event string, outcome_event string, row_id long, a double, b double, c double, g double, h double")
    binned = equal_width_bins(df, ["a", "b", "c"], 4)
    assert binned.schema["bins"].dataType.simpleString() == "array<tinyint>"
    r = best_first_split(binned.join(df.select("row_id", "g", "h"), "row_id"), ["a", "b", "c"]).collect()
    best = []
    for f, at in (("a", 3), ("b", 4)):
        known = [x for x in rows if x[at] is not None]
        lo, hi = min(x[at] for x in known), max(x[at] for x in known)
        cell = [min(int((x[at] - lo) / (hi - lo) * 4), 3) for x in known]
        total = [sum(x[i] for x in known) for i in (6, 7)]
        for k in range(3):
            left = [sum(x[i] for x, c in zip(known, cell) if c <= k) for i in (6, 7)]
            right = [total[0] - left[0], total[1] - left[1]]
            if min(left[1], right[1]) >= 1:
                best.append((0.5 * sum(s * q[0] ** 2 / (q[1] + 1) for s, q in ((1, left), (1, right), (-1, total))), f, k))
    gain, feature, k = max(best)
    assert len(r) == 1 and (r[0]["feature"], r[0]["bin"]) == (feature, k) and r[0]["gain"] == pytest.approx(gain)


@pytest.mark.parametrize("more", [dict(gamma=1.0, subsample=0.7, colsample=0.5, seed=3), dict(objective="l2", min_leaf=9, alpha=0.4), dict(patience=2, eta=0.9, min_child_weight=0.0)])
def test_rounds_in_one_task_equal_rounds_in_jobs(spark, monkeypatch, more):
    """Hundreds of rounds of a transition that fits into a task are one job, with the trees of a job a level."""
    monkeypatch.setattr(booster, "BLOCK_ROWS", 16)
    monkeypatch.setattr(booster, "CHECKPOINT", 2)
    monkeypatch.setattr(booster, "FAN_IN", 1)
    df = spark.createDataFrame(rows(1, 150, times=4) + rows(2, 90, ("C", "D")), DDL)
    run, jobs = Run(0, 0, 0, **{"rounds": 4, "max_depth": 4, "eta": 0.4, **more}), []
    real = booster.Trainer._grow
    monkeypatch.setattr(booster.Trainer, "_grow", lambda self, *a: jobs.append(1) or real(self, *a))
    with Scratch(spark) as scratch:
        b = booster.prepare(df, COLS, valid=F.col("held") if run.patience else None, base=run.objective == "l2", slots=2, scratch=scratch)
        runs = [Run(**{**run.__dict__, "group": g, "max_depth": d}) for g in range(2) for d in (4, 2)]
        whole = booster.train(b, runs)
        assert not jobs
        monkeypatch.setattr(booster, "COPIED_BYTES", 0)
        shared = booster.train(b, runs)
        assert not jobs and shared.splits == whole.splits and shared.trace == whole.trace
        monkeypatch.setattr(booster, "TASK_BYTES", 0)
        parts = booster.train(b, runs)
        assert jobs
        table = [r.asDict() for r in whole.split_table(spark).orderBy("index_event", "round", "node").collect()]
    assert whole.status == parts.status and whole.best_round == parts.best_round
    assert [x[:3] for x in whole.trace] == [x[:3] for x in parts.trace] and np.allclose([x[3] for x in whole.trace], [x[3] for x in parts.trace], atol=1e-9)
    assert [s[:5] for s in whole.splits if s[3] >= 0] == [s[:5] for s in parts.splits if s[3] >= 0] and len(whole.splits) == len(parts.splits) == len(table)
    assert np.allclose([s[5:] for s in whole.splits], [s[5:] for s in parts.splits], atol=1e-8)
    assert {r["feature"] for r in table} == {b.features[s[3]] if s[3] >= 0 else None for s in whole.splits}


def test_named_trainings_take_the_rounds_of_their_tables(spark, tmp_path, monkeypatch):
    """the queries ran 5 rounds instead of the 600 to 1500 of their run tables."""
    from eventsurv.operators import survival_ensemble
    from eventsurv.plans import configs as C, q_boost
    data = [(i, f"2024-01-0{1 + i % 9} 00:00:{i % 60:02d}", i % 5, ["view", "signup", "click", "purchase", "error"][i * 7 % 11 % 5], float(i % 13), "") for i in range(300)]
    df = spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    asked = []

    class Stop(Exception):
        pass

    def watch(binned, runs, *_):
        asked.append({(*binned.groups[r.group], r.name): r.rounds for r in runs})
        raise Stop
    monkeypatch.setattr(q_boost, "train", watch)
    monkeypatch.setattr(survival_ensemble, "train", watch)
    for name in (q_boost._boosted, q_boost._ensemble):
        with pytest.raises(Stop):
            name(spark, str(tmp_path))
    assert asked[0] == {(i, o, ""): n for i, o, n in C.TRANSITION_ROUNDS}
    assert len(asked[1]) == 48 and asked[1]["Withdraw", "Repay", "m1"] == 900 and asked[1]["Repay", "Withdraw", "m1"] == 1500 and min(asked[1].values()) == 900


def test_leaderboard_scores_every_row_once(spark, tmp_path, monkeypatch):
    """members and blends read the members' scores; each of the four had applied all trees again."""
    from eventsurv.operators.survival_ensemble import SurvivalEnsemble
    from eventsurv.plans import q_boost
    df = spark.createDataFrame(rows(6, 90) + rows(7, 60, ("C", "D")), DDL)
    model = SurvivalEnsemble().add_model({"max_depth": 2}, 3, 0.5).add_model({"max_depth": 1}, 2, 0.2).fit(df, COLS)
    applied, real = [], booster.Boosted.margins
    monkeypatch.setattr(booster.Boosted, "margins", lambda self, *a: applied.append(1) or real(self, *a))
    want = {b: {tuple(r) for r in model.predict(df, blend=b).collect()} for b in ("mean", "squared", "rank")}
    assert len(applied) == 3
    scores = model.scores(df)
    assert all({tuple(r) for r in model.blend(scores, blend=b).collect()} == want[b] for b in want) and len(applied) == 4
    monkeypatch.setattr(q_boost, "_ensemble", lambda *a: model)
    monkeypatch.setattr(q_boost, "_split", lambda *a: df)
    applied.clear()
    board = {(r["index_event"], r["model"]) for r in q_boost.q_ensemble_leaderboard(spark, str(tmp_path)).collect()}
    assert len(applied) == 1 and board == {(g, m) for g in "AC" for m in ("m1", "m2", "mean", "squared", "rank")}


def test_columns_are_computed_twice_to_be_binned(spark):
    """One pass for means and cells, one for bins (three before); missing values lie in the cell of the mean."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(v):
        seen.add(1)
        return v
    data = rows(1, 60) + [(*r[:8], None, None) for r in rows(2, 40, ("C", "D"))]
    df = spark.createDataFrame(data, DDL).withColumn("c", watched("c"))
    with Scratch(spark) as scratch:
        b = booster.prepare(df, COLS, scratch=scratch)
        assert seen.value == 200
        got = {}
        for r in b.blocks.collect():
            got.update(zip(np.frombuffer(r["row_id"], np.int64).tolist(), np.frombuffer(r["bins"], np.uint8).reshape(len(COLS), -1).T))
    for group in ("A", "C"):
        part = [r for r in data if r[0] == group]
        x = np.array([[np.nan if v is None else v for v in r[6:]] for r in part], float).T
        for f in range(len(COLS)):
            want = plain_bins(x[f]) if np.isfinite(x[f]).any() else np.zeros(len(part))
            assert [got[r[2]][f] for r in part] == want.tolist()
