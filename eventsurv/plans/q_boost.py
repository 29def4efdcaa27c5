"""Booster queries (M10-M18, W2 by gain, E1-E4 and C4 on trained scores).

All train on every labelled training row of all transitions and all 112
numeric columns.  The first tree and the gradients after it are stated in SQL
too (one level of a tree per CTE); the others have no SQL form and are held
against a plain NumPy booster in the tests.

The trainings of M12 (``cox_boost_*``, ``fit_status``) and of the strategy table
(``ensemble_*``) run the rounds of their run tables (600 to 1500).
``QUERY_ROUNDS`` is the number of rounds of ``early_stop``,
``two_stage_selection``, ``l2_boost_trace`` and ``five_model_scores``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventsurv.operators.boost_kernels import BINS, CELL, MIN_GAIN, ZERO_CELL, Run
from eventsurv.operators.booster import prepare, runs_from_table, top_features, train, two_stage
from eventsurv.operators.concordance import concordance_index
from eventsurv.operators.history import BASE_NUMERIC
from eventsurv.operators.sampling import unit_hash
from eventsurv.operators.survival import cox_gradients
from eventsurv.operators.survival_ensemble import SurvivalEnsemble, train_ensemble_models, variant_runs
from eventsurv.operators.transitions import KEYS
from eventsurv.plans import configs as C
from eventsurv.plans.catalog import once, query, rounded
from eventsurv.plans.q_models import _RISK_SQL
from eventsurv.plans.q_preprocess import NUMERIC, transf
from eventsurv.sources.materialize import Scratch, materialize
from eventsurv.sources.events import load_events, transition_pairs

K = ", ".join(KEYS)
QUERY_ROUNDS = 5
TREE = dict(max_depth=3, eta=0.3, lam=2.0, alpha=0.3, min_child_weight=3.0, gamma=0.0)


def _split(spark, sf_dir, split):
    return transf(spark, sf_dir).where(F.col("split") == split).select(*KEYS, "row_id", "timeDiff", "status", *NUMERIC)


def _first_tree(spark, sf_dir):
    def build():
        with Scratch(spark) as scratch:
            b = prepare(_split(spark, sf_dir, "train"), NUMERIC, scratch=scratch)
            return train(b, [Run(0, g, 0, rounds=1, **TREE) for g in range(len(b.groups))])
    return once(spark, sf_dir, "first_tree", build)


def _boosted(spark, sf_dir):
    """The per-transition parameters and rounds of M12."""
    def build():
        pairs = transition_pairs(load_events(spark, sf_dir))
        with Scratch(spark) as scratch:
            b = prepare(_split(spark, sf_dir, "train"), NUMERIC, scratch=scratch,
                        expected=[(r[0], r[1]) for r in pairs.select(*KEYS).collect()])
            return train(b, runs_from_table(C.params_with_default(pairs), b))
    return once(spark, sf_dir, "boosted", build)


# --- M11: the first tree and the gradients after it (oracle) ------------------------
def _tree_sql() -> str:
    lam, alpha, mcw, depth, eta = TREE["lam"], TREE["alpha"], TREE["min_child_weight"], TREE["max_depth"], TREE["eta"]
    feats = sorted(NUMERIC)

    def t(g: str) -> str:
        return f"(sign({g}) * greatest(abs({g}) - {alpha}, 0.0))"

    def score(g: str, h: str) -> str:
        return f"({t(g)} * {t(g)} / ({h} + {lam}))"
    levels = []
    for i in range(depth + 1):
        if i == 0:
            levels.append(f"n0 AS (SELECT {K}, row_id, g, h, 1 AS node, true AS open FROM gh)")
        else:
            p = i - 1
            levels.append(f"""n{i} AS (
  SELECT n.index_event, n.outcome_event, n.row_id, n.g, n.h, n.node * 2 + CAST(x.bin > b.bin AS INTEGER) AS node, true AS open
  FROM n{p} n JOIN b{p} b USING ({K}, node) JOIN bn x ON x.index_event = n.index_event AND x.outcome_event = n.outcome_event
       AND x.row_id = n.row_id AND x.feature = b.feature)""")
        levels.append(f"t{i} AS (SELECT {K}, node, sum(g) AS G, sum(h) AS H, count(*) AS C FROM n{i} GROUP BY ALL)")
        if i < depth:
            levels.append(f"""h{i} AS (SELECT n.index_event, n.outcome_event, n.node, x.feature, x.bin, sum(n.g) AS G, sum(n.h) AS H
  FROM n{i} n JOIN bn x USING ({K}, row_id) GROUP BY ALL)""")
            levels.append(f"""c{i} AS (SELECT {K}, node, feature, bin, sum(G) OVER w AS GL, sum(H) OVER w AS HL, sum(G) OVER a AS GT, sum(H) OVER a AS HT
  FROM h{i} WINDOW w AS (PARTITION BY {K}, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {K}, node, feature))""")
            levels.append(f"""b{i} AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {K}, node ORDER BY gain DESC, feature, bin) AS rk FROM (
    SELECT {K}, node, feature, bin, round({score('GL', 'HL')} + {score('(GT - GL)', '(HT - HL)')} - {score('GT', 'HT')}, 6) AS gain
    FROM c{i} WHERE HL >= {mcw} AND HT - HL >= {mcw} AND bin < {BINS - 1}) WHERE gain > {MIN_GAIN}) WHERE rk = 1)""")
    every = " UNION ALL ".join(
        f"SELECT t.index_event, t.outcome_event, t.node, {'b.feature, b.bin, b.gain' if i < depth else 'NULL AS feature, NULL AS bin, NULL AS gain'}, "
        f"t.G, t.H, t.C FROM t{i} t " + (f"LEFT JOIN b{i} b USING ({K}, node)" if i < depth else "") for i in range(depth + 1))
    cell = (f"CASE WHEN x = 0 THEN 0 ELSE sign(x) * (floor(ln(least(greatest(abs(x), 1e-300), 1e300)) * {CELL}) + {ZERO_CELL}) END")
    return _RISK_SQL.replace("SELECT * FROM trans WHERE split", "SELECT * FROM transf WHERE split") + f""",
gh AS (SELECT tr.index_event, tr.outcome_event, tr.row_id, tr.timeDiff, tr.status, ab.A - tr.status AS g, ab.A - ab.B AS h
       FROM tr JOIN ab ON ab.index_event = tr.index_event AND ab.outcome_event = tr.outcome_event AND ab.t = tr.timeDiff),
mean AS (SELECT {K}, {', '.join(f'avg(CAST({c} AS DOUBLE)) AS {c}' for c in feats)} FROM tr GROUP BY ALL),
wide AS (SELECT tr.index_event, tr.outcome_event, tr.row_id, {', '.join(f'coalesce(CAST(tr.{c} AS DOUBLE), m.{c}, 0.0) AS {c}' for c in feats)}
         FROM tr JOIN mean m USING ({K})),
cel AS (SELECT {K}, row_id, feature, {cell} AS cell FROM (SELECT * FROM wide UNPIVOT (x FOR feature IN ({', '.join(feats)})))),
cnt AS (SELECT {K}, feature, cell, count(*) AS n FROM cel GROUP BY ALL),
cut AS (SELECT {K}, feature, cell, CAST(floor(coalesce(CAST(sum(n) OVER (PARTITION BY {K}, feature ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)
               * {BINS} / CAST(sum(n) OVER (PARTITION BY {K}, feature) AS BIGINT)) AS INTEGER) AS bin FROM cnt),
bn AS (SELECT c.index_event, c.outcome_event, c.row_id, c.feature, k.bin FROM cel c JOIN cut k USING ({K}, feature, cell)),
{', '.join(levels)},
tree AS (SELECT *, CASE WHEN feature IS NULL THEN -{eta} * {t('G')} / (H + {lam}) ELSE 0.0 END AS value FROM ({every}))"""


@query("boost_first_tree", _tree_sql() + f"""
SELECT {K}, CAST(node AS INTEGER) AS node, feature, CAST(bin AS INTEGER) AS bin, round(gain, 5) + 0.0 AS gain, CAST(C AS DOUBLE) AS n_rows,
       round(H, 5) + 0.0 AS cover, round(value, 6) + 0.0 AS value FROM tree""")
def q_boost_first_tree(spark, sf_dir):
    """Every node of the first tree of every transition (depth 3, lambda
    2, alpha 0.3, min child weight 3) over all columns."""
    t = _first_tree(spark, sf_dir).split_table(spark)
    t = t.select(*KEYS, "node", "feature", "bin", F.round("gain", 5).alias("gain"), "n_rows", F.round("cover", 5).alias("cover"), F.round("value", 6).alias("value"))
    return rounded(t, only=["gain", "cover", "value"])


def _leaf_rows() -> str:
    return " UNION ALL ".join(f"SELECT n.index_event, n.outcome_event, n.row_id, e.value FROM n{i} n JOIN tree e USING ({K}, node) WHERE e.feature IS NULL"
                              for i in range(TREE["max_depth"] + 1))


@query("boost_round1_gradients", _tree_sql() + f""",
leaf AS ({_leaf_rows()}),
mw AS (SELECT gh.index_event, gh.outcome_event, gh.row_id, gh.timeDiff AS t, gh.status AS d, exp(leaf.value) AS w FROM gh JOIN leaf USING ({K}, row_id)),
tt1 AS (SELECT {K}, t, sum(w) AS sw, sum(d) AS d FROM mw GROUP BY ALL),
s1 AS (SELECT *, sum(sw) OVER (PARTITION BY {K} ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS S0 FROM tt1),
ab1 AS (SELECT *, sum(d / S0) OVER (PARTITION BY {K} ORDER BY t ROWS UNBOUNDED PRECEDING) AS A,
               sum(d / (S0 * S0)) OVER (PARTITION BY {K} ORDER BY t ROWS UNBOUNDED PRECEDING) AS B FROM s1)
SELECT mw.index_event, mw.outcome_event, mw.row_id, round(w * A - mw.d, 6) + 0.0 AS g, round(w * A - w * w * B, 6) + 0.0 AS h
FROM mw JOIN ab1 ON ab1.index_event = mw.index_event AND ab1.outcome_event = mw.outcome_event AND ab1.t = mw.t""")
def q_boost_round1_gradients(spark, sf_dir):
    """Gradient and hessian of every training row after the first tree."""
    scored = _first_tree(spark, sf_dir).margins(_split(spark, sf_dir, "train"), ["row_id", "timeDiff", "status"])
    g = cox_gradients(scored, F.col("margin"))
    return rounded(g.select(*KEYS, "row_id", "g", "h"))


# --- M11 / M12 / M14 / M15 / M17 -----------------------------------------------------
@query("cox_boost_trace")
def q_cox_boost_trace(spark, sf_dir):
    """Training loss (negative mean log partial likelihood) after every
    round, the per-transition parameters of M12."""
    return rounded(_boosted(spark, sf_dir).trace_table(spark))


@query("cox_boost_splits")
def q_cox_boost_splits(spark, sf_dir):
    """The split ledger of that training: one row per node of every tree."""
    return rounded(_boosted(spark, sf_dir).split_table(spark))


@query("cox_boost_importance")
def q_cox_boost_importance(spark, sf_dir):
    """Mean gain per split and number of splits of every column used."""
    return rounded(_boosted(spark, sf_dir).importance(spark))


@query("cox_boost_top40")
def q_cox_boost_top40(spark, sf_dir):
    """The 40 columns of largest mean gain per transition."""
    return rounded(top_features(_boosted(spark, sf_dir), spark, C.SELECT_TOP_N))


@query("fit_status")
def q_fit_status(spark, sf_dir):
    """The run table (status, message, rounds) of every expected transition."""
    return _boosted(spark, sf_dir).status_table(spark)


@query("cox_boost_c_index")
def q_cox_boost_c_index(spark, sf_dir):
    """C1/C4 of the trained booster on the test rows, per transition."""
    s = _boosted(spark, sf_dir).margins(_split(spark, sf_dir, "test"), ["row_id", "timeDiff", "status"])
    return rounded(concordance_index(s.select(*KEYS, "row_id", "timeDiff", "status", (-F.exp("margin")).alias("score")), KEYS))


# --- M13 ------------------------------------------------------------------------------
@query("early_stop")
def q_early_stop(spark, sf_dir):
    """Training watched on a hashed tenth of the rows; trace of both
    parts (patience 2 within the query's rounds; 100 in the configuration)."""
    def build():
        with Scratch(spark) as scratch:
            held = unit_hash(F.col("row_id"), 2025) < C.HOLD_OUT
            b = prepare(_split(spark, sf_dir, "train"), NUMERIC, valid=held, scratch=scratch)
            return train(b, [Run(0, g, 0, rounds=QUERY_ROUNDS, max_depth=4, eta=0.5, lam=1.0, patience=2) for g in range(len(b.groups))])
    m = once(spark, sf_dir, "early_stop", build)
    return rounded(m.trace_table(spark).join(F.broadcast(m.status_table(spark).select(*KEYS, "best_round")), KEYS))


# --- M16 ------------------------------------------------------------------------------
@query("two_stage_selection")
def q_two_stage_selection(spark, sf_dir):
    """The (at most 40) columns per transition chosen by the first fit and
    how often and how well the second fit uses them."""
    def build():
        with Scratch(spark) as scratch:
            b = prepare(_split(spark, sf_dir, "train"), NUMERIC, scratch=scratch)
            runs = [Run(0, g, 0, rounds=QUERY_ROUNDS, max_depth=5, eta=0.05, lam=3.0, alpha=0.5, min_child_weight=5, subsample=0.8, colsample=0.8, seed=42)
                    for g in range(len(b.groups))]
            first, top, second = two_stage(b, runs, C.SELECT_TOP_N)
            return top, second
    top, second = once(spark, sf_dir, "two_stage", build)
    used = second.importance(spark).select(*KEYS, "feature", F.col("gain").alias("second_gain"), F.col("n_splits").alias("second_splits"))
    return rounded(top.drop("run").join(used, [*KEYS, "feature"], "left"))


# --- M10 ------------------------------------------------------------------------------
@query("l2_boost_trace")
def q_l2_boost_trace(spark, sf_dir):
    """RMSE of the boosted squared loss on the raw duration, round by round."""
    def build():
        with Scratch(spark) as scratch:
            b = prepare(_split(spark, sf_dir, "train"), NUMERIC, base=True, scratch=scratch)
            return train(b, [Run(0, g, 0, objective="l2", rounds=QUERY_ROUNDS, **C.L2_PARAMS) for g in range(len(b.groups))])
    return rounded(once(spark, sf_dir, "l2", build).trace_table(spark), 3)


# --- ensembles: E1-E4, C4 ---------------------------------------------------------------
def _ensemble(spark, sf_dir):
    def build():
        members = C.strategy_table(transition_pairs(load_events(spark, sf_dir)))
        return SurvivalEnsemble.from_table(members).fit(_split(spark, sf_dir, "train"), NUMERIC)
    return once(spark, sf_dir, "ensemble", build)


@query("ensemble_scores")
def q_ensemble_scores(spark, sf_dir):
    """E4 + E1: blended scores of the strategy table's members on the test rows."""
    return rounded(_ensemble(spark, sf_dir).predict(_split(spark, sf_dir, "test")))


@query("ensemble_leaderboard")
def q_ensemble_leaderboard(spark, sf_dir):
    """C4 from model scores: C-index of every member and of the three blends."""
    m, test = _ensemble(spark, sf_dir), _split(spark, sf_dir, "test")
    labels = test.select(*KEYS, "row_id", "timeDiff", "status")
    # hundreds of trees a member: every row is scored once
    scores = materialize(m.scores(test), "scores")
    long = scores.select(*KEYS, "row_id", F.col("run").alias("model"), "score")
    for blend in ("mean", "squared", "rank"):
        long = long.unionByName(m.blend(scores, blend=blend).select(*KEYS, "row_id", F.lit(blend).alias("model"), "score"))
    return rounded(concordance_index(long.join(labels, [*KEYS, "row_id"]), [*KEYS, "model"]))


@query("five_model_scores")
def q_five_model_scores(spark, sf_dir):
    """The five-model ensemble with its fixed weights on the test rows."""
    names = C.PARAM_COLUMNS + ["seed"]
    members = [(dict(zip(names, p)), QUERY_ROUNDS, w) for p, w in zip(C.FIVE_MODELS, C.BLEND_WEIGHTS)]
    model = once(spark, sf_dir, "five", lambda: train_ensemble_models(
        _split(spark, sf_dir, "train"), NUMERIC, _split(spark, sf_dir, "test"), members)[1])
    return rounded(model.predict(_split(spark, sf_dir, "test")))


# --- M18 ------------------------------------------------------------------------------
@query("run_grid_trace")
def q_run_grid_trace(spark, sf_dir):
    """M18 run: every variant of the grid on every transition in one shared
    training (a 250th of the grid's rounds)."""
    def build():
        params = dict(zip(C.PARAM_COLUMNS + ["seed"], C.GRID_PARAMS))
        grid = [(n, max(1, r // 250), eta, BASE_NUMERIC if fs == "base" else NUMERIC) for n, r, eta, fs in C.RUN_GRID]
        with Scratch(spark) as scratch:
            b = prepare(_split(spark, sf_dir, "train"), NUMERIC, slots=len(grid), scratch=scratch)
            return train(b, variant_runs(b, grid, params))
    return rounded(once(spark, sf_dir, "grid", build).trace_table(spark))
