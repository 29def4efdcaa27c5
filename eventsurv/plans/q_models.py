"""Model queries (M1-M9, M11 gradients, P9, P10, S5).

Estimators are iterative; their query entries have no oracle text (the
driver then checks rows) and their invariants are asserted in tests.  The
parts SQL can recompute exactly are their own oracle queries: the Cox
log-likelihood at beta = 0, the boosting gradients at margin 0, scores from
literal coefficients and the one-covariate ridge in closed form.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventsurv.functions.features import add_transition_features
from eventsurv.operators.history import STATE_COLUMNS, from_state
from eventsurv.operators.preprocess import Preprocessor
from eventsurv.operators.concordance import concordance_index
from eventsurv.operators.design import cox_points, prepare_design
from eventsurv.operators.linear_models import (AFT_EXTRA, fit_coxnet, fit_cox_ridge, fit_enet, median_times, partial_hazards,
                                               refit_significant, significant)
from eventsurv.operators.survival import cox_gradients, cox_loglik_at
from eventsurv.operators.transitions import KEYS
from eventsurv.plans.catalog import once, query, rounded
from eventsurv.plans.q_labels import labelled
from eventsurv.plans.q_preprocess import NUMERIC, transf
from eventsurv.plans.sqlbase import with_all
from eventsurv.operators.boosting import best_first_split, equal_width_bins
from eventsurv.sources.materialize import Scratch
from eventsurv.sources.sinks import prediction_table

K = ", ".join(KEYS)
SCI = "%.8e"


def _raw(spark, sf_dir):
    return transf(spark, sf_dir).select(*KEYS, "row_id", "split", "timeDiff", "status", *NUMERIC)


def _scaler(spark, sf_dir):
    """The training statistics of the 112 columns."""
    return once(spark, sf_dir, "scaler", lambda: Preprocessor().fit(_raw(spark, sf_dir).where(F.col("split") == "train")))


def _scaled(spark, sf_dir):
    """All rows with the 112 columns scaled by the training statistics."""
    return _scaler(spark, sf_dir).transform(_raw(spark, sf_dir))


def _design(spark, sf_dir, scratch, **how):
    """Blocks of the scaled training rows.  Rows move as counts, sums and times; the columns are computed where the blocks are made."""
    model = _scaler(spark, sf_dir)
    rows = labelled(spark, sf_dir, keep=STATE_COLUMNS).where(F.col("split") == "train").drop("row_id", "split")

    def widen(rows):
        kept = [c for c in rows.columns if c in (*KEYS, "timeDiff", "status", "at")]
        wide = add_transition_features(from_state(rows, *kept)).select(*kept, *NUMERIC)
        return model.transform(wide, also=["at"])
    return prepare_design(rows, NUMERIC, scratch=scratch, widen=widen, **how)


# --- M1 at beta = 0 (oracle) ---------------------------------------------------------
_RISK_SQL = with_all() + f""",
tr AS (SELECT * FROM trans WHERE split = 'train'),
tt AS (SELECT {K}, timeDiff AS t, count(*) AS nt, sum(status) AS d FROM tr GROUP BY ALL),
s0 AS (SELECT *, sum(nt) OVER (PARTITION BY {K} ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS S0 FROM tt),
ab AS (SELECT *, sum(CASE WHEN d > 0 THEN d / S0 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY t ROWS UNBOUNDED PRECEDING) AS A,
              sum(CASE WHEN d > 0 THEN d / (S0 * S0) ELSE 0 END) OVER (PARTITION BY {K} ORDER BY t ROWS UNBOUNDED PRECEDING) AS B
       FROM s0)"""


@query("cox_null_loglik", _RISK_SQL + f"""
SELECT {K}, printf('{SCI}', -sum(d * ln(S0))) AS loglik, CAST(sum(d) AS BIGINT) AS n_events FROM s0 WHERE d > 0 GROUP BY ALL""")
def q_cox_null_loglik(spark, sf_dir):
    """Breslow partial log-likelihood at beta = 0 (no covariates)."""
    t = labelled(spark, sf_dir, keep=[]).where(F.col("split") == "train")
    trans = [tuple(r[k] for k in KEYS) for r in t.select(*KEYS).distinct().collect()]
    import numpy as np
    ll = cox_loglik_at(t, [], {k: np.zeros(0) for k in trans})
    ev = t.groupBy(*KEYS).agg(F.sum("status").cast("long").alias("n_events"))
    rows = spark.createDataFrame([(*k, SCI % v) for k, v in ll.items()], f"{KEYS[0]} string, {KEYS[1]} string, loglik string")
    return rows.join(ev, KEYS, "inner")


@query("boost_round0_gradients", _RISK_SQL + f"""
SELECT tr.index_event, tr.outcome_event, tr.row_id, round(ab.A - tr.status, 6) + 0.0 AS g, round(ab.A - ab.B, 6) + 0.0 AS h
FROM tr JOIN ab ON ab.index_event = tr.index_event AND ab.outcome_event = tr.outcome_event AND ab.t = tr.timeDiff""")
def q_boost_round0_gradients(spark, sf_dir):
    """Gradient and hessian of the Cox loss per row at margin 0."""
    t = labelled(spark, sf_dir, keep=[]).where(F.col("split") == "train")
    g = cox_gradients(t, F.lit(0.0))
    return rounded(g.select(*KEYS, "row_id", "g", "h"))


# --- M3 / M5 from literal coefficients (oracle) ----------------------------------------
# --- fixed values: coefficients of the literal-coefficient checks -----------------------
HAZARD_COEFS = {"userActiveDaysWeekly": 0.05, "logAmount": -0.1, "userRepayCount": 0.02}
AFT_COEFS = {"Intercept": 11.0, "userActiveDaysWeekly": -0.03, "logAmount": 0.2}
AFT_LOG_SCALE = 0.4
# ---------------------------------------------------------------------------------------


@query("hazard_from_coefs", with_all() + f"\nSELECT {K}, row_id, round(-exp("
       + " + ".join(f"{c} * {v}" for c, v in HAZARD_COEFS.items()) + "), 6) + 0.0 AS score FROM trans WHERE split = 'test'")
def q_hazard_from_coefs(spark, sf_dir):
    """M3: -exp(x beta) (partial hazard, negated) with literal beta."""
    t = labelled(spark, sf_dir).where(F.col("split") == "test")
    eta = None
    for c, v in HAZARD_COEFS.items():
        term = F.col(c) * F.lit(v)
        eta = term if eta is None else eta + term
    return rounded(t.select(*KEYS, "row_id", (-F.exp(eta)).alias("score")))


def _aft_median_sql() -> str:
    eta = f"{AFT_COEFS['Intercept']} + " + " + ".join(f"{c} * {v}" for c, v in AFT_COEFS.items() if c != "Intercept")
    return f"printf('{SCI}', exp({eta}) * pow(ln(2.0), exp({AFT_LOG_SCALE})))"


@query("median_from_coefs", with_all() + f"\nSELECT {K}, row_id, {_aft_median_sql()} AS median_time FROM trans WHERE split = 'test'")
def q_median_from_coefs(spark, sf_dir):
    """M5: Weibull AFT median survival exp(x beta) * ln(2)^sigma from literal
    coefficients (sigma = exp(log_scale))."""
    t = labelled(spark, sf_dir).where(F.col("split") == "test")
    eta = F.lit(AFT_COEFS["Intercept"])
    for c, v in AFT_COEFS.items():
        if c != "Intercept":
            eta = eta + F.col(c) * F.lit(v)
    med = F.exp(eta) * F.pow(F.log(F.lit(2.0)), F.exp(F.lit(AFT_LOG_SCALE)))
    return t.select(*KEYS, "row_id", F.format_string(SCI, med).alias("median_time"))


# --- M9 one covariate, closed form (oracle) -----------------------------------------------
RIDGE_X, RIDGE_ALPHA = "userActiveDaysMonthly", 0.1


@query("univariate_ridge", with_all() + f"""
, s AS (SELECT {K}, covar_pop({RIDGE_X}, ln(timeDiff + 1)) AS cxy, var_pop({RIDGE_X}) AS vx,
               avg({RIDGE_X}) AS mx, avg(ln(timeDiff + 1)) AS my FROM trans WHERE split = 'train' GROUP BY ALL)
SELECT {K}, 'coef' AS term, printf('%.5e', cxy / (vx + {RIDGE_ALPHA})) AS value FROM s
UNION ALL
SELECT {K}, 'Intercept' AS term, printf('%.5e', my - cxy / (vx + {RIDGE_ALPHA}) * mx) AS value FROM s""")
def q_univariate_ridge(spark, sf_dir):
    """M9 with one covariate and l1_ratio = 0 (pure ridge) against the
    closed form b = cov(x, y) / (var(x) + alpha)."""
    t = labelled(spark, sf_dir).where(F.col("split") == "train").select(*KEYS, "timeDiff", RIDGE_X)
    coefs = fit_enet(t, [RIDGE_X], F.log1p(F.col("timeDiff")), alpha=RIDGE_ALPHA, l1_ratio=0.0)
    return coefs.select(*KEYS, F.when(F.col("covariate") == "Intercept", F.lit("Intercept")).otherwise(F.lit("coef")).alias("term"),
                        F.format_string("%.5e", "coef").alias("value"))


# --- fitted models over all 112 columns --------------------------------------------------
# --- fixed values ------------------------------------------------------------------------
COX_PENALIZER, COX_FALLBACK = 0.1, (1.0, 0.1, 1000)      # fall-back: penalizer, first step, iterations
COX_P, AFT_P = 0.005, 1e-5
AFT_PENALIZER = 0.1
ENET_ALPHA, ENET_L1 = 0.1, 0.5
COXNET_L1, COXNET_MIN = 0.9, 0.01
# -----------------------------------------------------------------------------------------
#: path length of ``coxnet_check``, as in its SQL; ``coxnet_path`` has the estimator's 100
COXNET_STEPS = 4
_GRID = with_all() + f", tr AS (SELECT DISTINCT {K} FROM trans WHERE split = 'train'), c AS (SELECT unnest([{', '.join(repr(c) for c in NUMERIC)}]) AS covariate)"


def _train(spark, sf_dir):
    return _scaled(spark, sf_dir).where(F.col("split") == "train")


def _test(spark, sf_dir):
    return _scaled(spark, sf_dir).where(F.col("split") == "test")


def _cox(spark, sf_dir):
    """The ridge Cox fit and its score (gradient of the penalised mean loss)."""
    def build():
        with Scratch(spark) as scratch:
            d = _design(spark, sf_dir, scratch)
            fit = fit_cox_ridge(d, COX_PENALIZER, fallback=COX_FALLBACK)
            with scratch.arrow(4, "64m"):
                points = cox_points(d, fit.coef)
            return fit, {g: p.grad / d.rows[g] + fit.stats[g]["penalizer"] * fit.coef[g] for g, p in points.items()}
    return once(spark, sf_dir, "cox", build)


@query("cox_fit_check")
def q_cox_fit_check(spark, sf_dir):
    """Penalised Cox fit per transition (status, log-likelihood,
    score norm at the optimum, iterations, convergence, penalizer used)."""
    return rounded(_cox(spark, sf_dir)[0].fit_table(spark))


@query("cox_score_check", _GRID + f"\nSELECT {K}, covariate, 0.0::DOUBLE AS score FROM tr, c")
def q_cox_score_check(spark, sf_dir):
    """M1: the score equation of every transition and column, computed anew at
    the fitted coefficients; 0 at the optimum (6 decimals)."""
    fit, score = _cox(spark, sf_dir)
    rows = [(*fit.groups[g], c, float(v)) for g, x in score.items() for c, v in zip(fit.cols, x)]
    return rounded(spark.createDataFrame(rows, f"{KEYS[0]} string, {KEYS[1]} string, covariate string, score double"))


@query("cox_summary")
def q_cox_summary(spark, sf_dir):
    """M7 + P9: coefficient summary, covariates with p <= 0.005."""
    return rounded(significant(_cox(spark, sf_dir)[0], spark, COX_P))


@query("cox_c_index")
def q_cox_c_index(spark, sf_dir):
    """M3 + C1: C-index of the fitted Cox scores on the test rows."""
    return rounded(concordance_index(partial_hazards(_test(spark, sf_dir), _cox(spark, sf_dir)[0]), KEYS))


@query("prediction_table")
def q_prediction_table(spark, sf_dir):
    """Cox partial-hazard scores of the test rows, one row per
    (transition, row_id); transitions without a converged fit have none."""
    return prediction_table(partial_hazards(_test(spark, sf_dir), _cox(spark, sf_dir)[0]))


def _aft(spark, sf_dir):
    def build():
        with Scratch(spark) as scratch:
            d = _design(spark, sf_dir, scratch, positive=True, ordered=False)
            return refit_significant(d, AFT_PENALIZER, AFT_P)
    return once(spark, sf_dir, "aft", build)


@query("aft_fit_check")
def q_aft_fit_check(spark, sf_dir):
    """M4: Weibull AFT per transition (positive durations only): coefficients
    and Wald tests, the distribution parameters removed by name (P10)."""
    return rounded(_aft(spark, sf_dir)[0].summary(spark).where(~F.col("covariate").isin(*AFT_EXTRA)))


@query("aft_reselect")
def q_aft_reselect(spark, sf_dir):
    """M6: the fit on the columns with p <= 1e-5 (P9, P10) of the first fit."""
    first, _, again = _aft(spark, sf_dir)
    kept = significant(first, spark, AFT_P).select(*KEYS, "covariate", F.col("p").alias("first_p"))
    return rounded(again.summary(spark).join(kept, [*KEYS, "covariate"]))


@query("aft_feature_counts")
def q_aft_feature_counts(spark, sf_dir):
    """Columns kept by the AFT filter (p <= 1e-5) per transition."""
    first, chosen, _ = _aft(spark, sf_dir)
    return spark.createDataFrame([(*first.groups[g], len(c)) for g, c in chosen.items()], f"{KEYS[0]} string, {KEYS[1]} string, n_features int")


@query("aft_median")
def q_aft_median(spark, sf_dir):
    """M5: predicted median survival of the test rows by the refitted model."""
    t = median_times(_test(spark, sf_dir), _aft(spark, sf_dir)[2])
    return t.select(*KEYS, "row_id", "median_time")


@query("elastic_net_check", _GRID + f"\nSELECT {K}, covariate, 0.0::DOUBLE AS kkt FROM tr, (SELECT * FROM c UNION ALL SELECT 'Intercept')")
def q_elastic_net_check(spark, sf_dir):
    """M9: elastic net on the log duration (alpha 0.1, l1_ratio 0.5): violation
    of the sub-gradient condition of every coefficient."""
    return rounded(_enet(spark, sf_dir).select(*KEYS, "covariate", "kkt"))


def _enet(spark, sf_dir):
    rows = once(spark, sf_dir, "enet", lambda: fit_enet(_train(spark, sf_dir), NUMERIC, F.log1p("timeDiff"), ENET_ALPHA, ENET_L1).collect())
    return spark.createDataFrame(rows, f"{KEYS[0]} string, {KEYS[1]} string, covariate string, coef double, kkt double")


@query("elastic_net_coefs")
def q_elastic_net_coefs(spark, sf_dir):
    """M9: the coefficients of that fit."""
    return rounded(_enet(spark, sf_dir).select(*KEYS, "covariate", "coef"))


def _coxnet(spark, sf_dir, **steps):
    def build():
        with Scratch(spark) as scratch:
            return fit_coxnet(_design(spark, sf_dir, scratch), COXNET_L1, COXNET_MIN, **steps)
    return once(spark, sf_dir, f"coxnet{steps}", build)


@query("coxnet_check", _GRID + f"\nSELECT {K}, CAST(step AS INTEGER) AS step, covariate, 0.0::DOUBLE AS kkt FROM tr, c, range({COXNET_STEPS}) s(step)")
def q_coxnet_check(spark, sf_dir):
    """M8: violation of the sub-gradient condition of every coefficient along
    the path (l1_ratio 0.9, down to 0.01 of the largest penalty)."""
    return rounded(_coxnet(spark, sf_dir, n_alphas=COXNET_STEPS).table(spark).select(*KEYS, "step", "covariate", "kkt"))


@query("coxnet_path")
def q_coxnet_path(spark, sf_dir):
    """M8: the coefficients that are not 0 along the path of 100 penalties
    (l1_ratio 0.9, down to 0.01 of the largest)."""
    return rounded(_coxnet(spark, sf_dir).table(spark).where("coef <> 0").select(*KEYS, "step", "alpha", "covariate", "coef"))


# --- M11: histogram and best root split at margin 0 (oracle) -----------------------------
SPLIT_COLUMNS = sorted(NUMERIC)
SPLIT_BINS, SPLIT_LAMBDA = 32, 1.0


def _split_sql() -> str:
    vals = " UNION ALL ".join(f"SELECT index_event, outcome_event, row_id, g, h, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM gh"
                              for c in SPLIT_COLUMNS)
    return _RISK_SQL.replace("SELECT * FROM trans WHERE split", "SELECT * FROM transf WHERE split") + f""",
gh AS (SELECT tr.*, ab.A - tr.status AS g, ab.A - ab.B AS h
       FROM tr JOIN ab ON ab.index_event = tr.index_event AND ab.outcome_event = tr.outcome_event AND ab.t = tr.timeDiff),
lng AS ({vals}),
rng AS (SELECT {K}, feature, min(x) AS lo, max(x) AS hi FROM lng GROUP BY ALL),
bn AS (SELECT l.*, CAST(CASE WHEN r.hi - r.lo > 0 THEN least(floor((l.x - r.lo) / (r.hi - r.lo) * {SPLIT_BINS}), {SPLIT_BINS - 1})
                             ELSE 0 END AS INTEGER) AS bin
       FROM lng l JOIN rng r USING (index_event, outcome_event, feature) WHERE l.x IS NOT NULL),
hst AS (SELECT {K}, feature, bin, sum(g) AS G, sum(h) AS H FROM bn GROUP BY ALL),
cum AS (SELECT *, sum(G) OVER w AS GL, sum(H) OVER w AS HL, sum(G) OVER t AS GT, sum(H) OVER t AS HT FROM hst
        WINDOW w AS (PARTITION BY {K}, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY {K}, feature)),
cand AS (SELECT {K}, feature, bin,
                0.5 * (GL * GL / (HL + {SPLIT_LAMBDA}) + (GT - GL) * (GT - GL) / ((HT - HL) + {SPLIT_LAMBDA})
                       - GT * GT / (HT + {SPLIT_LAMBDA})) - 0.0 AS gain
         FROM cum WHERE HL >= 1.0 AND HT - HL >= 1.0),
best AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY round(gain, 9) DESC, feature, bin) AS rk FROM cand)
SELECT {K}, feature, bin, round(gain, 6) + 0.0 AS gain FROM best WHERE rk = 1"""


@query("boost_first_split", _split_sql())
def q_boost_first_split(spark, sf_dir):
    """Histogram of g, h at margin 0 over 32 equal-width bins and the
    best root split per transition over all columns (lambda 1, alpha 0, gamma 0, min child weight 1)."""
    t = transf(spark, sf_dir).where(F.col("split") == "train")
    g = cox_gradients(t.select(*KEYS, "row_id", "timeDiff", "status"), F.lit(0.0))
    binned = equal_width_bins(t.select(*KEYS, "row_id", *SPLIT_COLUMNS), SPLIT_COLUMNS, SPLIT_BINS)
    best = best_first_split(g.join(binned, [*KEYS, "row_id"], "inner"), SPLIT_COLUMNS, lam=SPLIT_LAMBDA)
    return rounded(best)
