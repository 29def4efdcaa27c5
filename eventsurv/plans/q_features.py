"""Queries over the per-event feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventsurv.functions.calendar import CALENDAR_COLUMNS, CYCLIC_COLUMNS, EVENT_COLUMNS
from eventsurv.functions.features import (
    BASE_FEATURES, CROSS_FEATURES, OUTCOME_FEATURES, add_transition_features, base_feature_exprs,
    cross_feature_exprs, finite_or_zero, guarded_ratio_exprs, interaction_exprs,
)
from eventsurv.operators.history import (ACTIVE_DAY_WINDOWS, MARKET_HISTORY_COLUMNS, USER_HISTORY_COLUMNS,
                                         event_features)
from eventsurv.plans.catalog import query, rounded
from eventsurv.plans.q_labels import feature_table, labelled
from eventsurv.plans.sqlbase import base_feature_sql, cross_feature_sql, features_cte, rnd, with_all
from eventsurv.sources.events import load_events

K = "index_event, outcome_event"


def features(spark, sf_dir):
    return feature_table(spark, sf_dir)


# engineered columns built from sin/cos/sqrt: rounded on both sides
TRANSCENDENTAL = ["temporal_interaction", "activity_volatility"]
_LOGS = ["logAmountUSD_1p", "logUserBorrowSum"]


def _r(name, expr, which=TRANSCENDENTAL):
    return f"round({expr}, 6) + 0.0 AS {name}" if name in which else f"{expr} AS {name}"


@query("user_history", f"WITH {features_cte()}\nSELECT event_id, "
       + ", ".join(USER_HISTORY_COLUMNS) + " FROM feat")
def q_user_history(spark, sf_dir):
    return features(spark, sf_dir).select("event_id", *USER_HISTORY_COLUMNS)


@query("market_history", f"WITH {features_cte()}\nSELECT event_id, "
       + ", ".join(MARKET_HISTORY_COLUMNS) + " FROM feat")
def q_market_history(spark, sf_dir):
    return features(spark, sf_dir).select("event_id", *MARKET_HISTORY_COLUMNS)


@query("calendar_cyclic", f"WITH {features_cte()}\nSELECT event_id, {rnd(CALENDAR_COLUMNS + CYCLIC_COLUMNS)}, isWeekend FROM feat")
def q_calendar_cyclic(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("event_id", *CALENDAR_COLUMNS, *CYCLIC_COLUMNS, "isWeekend"))


@query("amount_logs", f"WITH {features_cte()}\nSELECT event_id, amount, amountUSD, {rnd(['logAmount', 'logAmountUSD'])}, priceInUSD, "
       "round(ln(1 + userBorrowSum), 6) + 0.0 AS logUserBorrowSum FROM feat")
def q_amount_logs(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(f.select("event_id", *EVENT_COLUMNS, interaction_exprs()["logUserBorrowSum"].alias("logUserBorrowSum")),
                   only=["logAmount", "logAmountUSD", "logUserBorrowSum"])


@query("active_days", f"WITH {features_cte()}\nSELECT event_id, {', '.join(ACTIVE_DAY_WINDOWS)} FROM feat")
def q_active_days(spark, sf_dir):
    return features(spark, sf_dir).select("event_id", *ACTIVE_DAY_WINDOWS)


@query("recency_seconds", f"WITH {features_cte()}\nSELECT event_id, userSecondsSinceFirstTransaction, "
       "userSecondsSincePreviousTransaction FROM feat")
def q_recency_seconds(spark, sf_dir):
    return features(spark, sf_dir).select("event_id", "userSecondsSinceFirstTransaction",
                                          "userSecondsSincePreviousTransaction")


@query("category_levels_raw", f"WITH {features_cte()}\nSELECT event_id, category FROM feat")
def q_category(spark, sf_dir):
    """The categorical column read from the JSON properties."""
    return features(spark, sf_dir).select("event_id", "category")


# --- F1-F13, F29-F34 per event (they do not depend on the outcome) -------------
@query("base_survival_features", f"WITH {features_cte()}\nSELECT event_id, "
       + ", ".join(_r(n, e) for n, e in base_feature_sql().items()) + " FROM feat")
def q_base_survival_features(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(f.select("event_id", *[e.alias(n) for n, e in base_feature_exprs().items()]), only=TRANSCENDENTAL)


@query("cross_features", f"WITH {features_cte()}\nSELECT event_id, "
       + ", ".join(f"{e} AS {n}" for n, e in cross_feature_sql().items()) + " FROM feat")
def q_cross_features(spark, sf_dir):
    f = features(spark, sf_dir)
    # month_end_risk reads two base features by name
    f = f.select("*", *[e.alias(n) for n, e in base_feature_exprs().items()
                        if n in ("leverage_ratio", "is_month_end")])
    return f.select("event_id", *[e.alias(n) for n, e in cross_feature_exprs().items()])


# --- F14-F28 on the long table (one branch per outcome) -------------------------
@query("outcome_features", with_all() + f"\nSELECT {K}, row_id, {', '.join(OUTCOME_FEATURES)} FROM transf")
def q_outcome_features(spark, sf_dir):
    t = add_transition_features(labelled(spark, sf_dir))
    return t.select("index_event", "outcome_event", "row_id", *OUTCOME_FEATURES)


# --- F35-F38 / F39-F43 ----------------------------------------------------------
_GUARD = {
    "borrow_to_deposit": "CASE WHEN userDepositSum > 0 THEN userBorrowSum / userDepositSum ELSE 0.0 END",
    "liquidation_to_borrow": "CASE WHEN userBorrowSum > 0 THEN userLiquidationSum / userBorrowSum ELSE 0.0 END",
    "repay_to_borrow": "CASE WHEN userBorrowSum > 0 THEN userRepaySum / userBorrowSum ELSE 0.0 END",
}


@query("guarded_ratios", f"WITH {features_cte()}\nSELECT event_id, "
       + ", ".join(f"{e} AS {n}" for n, e in _GUARD.items()) + " FROM feat")
def q_guarded_ratios(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("event_id", *[e.alias(n) for n, e in guarded_ratio_exprs().items()])


_INTER = {
    "userBorrow_interaction": "userBorrowSum * userBorrowAvgAmountUSD",
    "userActivity_interaction": "CAST(userActiveDaysWeekly * userRepayCount AS BIGINT)",
    "userRepayEfficiency": "userRepaySumUSD / greatest(userBorrowSumUSD, 1.0)",
    "marketStress": "marketBorrowSum / greatest(marketDepositSum, 1.0)",
    "logAmountUSD_1p": "ln(1 + amountUSD)",
    "logUserBorrowSum": "ln(1 + userBorrowSum)",
}


@query("interactions_floor_ratios", f"WITH {features_cte()}\nSELECT event_id, "
       + ", ".join(_r(n, e, _LOGS) for n, e in _INTER.items()) + " FROM feat")
def q_interactions(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(f.select("event_id", *[e.alias(n) for n, e in interaction_exprs().items()]), only=_LOGS)


_NF_COLS = BASE_FEATURES + CROSS_FEATURES


@query("nonfinite_to_zero", f"WITH {features_cte()}, x AS (SELECT event_id, "
       + ", ".join(f"{e} AS {n}" for n, e in {**base_feature_sql(), **cross_feature_sql()}.items())
       + " FROM feat)\nSELECT event_id, "
       + ", ".join(_r(n, f"CASE WHEN {n} IS NULL OR isnan({n}) OR isinf({n}) THEN 0.0 ELSE {n} END")
                   for n in _NF_COLS) + " FROM x")
def q_nonfinite_to_zero(spark, sf_dir):
    f = features(spark, sf_dir)
    f = f.select("event_id", *[e.alias(n) for n, e in base_feature_exprs().items()], *f.columns[1:])
    f = f.select("event_id", *BASE_FEATURES, *[e.alias(n) for n, e in cross_feature_exprs().items()])
    return rounded(f.select("event_id", *[finite_or_zero(F.col(n)).alias(n) for n in _NF_COLS]), only=TRANSCENDENTAL)
