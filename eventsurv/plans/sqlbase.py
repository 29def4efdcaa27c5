"""DuckDB SQL for the oracle side: the same tables written as plain window
SQL (one unbucketed window per user and one over the whole log), so the
bucketed Spark scans are checked against the direct definition.

Only used to build ``oracle_sql()`` strings; nothing here runs on Spark.
"""

from __future__ import annotations

import math

from eventsurv.functions.calendar import CYCLE_PERIODS
from eventsurv.operators.history import (ACTIONS, ACTIVE_DAY_WINDOWS, BASE_NUMERIC, HISTORY_ACTIONS,
                                         MARKET_HISTORY_COLUMNS, USER_HISTORY_COLUMNS)
from eventsurv.sources.events import ACTION_OF_TYPE, INDEX_ACTIONS, OUTCOME_ACTIONS

KEYS = "index_event, outcome_event"


def _case_action() -> str:
    whens = " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in ACTION_OF_TYPE.items())
    return f"CASE event_type {whens} END"


def _hist_cols(prefix: str, win: str) -> list[str]:
    out = []
    for a in ACTIONS:
        n = f"{prefix}{HISTORY_ACTIONS[a]}"
        out.append(f"CAST(count(CASE WHEN action = '{a}' THEN 1 END) OVER {win} AS BIGINT) AS {n}Count")
        out.append(f"CAST(coalesce(sum(CASE WHEN action = '{a}' THEN CAST(value AS DECIMAL(18,6)) END) OVER {win}, 0) AS DOUBLE) AS {n}Sum")
    return out


def _stat_cols(prefix: str) -> list[str]:
    out = []
    for a in ACTIONS:
        n = f"{prefix}{HISTORY_ACTIONS[a]}"
        avg = f"CASE WHEN {n}Count = 0 THEN NULL ELSE {n}Sum / {n}Count END"
        out += [f"{n}Count", f"{n}Sum", f"{n}Sum AS {n}SumUSD", f"{avg} AS {n}AvgAmount", f"{avg} AS {n}AvgAmountUSD"]
    return out


def _calendar_cols() -> list[str]:
    vals = {
        "timeOfDay": "(hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0)",
        "dayOfWeek": "CAST(isodow(ts) - 1 AS DOUBLE)",
        "dayOfMonth": "CAST(dayofmonth(ts) AS DOUBLE)",
        "dayOfQuarter": "CAST(date_diff('day', CAST(date_trunc('quarter', ts) AS DATE), CAST(ts AS DATE)) + 1 AS DOUBLE)",
        "dayOfYear": "CAST(dayofyear(ts) AS DOUBLE)",
        "quarter": "CAST(quarter(ts) AS DOUBLE)",
    }
    out = [f"CAST({v} AS DOUBLE) AS {k}" for k, v in vals.items()]
    lower = {"TimeOfDay": "timeOfDay", "DayOfWeek": "dayOfWeek", "DayOfMonth": "dayOfMonth",
             "DayOfQuarter": "dayOfQuarter", "DayOfYear": "dayOfYear", "Quarter": "quarter"}
    for name, period in CYCLE_PERIODS.items():
        k = repr(2.0 * math.pi / period)
        out.append(f"sin({vals[lower[name]]} * {k}) AS sin{name}")
        out.append(f"cos({vals[lower[name]]} * {k}) AS cos{name}")
    out.append("(isodow(ts) >= 6) AS isWeekend")
    return out


def features_cte() -> str:
    """CTEs ``ev``, ``hist``, ``act``, ``feat`` (one row per event)."""
    wu = "(PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    wn = "(PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    wm = "(ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    hist = (_hist_cols("user", "wu") + _hist_cols("market", "wm")
            + ["min(ts_us) OVER wu AS first_us", "max(ts_us) OVER wu AS prev_us"]
            + [f"min(CASE WHEN action = '{o}' THEN ts_us END) OVER wn AS next_{o}_us" for o in OUTCOME_ACTIONS])
    act = [f"CAST(count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING) AS BIGINT) AS {name}"
           for name, n in ACTIVE_DAY_WINDOWS.items()]
    feat = (["h.event_id", "h.ts", "h.ts_us", "h.user_id", "h.event_type", "h.action",
             "value AS amount", "value * 1.0 AS amountUSD", "ln(1 + value) AS logAmount",
             "ln(1 + value * 1.0) AS logAmountUSD", "1.0 AS priceInUSD"]
            + _calendar_cols() + _stat_cols("user") + _stat_cols("market")
            + [f"a.{n}" for n in ACTIVE_DAY_WINDOWS]
            + ["(h.ts_us - first_us) // 1000000 AS userSecondsSinceFirstTransaction",
               "(h.ts_us - prev_us) // 1000000 AS userSecondsSincePreviousTransaction",
               "json_extract_string(props, '$.k') AS category"]
            + [f"next_{o}_us" for o in OUTCOME_ACTIONS])
    return f"""ev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, epoch_us(ts) AS ts_us, user_id, event_type, value, props,
         {_case_action()} AS action
  FROM events
),
hist AS (
  SELECT ev.*, {', '.join(hist)}
  FROM ev
  WINDOW wu AS {wu}, wn AS {wn}, wm AS {wm}
),
ud AS (SELECT DISTINCT user_id, ts_us // 86400000000 AS day FROM ev),
act AS (SELECT user_id, day, {', '.join(act)} FROM ud),
feat AS (
  SELECT {', '.join(feat)}
  FROM hist h JOIN act a ON a.user_id = h.user_id AND a.day = h.ts_us // 86400000000
)"""


FEATURE_COLUMNS = BASE_NUMERIC + ["isWeekend", "category"]


def trans_cte() -> str:
    """CTE ``trans``: the long labelled table (after ``features_cte``)."""
    outs = ", ".join(f"('{o}')" for o in OUTCOME_ACTIONS)
    nexts = " ".join(f"WHEN '{o}' THEN next_{o}_us" for o in OUTCOME_ACTIONS)
    idx = ", ".join(f"'{a}'" for a in INDEX_ACTIONS)
    return f"""outs(o) AS (VALUES {outs}),
trans0 AS (
  SELECT f.action AS index_event, o AS outcome_event, f.event_id AS row_id,
         CASE WHEN f.event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         CASE o {nexts} END AS nx, f.*
  FROM feat f, outs WHERE f.action IN ({idx}) AND o <> f.action
),
trans AS (
  SELECT index_event, outcome_event, row_id, split,
         (coalesce(nx, (SELECT max(ts_us) FROM ev)) - ts_us) / 1000000.0 AS timeDiff,
         CAST(nx IS NOT NULL AS INTEGER) AS status,
         {', '.join(FEATURE_COLUMNS)}
  FROM trans0
)"""


def d(x: str, y: str) -> str:
    return f"(CASE WHEN ({y}) = 0 THEN NULL ELSE CAST({x} AS DOUBLE) / CAST({y} AS DOUBLE) END)"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


def base_feature_sql() -> dict[str, str]:
    wk, mo, yr = "userActiveDaysWeekly", "userActiveDaysMonthly", "userActiveDaysYearly"
    mean3 = f"(({wk} + {mo} + {yr}) / 3.0)"
    std3 = f"sqrt((power({wk} - {mean3}, 2) + power({mo} - {mean3}, 2) + power({yr} - {mean3}, 2)) / 2.0)"
    return {
        "liquidation_risk": d("userLiquidationCount", "userBorrowCount + userDepositCount + 1"),
        "repayment_ratio": d("userRepaySum", "userBorrowSum + 1"),
        "leverage_ratio": d("userBorrowSumUSD", "userDepositSumUSD + 1"),
        "activity_volatility": std3,
        "transaction_frequency": d("userBorrowCount + userDepositCount + userRepayCount + userWithdrawCount",
                                   "userSecondsSinceFirstTransaction + 1"),
        "user_market_borrow_ratio": d("userBorrowAvgAmount", "marketBorrowAvgAmount + 1"),
        "user_market_deposit_ratio": d("userDepositAvgAmount", "marketDepositAvgAmount + 1"),
        "market_volatility_impact": d("abs(userBorrowAvgAmount - marketBorrowAvgAmount)", "marketBorrowAvgAmount + 1"),
        "is_business_hours": flag("timeOfDay >= 9 AND timeOfDay <= 17"),
        "is_month_end": flag("dayOfMonth >= 28"),
        "temporal_interaction": "sinDayOfMonth * cosDayOfWeek * sinTimeOfDay",
        "borrow_hazard": d("userBorrowCount", "userSecondsSinceFirstTransaction + 1"),
        "deposit_hazard": d("userDepositCount", "userSecondsSinceFirstTransaction + 1"),
    }


def outcome_feature_sql() -> dict[str, tuple[str, str]]:
    coll = d("userDepositSumUSD", "userBorrowSumUSD + 1")
    lev = d("userBorrowSumUSD", "userDepositSumUSD + 1")
    mvi = d("abs(userBorrowAvgAmount - marketBorrowAvgAmount)", "marketBorrowAvgAmount + 1")
    bh = flag("timeOfDay >= 9 AND timeOfDay <= 17")
    return {
        "liquidation_risk_score": ("Liquidated", f"(userLiquidationCount * 0.4 + {lev} * 0.3 + {mvi} * 0.3)"),
        "collateral_health": ("Liquidated", coll),
        "liquidation_proximity": ("Liquidated", d("1.0", f"{coll} + 0.1")),
        "repay_urgency": ("Repay", lev),
        "debt_maturity": ("Repay", d("userSecondsSinceFirstTransaction", "userBorrowCount + 1")),
        "repay_capacity": ("Repay", coll),
        "withdraw_opportunity": ("Withdraw", d("userDepositSumUSD", "marketDepositSumUSD + 1")),
        "withdraw_timing": ("Withdraw", "(timeOfDay * dayOfWeek / 7.0)"),
        "liquidity_preference": ("Withdraw", d("userWithdrawCount", "userDepositCount + 1")),
        "deposit_attractiveness": ("Deposit", d("marketDepositAvgAmountUSD", "userDepositAvgAmountUSD + 1")),
        "deposit_timing": ("Deposit", f"(CAST(isWeekend AS DOUBLE) * {bh})"),
        "deposit_momentum": ("Deposit", d("userDepositCount", "userSecondsSinceFirstTransaction + 1")),
        "borrow_necessity": ("Borrow", lev),
        "borrow_capacity": ("Borrow", d("userDepositSumUSD", "marketBorrowAvgAmountUSD + 1")),
        "borrow_risk_tolerance": ("Borrow", d("userLiquidationCount", "userBorrowCount + 1")),
    }


def cross_feature_sql() -> dict[str, str]:
    lev = d("userBorrowSumUSD", "userDepositSumUSD + 1")
    return {
        "user_activity_diversity": d("userBorrowCount + userDepositCount + userRepayCount + userWithdrawCount",
                                     "userSecondsSinceFirstTransaction + 1"),
        "market_engagement": f"(({d('userBorrowAvgAmount', 'marketBorrowAvgAmount + 1')} + "
                             f"{d('userDepositAvgAmount', 'marketDepositAvgAmount + 1')}) / 2.0)",
        "weekend_risk": "(CAST(isWeekend AS DOUBLE) * userLiquidationCount)",
        "month_end_risk": f"({flag('dayOfMonth >= 28')} * {lev})",
        "amount_volatility": d("abs(amount - userBorrowAvgAmount)", "userBorrowAvgAmount + 1"),
        "market_deviation": d("abs(amountUSD - marketBorrowAvgAmountUSD)", "marketBorrowAvgAmountUSD + 1"),
    }


def transf_cte() -> str:
    """CTE ``transf``: ``trans`` plus F1-F34 (after ``trans_cte``)."""
    cols = [f"{e} AS {n}" for n, e in base_feature_sql().items()]
    cols += [f"CASE WHEN outcome_event = '{o}' THEN {e} END AS {n}" for n, (o, e) in outcome_feature_sql().items()]
    cols += [f"{e} AS {n}" for n, e in cross_feature_sql().items()]
    return f"""transf AS (
  SELECT trans.*, {', '.join(cols)}
  FROM trans
)"""


def with_all(*extra: str) -> str:
    parts = [features_cte(), trans_cte(), transf_cte(), *extra]
    return "WITH " + ",\n".join(parts)


def rnd(cols: list[str], digits: int = 6) -> str:
    """Round (and turn -0.0 into 0.0) -- for transcendental or
    order-dependent values only; exact arithmetic is left as it is."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"
