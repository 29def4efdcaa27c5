"""Ratio, interaction and hazard features (F1-F43, A16) as column expressions.

Every ratio ``x / (y + 1)`` uses ``try_divide`` so a denominator of zero gives
NULL (later mean-imputed) instead of an ANSI error.  Comparisons on NULL are
wrapped so that they give 0.0, as a pandas comparison on NaN gives False.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(name: str) -> Column:
    return F.col(name)


def d(x: Column, y: Column) -> Column:
    """Safe division: NULL when ``y`` is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def flag(cond: Column) -> Column:
    """1.0 / 0.0 with NULL -> 0.0."""
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def row_std(*cols: Column) -> Column:
    """Sample standard deviation across columns of one row, NULLs skipped
    (NULL when fewer than two values remain)."""
    xs = [x.cast("double") for x in cols]
    n = sum((x.isNotNull().cast("double") for x in xs), F.lit(0.0))
    mean = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), n)
    ss = sum((F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in xs), F.lit(0.0))
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


# --- F1-F13: base survival features ------------------------------------------

def base_feature_exprs() -> dict[str, Column]:
    e = {}
    e["liquidation_risk"] = d(c("userLiquidationCount"), c("userBorrowCount") + c("userDepositCount") + 1)
    e["repayment_ratio"] = d(c("userRepaySum"), c("userBorrowSum") + 1)
    e["leverage_ratio"] = d(c("userBorrowSumUSD"), c("userDepositSumUSD") + 1)
    e["activity_volatility"] = row_std(c("userActiveDaysWeekly"), c("userActiveDaysMonthly"), c("userActiveDaysYearly"))
    e["transaction_frequency"] = d(c("userBorrowCount") + c("userDepositCount") + c("userRepayCount") + c("userWithdrawCount"),
                                   c("userSecondsSinceFirstTransaction") + 1)
    e["user_market_borrow_ratio"] = d(c("userBorrowAvgAmount"), c("marketBorrowAvgAmount") + 1)
    e["user_market_deposit_ratio"] = d(c("userDepositAvgAmount"), c("marketDepositAvgAmount") + 1)
    e["market_volatility_impact"] = d(F.abs(c("userBorrowAvgAmount") - c("marketBorrowAvgAmount")), c("marketBorrowAvgAmount") + 1)
    e["is_business_hours"] = flag((c("timeOfDay") >= 9) & (c("timeOfDay") <= 17))
    e["is_month_end"] = flag(c("dayOfMonth") >= 28)
    e["temporal_interaction"] = c("sinDayOfMonth") * c("cosDayOfWeek") * c("sinTimeOfDay")
    e["borrow_hazard"] = d(c("userBorrowCount"), c("userSecondsSinceFirstTransaction") + 1)
    e["deposit_hazard"] = d(c("userDepositCount"), c("userSecondsSinceFirstTransaction") + 1)
    return e


BASE_FEATURES = ["liquidation_risk", "repayment_ratio", "leverage_ratio", "activity_volatility",
                 "transaction_frequency", "user_market_borrow_ratio", "user_market_deposit_ratio",
                 "market_volatility_impact", "is_business_hours", "is_month_end", "temporal_interaction",
                 "borrow_hazard", "deposit_hazard"]


# --- F14-F28: one branch per outcome action ----------------------------------

def outcome_feature_exprs() -> dict[str, tuple[str, Column]]:
    """name -> (outcome action the feature belongs to, expression).

    Expressions may refer to the base features by name, so they are applied
    after ``base_feature_exprs``.
    """
    collateral = d(c("userDepositSumUSD"), c("userBorrowSumUSD") + 1)
    return {
        "liquidation_risk_score": ("Liquidated", c("userLiquidationCount") * 0.4 + c("leverage_ratio") * 0.3
                                   + c("market_volatility_impact") * 0.3),
        "collateral_health": ("Liquidated", collateral),
        "liquidation_proximity": ("Liquidated", d(F.lit(1.0), collateral + 0.1)),
        "repay_urgency": ("Repay", d(c("userBorrowSumUSD"), c("userDepositSumUSD") + 1)),
        "debt_maturity": ("Repay", d(c("userSecondsSinceFirstTransaction"), c("userBorrowCount") + 1)),
        "repay_capacity": ("Repay", d(c("userDepositSumUSD"), c("userBorrowSumUSD") + 1)),
        "withdraw_opportunity": ("Withdraw", d(c("userDepositSumUSD"), c("marketDepositSumUSD") + 1)),
        "withdraw_timing": ("Withdraw", c("timeOfDay") * c("dayOfWeek") / 7.0),
        "liquidity_preference": ("Withdraw", d(c("userWithdrawCount"), c("userDepositCount") + 1)),
        "deposit_attractiveness": ("Deposit", d(c("marketDepositAvgAmountUSD"), c("userDepositAvgAmountUSD") + 1)),
        "deposit_timing": ("Deposit", c("isWeekend").cast("double") * c("is_business_hours")),
        "deposit_momentum": ("Deposit", d(c("userDepositCount"), c("userSecondsSinceFirstTransaction") + 1)),
        "borrow_necessity": ("Borrow", d(c("userBorrowSumUSD"), c("userDepositSumUSD") + 1)),
        "borrow_capacity": ("Borrow", d(c("userDepositSumUSD"), c("marketBorrowAvgAmountUSD") + 1)),
        "borrow_risk_tolerance": ("Borrow", d(c("userLiquidationCount"), c("userBorrowCount") + 1)),
    }


OUTCOME_FEATURES = ["liquidation_risk_score", "collateral_health", "liquidation_proximity",
                    "repay_urgency", "debt_maturity", "repay_capacity",
                    "withdraw_opportunity", "withdraw_timing", "liquidity_preference",
                    "deposit_attractiveness", "deposit_timing", "deposit_momentum",
                    "borrow_necessity", "borrow_capacity", "borrow_risk_tolerance"]


# --- F29-F34: cross-transition features --------------------------------------

def cross_feature_exprs() -> dict[str, Column]:
    return {
        "user_activity_diversity": d(c("userBorrowCount") + c("userDepositCount") + c("userRepayCount") + c("userWithdrawCount"),
                                     c("userSecondsSinceFirstTransaction") + 1),
        "market_engagement": (d(c("userBorrowAvgAmount"), c("marketBorrowAvgAmount") + 1)
                              + d(c("userDepositAvgAmount"), c("marketDepositAvgAmount") + 1)) / 2.0,
        "weekend_risk": c("isWeekend").cast("double") * c("userLiquidationCount"),
        "month_end_risk": c("is_month_end") * c("leverage_ratio"),
        "amount_volatility": d(F.abs(c("amount") - c("userBorrowAvgAmount")), c("userBorrowAvgAmount") + 1),
        "market_deviation": d(F.abs(c("amountUSD") - c("marketBorrowAvgAmountUSD")), c("marketBorrowAvgAmountUSD") + 1),
    }


CROSS_FEATURES = ["user_activity_diversity", "market_engagement", "weekend_risk", "month_end_risk",
                  "amount_volatility", "market_deviation"]
ENGINEERED_FEATURES = BASE_FEATURES + OUTCOME_FEATURES + CROSS_FEATURES


def add_survival_features(df):
    """F1-F13 (the base set), as one projection."""
    return df.select("*", *[e.alias(n) for n, e in base_feature_exprs().items()])


def add_transition_features(df, outcome_col: str = "outcome_event"):
    """F1-F34 on a long table: base features, the branch of the row's
    outcome action (NULL on rows of other outcomes), cross features."""
    df = add_survival_features(df)
    outs = [F.when(F.col(outcome_col) == F.lit(o), e).alias(n) for n, (o, e) in outcome_feature_exprs().items()]
    df = df.select("*", *outs)
    return df.select("*", *[e.alias(n) for n, e in cross_feature_exprs().items()])


# --- F35-F43: exploratory features -------------------------------------------

def guarded_ratio_exprs() -> dict[str, Column]:
    """A ratio only where the denominator is positive, else 0."""
    return {
        "borrow_to_deposit": F.when(c("userDepositSum") > 0, c("userBorrowSum") / c("userDepositSum")).otherwise(0.0),
        "liquidation_to_borrow": F.when(c("userBorrowSum") > 0, c("userLiquidationSum") / c("userBorrowSum")).otherwise(0.0),
        "repay_to_borrow": F.when(c("userBorrowSum") > 0, c("userRepaySum") / c("userBorrowSum")).otherwise(0.0),
    }


def interaction_exprs() -> dict[str, Column]:
    """Products, floored ratios and logs."""
    return {
        "userBorrow_interaction": c("userBorrowSum") * c("userBorrowAvgAmountUSD"),
        "userActivity_interaction": c("userActiveDaysWeekly") * c("userRepayCount"),
        "userRepayEfficiency": c("userRepaySumUSD") / F.greatest(c("userBorrowSumUSD"), F.lit(1.0)),
        "marketStress": c("marketBorrowSum") / F.greatest(c("marketDepositSum"), F.lit(1.0)),
        "logAmountUSD_1p": F.log1p(c("amountUSD")),
        "logUserBorrowSum": F.log1p(c("userBorrowSum")),
    }


def finite_or_zero(x: Column) -> Column:
    """NaN, +-inf and NULL -> 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)
