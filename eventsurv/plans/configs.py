"""Model configuration tables.

Configurations are small DataFrames joined to the transitions present in the
data (a broadcast join: their size is fixed by the transition vocabulary),
so one job trains or scores every transition with its own parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["index_event", "outcome_event"]
PARAM_COLUMNS = ["max_depth", "eta", "subsample", "colsample_bytree", "min_child_weight", "lambda", "alpha", "gamma"]

# --- fixed values -----------------------------------------------------------
# Per-transition booster parameters (M12):
# (index, outcome, max_depth, eta, subsample, colsample_bytree, min_child_weight, lambda, alpha, gamma)
TRANSITION_PARAMS = [
    ("Withdraw", "Liquidated", 8, 0.02, 0.9, 0.9, 1, 1.0, 0.1, 0.0),
    ("Withdraw", "Repay", 7, 0.025, 0.85, 0.85, 2, 1.5, 0.2, 0.0),
    ("Withdraw", "Borrow", 7, 0.025, 0.85, 0.85, 2, 1.5, 0.2, 0.0),
    ("Deposit", "Liquidated", 7, 0.025, 0.85, 0.85, 2, 1.5, 0.2, 0.0),
    ("Deposit", "Repay", 6, 0.03, 0.8, 0.8, 3, 2.0, 0.3, 0.1),
    ("Deposit", "Borrow", 6, 0.03, 0.8, 0.8, 3, 2.0, 0.3, 0.1),
    ("Deposit", "Withdraw", 6, 0.03, 0.8, 0.8, 3, 2.0, 0.3, 0.1),
    ("Repay", "Borrow", 5, 0.05, 0.7, 0.7, 5, 3.0, 0.5, 0.2),
    ("Repay", "Withdraw", 4, 0.06, 0.6, 0.6, 7, 4.0, 0.7, 0.3),
    ("Repay", "Liquidated", 4, 0.06, 0.6, 0.6, 7, 4.0, 0.7, 0.3),
    ("Repay", "Deposit", 5, 0.05, 0.7, 0.7, 5, 3.0, 0.5, 0.2),
    ("Borrow", "Deposit", 5, 0.05, 0.7, 0.7, 5, 3.0, 0.5, 0.2),
    ("Borrow", "Withdraw", 4, 0.06, 0.6, 0.6, 7, 4.0, 0.7, 0.3),
    ("Borrow", "Liquidated", 4, 0.06, 0.6, 0.6, 7, 4.0, 0.7, 0.3),
    ("Borrow", "Repay", 5, 0.05, 0.7, 0.7, 5, 3.0, 0.5, 0.2),
    ("Withdraw", "Deposit", 6, 0.03, 0.8, 0.8, 3, 2.0, 0.3, 0.1),
]
# Per-transition number of rounds.
TRANSITION_ROUNDS = [
    ("Withdraw", "Liquidated", 600),
    ("Withdraw", "Repay", 700),
    ("Withdraw", "Borrow", 700),
    ("Deposit", "Liquidated", 700),
    ("Deposit", "Repay", 800),
    ("Deposit", "Borrow", 800),
    ("Deposit", "Withdraw", 800),
    ("Withdraw", "Deposit", 800),
    ("Repay", "Borrow", 1000),
    ("Repay", "Withdraw", 1200),
    ("Repay", "Liquidated", 1200),
    ("Repay", "Deposit", 1000),
    ("Borrow", "Deposit", 1000),
    ("Borrow", "Withdraw", 1200),
    ("Borrow", "Liquidated", 1200),
    ("Borrow", "Repay", 1000),
]
# Fallback when a transition has no entry (P12): 800 rounds, balanced set.
DEFAULT_ROUNDS = 800
# Ensemble strategies (E4): name -> (max_depth, eta, subsample, colsample_bytree,
# min_child_weight, lambda, alpha, gamma, seed)
STRATEGY_PARAMS = {
    "conservative": (4, 0.05, 0.7, 0.7, 5, 3.0, 0.5, 0.2, 42),
    "aggressive": (8, 0.02, 0.9, 0.9, 1, 1.0, 0.1, 0.0, 43),
    "balanced": (6, 0.03, 0.8, 0.8, 3, 2.0, 0.3, 0.1, 44),
}
# Strategy rule (P13): three (strategy, rounds, weight) per transition class.
STRONG_MEMBERS = [("aggressive", 900, 0.5), ("balanced", 1000, 0.3), ("conservative", 1000, 0.2)]
WEAK_MEMBERS = [("conservative", 1500, 0.5), ("balanced", 1300, 0.3), ("aggressive", 1100, 0.2)]
MODERATE_MEMBERS = [("balanced", 1100, 0.4), ("aggressive", 900, 0.3), ("conservative", 1200, 0.3)]
STRONG_INDEX, STRONG_OUTCOMES = "Withdraw", ["Liquidated", "Repay", "Borrow"]
WEAK_INDEXES, WEAK_OUTCOMES = ["Repay", "Borrow"], ["Withdraw", "Liquidated"]
# Run grid of one booster (M18): (run, rounds, eta, feature set)
RUN_GRID = [
    ("rounds_500", 500, 0.03, "engineered"),
    ("rounds_800", 800, 0.03, "engineered"),
    ("rounds_1000", 1000, 0.03, "engineered"),
    ("rounds_1500", 1500, 0.03, "engineered"),
    ("base_500", 500, 0.03, "base"),
]
# Five-model blend weights (E1); they sum to 1.05 and are renormalised.
BLEND_WEIGHTS = [0.5, 0.2, 0.15, 0.1, 0.1]
# The five models of that blend, 500 rounds each: (max_depth, eta, subsample,
# colsample_bytree, min_child_weight, lambda, alpha, gamma, seed)
FIVE_MODELS = [
    (5, 0.05, 0.8, 0.8, 5, 3.0, 0.5, 0.0, 42),
    (6, 0.03, 0.85, 0.75, 4, 2.0, 0.3, 0.0, 123),
    (7, 0.08, 0.9, 0.9, 3, 1.0, 0.1, 0.0, 456),
    (4, 0.02, 0.75, 0.85, 6, 4.0, 0.7, 0.0, 789),
    (5, 0.06, 0.82, 0.82, 4, 2.5, 0.4, 0.0, 101112),
]
FIVE_ROUNDS = 500
# One booster of the variant grid (M18), rounds and eta from the grid.
GRID_PARAMS = (6, 0.03, 0.85, 0.85, 3, 2.0, 0.3, 0.1, 42)
# Two-stage selection (M16): columns kept, rounds of either stage.
SELECT_TOP_N, SELECT_ROUNDS = 40, 500
# Patience of early stopping (M13): on a tenth of the rows.
PATIENCE, HOLD_OUT = 100, 0.1
# Boosted squared loss.
L2_PARAMS = {"max_depth": 3, "eta": 0.001, "colsample": 0.8, "lam": 1.0, "alpha": 1.0, "min_leaf": 20, "gamma": 0.1, "seed": 42,
             "min_child_weight": 0.001}
L2_ROUNDS = 500
# ---------------------------------------------------------------------------


def transition_params(spark: SparkSession) -> DataFrame:
    schema = ("index_event string, outcome_event string, max_depth int, eta double, subsample double, "
              "colsample_bytree double, min_child_weight int, lambda double, alpha double, gamma double")
    return spark.createDataFrame(TRANSITION_PARAMS, schema)


def transition_rounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITION_ROUNDS, "index_event string, outcome_event string, rounds int")


def params_with_default(pairs: DataFrame) -> DataFrame:
    """Every transition in ``pairs`` with its parameters and rounds, or
    the balanced set and 800 rounds when it has no entry."""
    spark = pairs.sparkSession
    p = pairs.join(F.broadcast(transition_params(spark)), KEYS, "left") \
             .join(F.broadcast(transition_rounds(spark)), KEYS, "left")
    bal = dict(zip(PARAM_COLUMNS, STRATEGY_PARAMS["balanced"]))
    return p.select(*KEYS, *[F.coalesce(F.col(c), F.lit(bal[c])).alias(c) for c in PARAM_COLUMNS],
                    F.coalesce(F.col("rounds"), F.lit(DEFAULT_ROUNDS)).alias("rounds"),
                    F.col("max_depth").isNull().alias("is_default"))


def _members(ms) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("member"), F.lit(s).alias("strategy"), F.lit(r).alias("rounds"),
                              F.lit(w).alias("weight")) for i, (s, r, w) in enumerate(ms)])


def strategy_table(pairs: DataFrame) -> DataFrame:
    """Three ensemble members per transition (strategy, rounds,
    weight) chosen by the transition class, with the strategy parameters."""
    ie, oe = F.col("index_event"), F.col("outcome_event")
    strong = (ie == STRONG_INDEX) & oe.isin(STRONG_OUTCOMES)
    weak = ie.isin(WEAK_INDEXES) & oe.isin(WEAK_OUTCOMES)
    cls = F.when(strong, F.lit("strong")).when(weak, F.lit("weak")).otherwise(F.lit("moderate"))
    members = F.when(strong, _members(STRONG_MEMBERS)).when(weak, _members(WEAK_MEMBERS)) \
        .otherwise(_members(MODERATE_MEMBERS))
    t = pairs.select(*KEYS, cls.alias("class"), F.explode(members).alias("_m")).select(*KEYS, "class", "_m.*")
    names = PARAM_COLUMNS + ["seed"]
    sp = pairs.sparkSession.createDataFrame([(k, *v) for k, v in STRATEGY_PARAMS.items()],
                                            "strategy string, max_depth int, eta double, subsample double, "
                                            "colsample_bytree double, min_child_weight int, lambda double, "
                                            "alpha double, gamma double, seed int")
    return t.join(F.broadcast(sp), "strategy", "inner").select(*KEYS, "class", "member", "strategy", "rounds",
                                                               "weight", *names)


def run_grid(pairs: DataFrame) -> DataFrame:
    """Every transition x every run of the variant grid."""
    runs = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(r).alias("rounds"), F.lit(e).alias("eta"),
                              F.lit(fs).alias("feature_set")) for n, r, e, fs in RUN_GRID])
    return pairs.select(*KEYS, F.explode(runs).alias("_r")).select(*KEYS, "_r.*")
