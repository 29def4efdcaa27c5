"""The event log and the transition vocabulary.

The input is one event table ``(event_id, ts, user_id, event_type, value,
props)``.  Every event type is mapped to a lending action; four actions can
start a transition (index events), five can end one (outcome events).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Event type of the test log -> action name of the survival data.
ACTION_OF_TYPE = {
    "view": "Borrow",
    "signup": "Deposit",
    "click": "Repay",
    "purchase": "Withdraw",
    "error": "Liquidated",
}
# Actions that start a transition, in the order of the original pair loop.
INDEX_ACTIONS = ["Borrow", "Deposit", "Repay", "Withdraw"]
# Actions that end one: the index actions plus liquidation.
OUTCOME_ACTIONS = ["Borrow", "Deposit", "Repay", "Withdraw", "Liquidated"]
# Name of each action inside history column names (userLiquidationCount ...).
HISTORY_ACTIONS = {"Borrow": "Borrow", "Deposit": "Deposit", "Repay": "Repay",
                   "Withdraw": "Withdraw", "Liquidated": "Liquidation"}
# Rows whose event_id is a multiple of 5 are the unlabelled (test) side.
TEST_MODULUS = 5
# ---------------------------------------------------------------------------

KEYS = ["index_event", "outcome_event"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def action_col(type_col: Column) -> Column:
    """CASE over the fixed type -> action map (a literal map lookup)."""
    m = F.create_map(*[x for kv in ACTION_OF_TYPE.items() for x in map(F.lit, kv)])
    return m[type_col]


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the columns every operator relies on.

    ``ts`` is stored without a zone; with the session in UTC it is cast to a
    timestamp and ``ts_us`` (microseconds since the epoch) is the sort key.
    """
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("event_type"),
        action_col(F.col("event_type")).alias("action"),
        F.col("value").cast("double").alias("value"),
        F.col("props"),
    )


def split_col(row_id: Column) -> Column:
    """'train' for labelled rows, 'test' for the unlabelled side."""
    return F.when(row_id % TEST_MODULUS == 0, F.lit("test")).otherwise(F.lit("train"))


def transition_pairs(events: DataFrame) -> DataFrame:
    """Index x outcome actions without the diagonal, from the actions present.

    Each distinct index action is expanded over the fixed outcome list with
    ``explode`` (bounded by the vocabulary, no join), then the diagonal and
    outcomes absent from the log are removed with a semi join on the (tiny,
    distinct) outcome set.
    """
    present = events.select("action").distinct()
    idx = present.where(F.col("action").isin(INDEX_ACTIONS)).select(F.col("action").alias("index_event"))
    pairs = (idx.select("index_event", F.explode(F.array(*map(F.lit, OUTCOME_ACTIONS))).alias("outcome_event"))
             .where(F.col("index_event") != F.col("outcome_event")))
    outs = present.select(F.col("action").alias("outcome_event"))
    return pairs.join(F.broadcast(outs), "outcome_event", "left_semi").select(*KEYS)
