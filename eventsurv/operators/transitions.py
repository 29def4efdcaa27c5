"""Labelled transitions (D1): index event -> first later outcome event.

Each index event of a user becomes one row per outcome action other than its
own.  ``timeDiff`` is the number of seconds to the user's first strictly
later outcome event, or to the end of the log when there is none
(``status`` 0, censored).  The end of the log is a scalar subquery, so no
join or driver round trip is needed for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsurv.operators.history import FEATURE_COLUMNS, NEXT_COLUMNS
from eventsurv.sources.events import INDEX_ACTIONS, OUTCOME_ACTIONS, split_col

KEYS = ["index_event", "outcome_event"]
SECOND = 1_000_000.0


def index_events(features: DataFrame, *columns) -> DataFrame:
    """``index_event, row_id, split, <columns>``: the events that start a transition."""
    return features.where(F.col("action").isin(INDEX_ACTIONS)).select(
        F.col("action").alias("index_event"), F.col("event_id").alias("row_id"), split_col(F.col("event_id")).alias("split"), *columns)


def with_outcomes(rows: DataFrame) -> DataFrame:
    """Rows that hold for an index event whatever follows, once per outcome
    action other than its own: as in ``survival_table``."""
    rest = [c for c in rows.columns if c != "index_event"]
    return (rows.select("index_event", F.explode(F.array(*map(F.lit, OUTCOME_ACTIONS))).alias("outcome_event"), *rest)
            .where(F.col("outcome_event") != F.col("index_event")))


def survival_table(features: DataFrame, censor_us=None, keep: list[str] | None = None) -> DataFrame:
    """Long table ``(index_event, outcome_event, row_id, split, timeDiff,
    status, <features>)`` for every index event and every other outcome.

    ``features`` is the output of ``event_features`` (it carries the next
    time of each outcome action).  ``censor_us`` defaults to the last
    timestamp of ``features`` as a scalar subquery.
    """
    if censor_us is None:
        censor_us = features.select(F.max("ts_us")).scalar()
    feat_cols = list(FEATURE_COLUMNS if keep is None else keep)
    idx = features.where(F.col("action").isin(INDEX_ACTIONS))
    # one struct per outcome action; the explode emits five per row and the
    # diagonal is dropped right after -- bounded by the fixed vocabulary
    outs = F.array(*[F.struct(F.lit(o).alias("o"), F.col(NEXT_COLUMNS[o]).alias("nx")) for o in OUTCOME_ACTIONS])
    long = (idx.select(F.col("action").alias("index_event"), "event_id", "ts_us", *feat_cols,
                       F.explode(outs).alias("_o"))
            .where(F.col("_o.o") != F.col("index_event")))
    return long.select(
        "index_event",
        F.col("_o.o").alias("outcome_event"),
        F.col("event_id").alias("row_id"),
        split_col(F.col("event_id")).alias("split"),
        ((F.coalesce(F.col("_o.nx"), censor_us) - F.col("ts_us")) / F.lit(SECOND)).alias("timeDiff"),
        F.col("_o.nx").isNotNull().cast("int").alias("status"),
        *feat_cols,
    )


def transition_counts(table: DataFrame) -> DataFrame:
    """A10 over the labels: rows, events, censored and the event share."""
    return (table.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("status").cast("bigint").alias("n_events"),
        F.sum(1 - F.col("status")).cast("bigint").alias("n_censored"),
    ).select(*KEYS, "n_rows", "n_events", "n_censored",
             F.round(F.col("n_events") / F.col("n_rows"), 6).alias("event_share")))
