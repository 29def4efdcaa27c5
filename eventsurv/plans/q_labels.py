"""Queries over the labelled transitions: sources, labels, durations
(S3, S4, S7, S8, D1, L1-L5, A7-A10, P4, P8)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from eventsurv.functions.labels import raw_duration, signed_duration, signed_log_duration, transition_key
from eventsurv.operators.capping import cap_diagnostics, cap_durations, capped_labels, exact_quantiles
from eventsurv.operators.history import FEATURE_COLUMNS, event_states, with_features
from eventsurv.operators.transitions import KEYS, survival_table, transition_counts
from eventsurv.plans.catalog import query, rounded
from eventsurv.plans.sqlbase import _case_action, rnd, with_all
from eventsurv.sources.materialize import materialize_once, source_key
from eventsurv.sources.events import INDEX_ACTIONS, OUTCOME_ACTIONS, load_events, transition_pairs

K = ", ".join(KEYS)


# bump when the feature definitions change (part of the materialized table key)
FEATURE_VERSION = 2


def feature_table(spark, sf_dir):
    """Per-event features; the scans' counts, sums and times are written once per session to the checkpoint folder."""
    events_path = f"{sf_dir.rstrip('/')}/events.parquet"
    return with_features(materialize_once(spark, ("event_states", FEATURE_VERSION, *source_key(events_path)),
                                          lambda: event_states(load_events(spark, sf_dir))))


def labelled(spark, sf_dir, keep=None):
    """The long labelled table (all transitions, train and test rows)."""
    return survival_table(feature_table(spark, sf_dir), keep=keep)


def train_labels(spark, sf_dir):
    return labelled(spark, sf_dir, keep=[]).where(F.col("split") == "train")


# --- S4 -----------------------------------------------------------------------
_idx = ", ".join(f"'{a}'" for a in INDEX_ACTIONS)
_out = ", ".join(f"'{a}'" for a in OUTCOME_ACTIONS)


@query("transition_pairs", f"""
WITH a AS (SELECT DISTINCT {_case_action()} AS action FROM events)
SELECT i.action AS index_event, o.action AS outcome_event
FROM a i JOIN a o ON i.action <> o.action
WHERE i.action IN ({_idx}) AND o.action IN ({_out})""")
def q_transition_pairs(spark, sf_dir):
    return transition_pairs(load_events(spark, sf_dir))


# --- D1 + A10 (the flagship) --------------------------------------------------
@query("transition_counts", with_all() + f"""
SELECT {K}, count(*) AS n_rows, CAST(sum(status) AS BIGINT) AS n_events,
       CAST(sum(1 - status) AS BIGINT) AS n_censored, sum(status) / count(*) AS event_share
FROM trans GROUP BY {K}""")
def q_transition_counts(spark, sf_dir):
    return transition_counts(labelled(spark, sf_dir, keep=[]))


# --- F47: one string per transition ---------------------------------------------
@query("transition_keys", with_all() + """
SELECT index_event || '_' || outcome_event AS transition, split, count(*) AS n_rows
FROM trans GROUP BY ALL""")
def q_transition_keys(spark, sf_dir):
    t = labelled(spark, sf_dir, keep=[])
    return (t.groupBy(*KEYS, "split").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(transition_key().alias("transition"), "split", "n_rows"))


# --- S3: expected (transition, side) grid with its row count -------------------
@query("missing_transitions", with_all() + f"""
, grid AS (
  SELECT i.a AS index_event, o.a AS outcome_event, s.a AS split
  FROM (VALUES {', '.join(f"('{a}')" for a in INDEX_ACTIONS)}) i(a),
       (VALUES {', '.join(f"('{a}')" for a in OUTCOME_ACTIONS)}) o(a),
       (VALUES ('train'), ('test')) s(a)
  WHERE i.a <> o.a
), c AS (SELECT {K}, split, count(*) AS n FROM trans GROUP BY ALL)
SELECT g.index_event, g.outcome_event, g.split, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows,
       coalesce(c.n, 0) = 0 AS missing
FROM grid g LEFT JOIN c USING (index_event, outcome_event, split)""")
def q_missing_transitions(spark, sf_dir):
    t = labelled(spark, sf_dir, keep=[])
    counts = t.groupBy(*KEYS, "split").agg(F.count(F.lit(1)).alias("n"))
    grid = (t.sparkSession.range(1)
            .select(F.explode(F.array(*map(F.lit, INDEX_ACTIONS))).alias("index_event"))
            .select("index_event", F.explode(F.array(*map(F.lit, OUTCOME_ACTIONS))).alias("outcome_event"))
            .where(F.col("index_event") != F.col("outcome_event"))
            .select(*KEYS, F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split")))
    # grid and counts are bounded by the fixed vocabulary (32 rows)
    j = grid.join(F.broadcast(counts), [*KEYS, "split"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return j.select(*KEYS, "split", n.alias("n_rows"), (n == 0).alias("missing"))


# --- S7/S8: rows and columns per transition and side ----------------------------
_n_train_cols = 2 + len(FEATURE_COLUMNS)           # labels + features
_n_test_cols = len(FEATURE_COLUMNS)


@query("column_counts", with_all() + f"""
SELECT {K}, split, count(*) AS n_rows,
       CASE WHEN split = 'train' THEN {_n_train_cols} ELSE {_n_test_cols} END AS n_columns
FROM trans GROUP BY ALL""")
def q_column_counts(spark, sf_dir):
    t = labelled(spark, sf_dir)
    n_feat = len([c for c in t.columns if c not in (*KEYS, "row_id", "split", "timeDiff", "status")])
    return (t.groupBy(*KEYS, "split").agg(F.count(F.lit(1)).alias("n_rows"))
            .select("*", F.when(F.col("split") == "train", F.lit(n_feat + 2)).otherwise(F.lit(n_feat)).alias("n_columns")))


# --- D1 -------------------------------------------------------------------------
@query("survival_labels", with_all() + f"""
SELECT {K}, row_id, split, timeDiff, status FROM trans""")
def q_survival_labels(spark, sf_dir):
    return labelled(spark, sf_dir, keep=[]).select(*KEYS, "row_id", "split", "timeDiff", "status")


# --- L1-L3 ----------------------------------------------------------------------
@query("signed_label", with_all() + f"""
SELECT {K}, row_id, CASE WHEN status = 1 THEN timeDiff ELSE -timeDiff END AS label
FROM trans WHERE split = 'train'""")
def q_signed_label(spark, sf_dir):
    t = train_labels(spark, sf_dir)
    return t.select(*KEYS, "row_id", signed_duration(F.col("timeDiff"), F.col("status")).alias("label"))


@query("signed_log_label", with_all() + f"""
SELECT {K}, row_id, round(CASE WHEN status = 1 THEN ln(timeDiff + 1) ELSE -ln(timeDiff + 1) END, 6) + 0.0 AS label
FROM trans WHERE split = 'train'""")
def q_signed_log_label(spark, sf_dir):
    t = train_labels(spark, sf_dir)
    return rounded(t.select(*KEYS, "row_id", signed_log_duration(F.col("timeDiff"), F.col("status")).alias("label")))


@query("raw_duration_label", with_all() + f"""
SELECT {K}, row_id, timeDiff AS label FROM trans WHERE split = 'train'""")
def q_raw_duration_label(spark, sf_dir):
    t = train_labels(spark, sf_dir)
    return t.select(*KEYS, "row_id", raw_duration(F.col("timeDiff")).alias("label"))


# --- A7/A8 ----------------------------------------------------------------------
@query("duration_quantiles", with_all() + f"""
SELECT {K}, quantile_cont(timeDiff, 0.98) AS q98, quantile_cont(timeDiff, 0.99) AS q99,
       min(timeDiff) AS min_t, max(timeDiff) AS max_t, quantile_cont(timeDiff, 0.5) AS median_t
FROM trans WHERE split = 'train' GROUP BY ALL""")
def q_duration_quantiles(spark, sf_dir):
    t = train_labels(spark, sf_dir)
    qs = exact_quantiles(t, "timeDiff", [0.98, 0.99, 0.5])
    wide = qs.groupBy(*KEYS).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n)
                                   for q, n in ((0.98, "q98"), (0.99, "q99"), (0.5, "median_t"))])
    mm = t.groupBy(*KEYS).agg(F.min("timeDiff").alias("min_t"), F.max("timeDiff").alias("max_t"))
    return wide.join(mm, KEYS, "inner").select(*KEYS, "q98", "q99", "min_t", "max_t", "median_t")


# --- L4/L5/A9 -------------------------------------------------------------------
_CAP = f"""
, caps AS (SELECT {K}, quantile_cont(timeDiff, {{q}}) AS cap FROM trans WHERE split = 'train' GROUP BY ALL)
, capped AS (
  SELECT t.*, c.cap, least(greatest(t.timeDiff, 0.0), c.cap) AS timeDiff_capped,
         CAST(CASE WHEN t.status = 1 AND t.timeDiff > c.cap THEN 0 ELSE t.status END AS INTEGER) AS status_adjusted
  FROM trans t JOIN caps c USING (index_event, outcome_event) WHERE t.split = 'train')"""


@query("cap_recensor", with_all() + _CAP.format(q=0.99) + f"""
SELECT {K}, row_id, timeDiff_capped, status_adjusted FROM capped""")
def q_cap_recensor(spark, sf_dir):
    c = cap_durations(train_labels(spark, sf_dir), 0.99)
    return c.select(*KEYS, "row_id", "timeDiff_capped", "status_adjusted")


@query("cap_signed_log", with_all() + _CAP.format(q=0.98) + f"""
SELECT {K}, row_id,
       CASE WHEN status_adjusted = 1 THEN timeDiff_capped ELSE -timeDiff_capped END AS label_signed_capped,
       round(CASE WHEN status_adjusted = 1 THEN ln(timeDiff_capped + 1) ELSE -ln(timeDiff_capped + 1) END, 6) + 0.0 AS label_signed_log_capped
FROM capped""")
def q_cap_signed_log(spark, sf_dir):
    c = capped_labels(train_labels(spark, sf_dir), 0.98)
    return rounded(c.select(*KEYS, "row_id", "label_signed_capped", "label_signed_log_capped"),
                   only=["label_signed_log_capped"])


@query("cap_diagnostics", with_all() + _CAP.format(q=0.98) + f"""
SELECT {K}, max(cap) AS cap,
       count(*) FILTER (WHERE status = 1 AND status_adjusted = 0) AS n_recensored,
       count(*) FILTER (WHERE status = 1) AS n_events,
       count(*) FILTER (WHERE status = 0) AS n_censored_before,
       count(*) FILTER (WHERE status_adjusted = 0) AS n_censored_after,
       min(timeDiff) AS min_t, max(timeDiff) AS max_t, quantile_cont(timeDiff, 0.5) AS median_t,
       max(timeDiff_capped) AS max_t_capped, quantile_cont(timeDiff_capped, 0.5) AS median_t_capped
FROM capped GROUP BY ALL""")
def q_cap_diagnostics(spark, sf_dir):
    return cap_diagnostics(train_labels(spark, sf_dir), 0.98)


# --- P4 / P8 / A10 --------------------------------------------------------------
@query("positive_durations", with_all() + f"""
SELECT {K}, row_id, timeDiff, status FROM trans WHERE split = 'train' AND timeDiff > 0""")
def q_positive_durations(spark, sf_dir):
    t = train_labels(spark, sf_dir).where(F.col("timeDiff") > 0)
    return t.select(*KEYS, "row_id", "timeDiff", "status")


@query("class_split", with_all() + f"""
SELECT {K}, status, count(*) AS n,
       100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {K}) AS pct
FROM trans WHERE split = 'train' GROUP BY {K}, status""")
def q_class_split(spark, sf_dir):
    from pyspark.sql import Window
    t = train_labels(spark, sf_dir)
    g = t.groupBy(*KEYS, "status").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*KEYS))
    return g.select(*KEYS, "status", "n", (100.0 * F.col("n") / tot).alias("pct"))
