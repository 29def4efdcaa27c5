"""Queries over the fitted preprocessing (A1-A6, A12, A13, F44-F46, P3, P5,
P6, P11, S6, W2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventsurv.functions.features import ENGINEERED_FEATURES, add_transition_features
from eventsurv.operators.history import BASE_NUMERIC
from eventsurv.operators.preprocess import OTHER_LEVEL, Preprocessor, group_rare, level_counts, top_levels
from eventsurv.operators.selection import correlation_matrix, label_correlations, project_by_ordinal, select_long
from eventsurv.operators.transitions import KEYS
from eventsurv.plans.catalog import query, rounded
from eventsurv.plans.q_features import features
from eventsurv.plans.q_labels import labelled
from eventsurv.plans.sqlbase import features_cte, with_all

K = ", ".join(KEYS)
NUMERIC = BASE_NUMERIC + ENGINEERED_FEATURES          # the 112 scaled columns
SCI = "%.8e"                                          # stats are compared at 9 significant digits


def transf(spark, sf_dir):
    return add_transition_features(labelled(spark, sf_dir))


def train_rows(spark, sf_dir):
    return transf(spark, sf_dir).where(F.col("split") == "train")


# --- A1 / A2 / A3 / A4 ------------------------------------------------------------
_COUNTS = f"""
, cnt AS (SELECT {K}, 'category' AS "column", category AS level, count(*) AS n
          FROM trans WHERE split = 'train' AND category IS NOT NULL GROUP BY ALL)
, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K}, "column" ORDER BY n DESC, level) AS rank
                         FROM cnt) WHERE rank <= 10)
, grouped AS (SELECT t.*, CASE WHEN p.level IS NOT NULL THEN t.category ELSE 'Other' END AS category_grouped
              FROM trans t LEFT JOIN top p ON p.index_event = t.index_event AND p.outcome_event = t.outcome_event
                                           AND p.level = t.category)"""


@query("level_counts", with_all() + _COUNTS + f'\nSELECT {K}, "column", level, n FROM cnt')
def q_level_counts(spark, sf_dir):
    return level_counts(train_rows(spark, sf_dir), ["category"], KEYS)


@query("top10_levels", with_all() + _COUNTS + f'\nSELECT {K}, "column", level, n, CAST(rank AS INTEGER) AS rank FROM top')
def q_top10_levels(spark, sf_dir):
    t = top_levels(level_counts(train_rows(spark, sf_dir), ["category"], KEYS), 10, KEYS)
    return t.select(*KEYS, "column", "level", "n", F.col("rank").cast("int").alias("rank"))


@query("rare_to_other", with_all() + _COUNTS + f"\nSELECT {K}, row_id, split, category_grouped FROM grouped")
def q_rare_to_other(spark, sf_dir):
    t = transf(spark, sf_dir)
    top = top_levels(level_counts(t.where(F.col("split") == "train"), ["category"], KEYS), 10, KEYS)
    g = group_rare(t.select(*KEYS, "row_id", "split", "category"), top, ["category"], KEYS)
    return g.select(*KEYS, "row_id", "split", F.col("category").alias("category_grouped"))


@query("top10_recount_test", with_all() + _COUNTS + f"""
, recount AS (SELECT * FROM (SELECT {K}, category_grouped AS level, count(*) AS n,
                 row_number() OVER (PARTITION BY {K} ORDER BY count(*) DESC, category_grouped) AS rank
              FROM grouped WHERE split = 'train' GROUP BY {K}, category_grouped) WHERE rank <= 10)
SELECT g.index_event, g.outcome_event, g.row_id,
       CASE WHEN r.level IS NOT NULL THEN g.category ELSE 'Other' END AS category_test
FROM grouped g LEFT JOIN recount r ON r.index_event = g.index_event AND r.outcome_event = g.outcome_event
                                   AND r.level = g.category
WHERE g.split = 'test'""")
def q_top10_recount_test(spark, sf_dir):
    """A4 (compatibility form): the test side recounts the top 10 on the
    already grouped training column, where "Other" competes for a place."""
    t = transf(spark, sf_dir).select(*KEYS, "row_id", "split", "category")
    train = t.where(F.col("split") == "train")
    top = top_levels(level_counts(train, ["category"], KEYS), 10, KEYS)
    grouped_train = group_rare(train, top, ["category"], KEYS)
    recount = top_levels(level_counts(grouped_train, ["category"], KEYS), 10, KEYS)
    test = t.where(F.col("split") == "test")
    g = group_rare(test, recount, ["category"], KEYS)
    return g.select(*KEYS, "row_id", F.col("category").alias("category_test"))


# --- F44: one-hot with the first level dropped (long form: the hot column) --------
@query("one_hot_drop_first", with_all() + _COUNTS + f"""
, lv AS (SELECT {K}, min(category_grouped) AS first_level FROM grouped WHERE split = 'train' GROUP BY ALL)
SELECT g.index_event, g.outcome_event, g.row_id, g.split,
       CASE WHEN g.category_grouped = lv.first_level THEN NULL ELSE 'category__' || g.category_grouped END AS hot_column
FROM grouped g JOIN lv USING (index_event, outcome_event)""")
def q_one_hot_drop_first(spark, sf_dir):
    t = transf(spark, sf_dir).select(*KEYS, "row_id", "split", "category")
    model = Preprocessor(include_dummies=True).fit(t.where(F.col("split") == "train"))
    g = group_rare(t, model.top, ["category"], KEYS).join(
        F.broadcast(model.first_level.where(F.col("column") == "category")), KEYS, "inner")
    hot = F.when(F.col("category") == F.col("first_level"), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("category__"), F.col("category")))
    return g.select(*KEYS, "row_id", "split", hot.alias("hot_column"))


@query("one_hot_counts", with_all() + _COUNTS + f"""
, lv AS (SELECT {K}, min(category_grouped) AS first_level FROM grouped WHERE split = 'train' GROUP BY ALL)
, names AS (SELECT DISTINCT g.category_grouped AS level FROM grouped g JOIN lv USING (index_event, outcome_event)
            WHERE g.split = 'train' AND g.category_grouped <> lv.first_level)
, sides AS (SELECT {K}, split, count(*) AS n_rows FROM grouped GROUP BY ALL)
, ones AS (SELECT g.index_event, g.outcome_event, g.split, g.category_grouped AS level, count(*) AS n FROM grouped g JOIN lv USING (index_event, outcome_event)
           WHERE g.category_grouped <> lv.first_level GROUP BY ALL)
SELECT s.index_event, s.outcome_event, s.split, 'category__' || n.level AS "column", s.n_rows, coalesce(o.n, 0) AS n_ones
FROM sides s CROSS JOIN names n LEFT JOIN ones o USING (index_event, outcome_event, split, level)""")
def q_one_hot_counts(spark, sf_dir):
    """the indicator columns themselves: rows and ones of each, per transition and side."""
    t = transf(spark, sf_dir).select(*KEYS, "row_id", "split", "category")
    model = Preprocessor(include_dummies=True).fit(t.where(F.col("split") == "train"))
    wide = model.encode(t).groupBy(*KEYS, "split").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.col(f"`{c}`")).cast("long").alias(c) for c in model.dummy_cols])
    return wide.unpivot([*KEYS, "split", "n_rows"], [F.col(f"`{c}`") for c in model.dummy_cols], "column", "n_ones").select(*KEYS, "split", "column", "n_rows", "n_ones")


# --- A5 / A6 / F45 / F46 / P11 ---------------------------------------------------
def _stats_sql() -> str:
    aggs = []
    for c in NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        aggs += [f"avg({x}) AS {c}__mean", f"stddev_pop({x}) AS {c}__std", f"min({x}) AS {c}__min", f"max({x}) AS {c}__max"]
    return f"\n, st AS (SELECT {K}, {', '.join(aggs)} FROM transf WHERE split = 'train' GROUP BY {K})"


def _scaled_sql(split: str) -> str:
    cols = []
    for c in NUMERIC:
        scale = f"(CASE WHEN st.{c}__std = 0 OR st.{c}__std IS NULL THEN 1.0 ELSE st.{c}__std END)"
        keep = f"coalesce(st.{c}__min < st.{c}__max, false)"
        z = f"coalesce((CAST(t.{c} AS DOUBLE) - st.{c}__mean) / {scale}, 0.0)"
        cols.append(f"round(CASE WHEN {keep} THEN {z} ELSE 0.0 END, 6) + 0.0 AS {c}")
    return (with_all() + _stats_sql() + f"""
SELECT t.index_event, t.outcome_event, t.row_id, t.split, t.timeDiff, t.status, {', '.join(cols)}
FROM transf t JOIN st USING (index_event, outcome_event) WHERE t.split = '{split}'""")


def _fit(spark, sf_dir):
    t = transf(spark, sf_dir)
    model = Preprocessor().fit(t.where(F.col("split") == "train"))
    return t, model


@query("scaler_stats", with_all() + _stats_sql() + f"""
, lng AS (SELECT * FROM st UNPIVOT INCLUDE NULLS ((mean, std, mn, mx) FOR "column" IN
          ({', '.join(f"({c}__mean, {c}__std, {c}__min, {c}__max) AS '{c}'" for c in NUMERIC)})))
SELECT {K}, "column", printf('{SCI}', mean) AS mean, printf('{SCI}', std) AS std,
       coalesce(mn < mx, false) AS keep
FROM lng""")
def q_scaler_stats(spark, sf_dir):
    _, model = _fit(spark, sf_dir)
    s = model.scaler_stats()
    sci = {c: F.when(F.col(c).isNotNull(), F.format_string(SCI, c)) for c in ("mean", "std")}
    return s.select(*KEYS, "column", sci["mean"].alias("mean"), sci["std"].alias("std"), "keep")


@query("constant_columns", with_all() + _stats_sql() + f"""
, lng AS (SELECT * FROM st UNPIVOT INCLUDE NULLS ((mn, mx) FOR "column" IN
          ({', '.join(f"({c}__min, {c}__max) AS '{c}'" for c in NUMERIC)})))
SELECT {K}, "column" FROM lng WHERE NOT coalesce(mn < mx, false)""")
def q_constant_columns(spark, sf_dir):
    _, model = _fit(spark, sf_dir)
    return model.constant_columns()


@query("scaled_train", _scaled_sql("train"))
def q_scaled_train(spark, sf_dir):
    t, model = _fit(spark, sf_dir)
    out = model.transform(t.where(F.col("split") == "train"))
    return rounded(out.select(*KEYS, "row_id", "split", "timeDiff", "status", *NUMERIC), only=NUMERIC)


@query("scaled_test", _scaled_sql("test"))
def q_scaled_test(spark, sf_dir):
    t, model = _fit(spark, sf_dir)
    out = model.transform(t.where(F.col("split") == "test"))
    return rounded(out.select(*KEYS, "row_id", "split", "timeDiff", "status", *NUMERIC), only=NUMERIC)


def _corr(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    flat = [f"coalesce(stddev_samp(CASE WHEN {v} IS NOT NULL THEN {u} END), 0) = 0" for u, v in ((x, y), (y, x))]
    return f"(CASE WHEN {flat[0]} OR {flat[1]} THEN NULL ELSE corr({x}, {y}) END)"


# --- A13: Pearson correlations (pairwise complete rows) ---------------------------
CORR_COLUMNS = BASE_NUMERIC


@query("correlations", f"WITH {features_cte()}\n, w AS (SELECT "
       + ", ".join(f"{_corr(a, b)} AS \"{a}|{b}\"" for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1:])
       + " FROM feat)\n, l AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (r FOR pair IN ("
       + ", ".join(f'"{a}|{b}"' for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1:]) + ")))\n"
       + "SELECT split_part(pair, '|', 1) AS col_a, split_part(pair, '|', 2) AS col_b, round(r, 6) + 0.0 AS corr FROM l")
def q_correlations(spark, sf_dir):
    return rounded(correlation_matrix(features(spark, sf_dir), CORR_COLUMNS))


# --- P5 / A12 / W2 / S6: selection by correlation with the log duration ------------
SELECT_THRESHOLD = 0.05
TOP_N = 10


def _label_corr_sql() -> str:
    cs = ", ".join(f"{_corr(c, 'ln(timeDiff + 1)')} AS {c}" for c in NUMERIC)
    return (f"\n, lc AS (SELECT {K}, {cs} FROM transf WHERE split = 'train' GROUP BY {K})"
            f"\n, lcl AS (UNPIVOT lc ON {', '.join(NUMERIC)} INTO NAME feature VALUE r)"
            f"\n, sel AS (SELECT {K}, feature, r FROM lcl WHERE r IS NOT NULL AND abs(r) >= {SELECT_THRESHOLD})")


def _selection(spark, sf_dir):
    t = train_rows(spark, sf_dir)
    lc = label_correlations(t, NUMERIC, F.log1p(F.col("timeDiff")), KEYS)
    return lc.where(F.col("r").isNotNull() & (F.abs("r") >= SELECT_THRESHOLD))


@query("project_by_list", with_all() + _label_corr_sql() + f"\nSELECT {K}, feature, round(r, 6) + 0.0 AS r FROM sel")
def q_project_by_list(spark, sf_dir):
    return rounded(_selection(spark, sf_dir))


@query("feature_counts", with_all() + _label_corr_sql() + f"\nSELECT {K}, count(*) AS n_features FROM sel GROUP BY ALL")
def q_feature_counts(spark, sf_dir):
    return _selection(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_features"))


@query("topn_features", with_all() + _label_corr_sql() + f"""
SELECT {K}, feature, round(abs(r), 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY abs(r) DESC, feature) AS rank FROM sel) WHERE rank <= {TOP_N}""")
def q_topn_features(spark, sf_dir):
    s = _selection(spark, sf_dir)
    w = Window.partitionBy(*KEYS).orderBy(F.abs("r").desc(), F.col("feature").asc())
    top = s.select(*KEYS, "feature", F.abs("r").alias("score"), F.row_number().over(w).cast("int").alias("rank"))
    return rounded(top.where(F.col("rank") <= TOP_N))


@query("reduced_dataset", with_all() + _label_corr_sql() + f"""
, lng AS (SELECT * FROM (SELECT index_event, outcome_event, row_id, split, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUMERIC)}
                   FROM transf) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(NUMERIC)})))
SELECT l.index_event, l.outcome_event, l.row_id, l.split, l.feature, l.value
FROM lng l SEMI JOIN sel t ON t.index_event = l.index_event AND t.outcome_event = l.outcome_event AND t.feature = l.feature""")
def q_reduced_dataset(spark, sf_dir):
    """Train and test rows projected to each transition's selected
    columns (long form; the selection is joined with a left semi join)."""
    return select_long(transf(spark, sf_dir), _selection(spark, sf_dir), NUMERIC, KEYS)


# --- P6: projection by ordinal positions (labels first) -----------------------------
# --- fixed values ------------------------------------------------------------------
ORDINAL_ORDER = [7, 69, 53, 45, 6, 19, 65, 73, 2, 36, 74, 26, 42, 43, 3, 52, 4, 67, 17, 8, 37, 64, 38, 21, 39, 9, 1, 35, 31, 66, 28, 14, 30,
                 76, 13, 70, 40, 33, 24, 23, 15, 49, 50, 55, 27, 34, 16, 0, 12, 61, 20, 18, 48, 29, 77, 62, 44, 51, 47, 46, 72, 58, 41, 56,
                 10, 75, 63, 22, 11, 25, 71, 60, 68, 32, 54, 59, 5, 57]   # positions in BASE_NUMERIC
# -----------------------------------------------------------------------------------


@query("project_by_ordinal", with_all() + f"\nSELECT {K}, row_id, timeDiff, status, "
       + ", ".join(BASE_NUMERIC[i] for i in ORDINAL_ORDER) + " FROM trans WHERE split = 'train'")
def q_project_by_ordinal(spark, sf_dir):
    t = labelled(spark, sf_dir).where(F.col("split") == "train")
    return project_by_ordinal(t, BASE_NUMERIC, ORDINAL_ORDER, head=[*KEYS, "row_id", "timeDiff", "status"])
