"""Fitted preprocessing (A1-A6, F44-F46, P2, P3, P11) for all transitions at once.

``Preprocessor.fit`` runs two aggregate jobs over the labelled rows, keyed by
the transition: level counts of the categorical columns (top-k vocabulary)
and mean / population std / min / max of every numeric column.  Both results
are model-sized (transitions x columns) and are collected; ``transform``
joins them back with a broadcast whose row count is the number of
transitions, so every row is scaled in one narrow projection.

Semantics (kept from the pandas original):

* identifiers are dropped by name, absent names are ignored;
* categorical = string columns, numeric = numeric columns (booleans are
  neither, so ``isWeekend`` and one-hot columns are not scaled unless
  ``include_dummies``);
* a categorical level outside the k most frequent (ties: smaller level
  first) becomes ``"Other"``; NULL becomes ``"Other"``;
* z = (x - mean) / std with the population std (1 where it is 0), NULL and
  NaN are ignored by the fit and become 0 after scaling (mean imputation);
* a column whose scaled training values have zero variance is dropped.  In
  the long table it is kept but set to 0.0 (which is its value anyway) and
  listed by ``constant_columns``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsurv.operators.moments import column_moments

KEYS = ["index_event", "outcome_event"]
LABELS = ["timeDiff", "status"]
# --- fixed values -----------------------------------------------------------
# Identifier columns removed before preprocessing (missing ones are ignored).
DROP_COLUMNS = ["id", "user", "pool", "Index Event", "Outcome Event", "type", "timestamp"]
OTHER_LEVEL = "Other"
TOP_K = 10
# ---------------------------------------------------------------------------
# our own identifiers and bookkeeping columns, never features
ROW_COLUMNS = ["row_id", "split", "event_id", "user_id", "ts", "ts_us", "event_type", "action"]


def _is_numeric(dt) -> bool:
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)


def column_groups(df: DataFrame, keys=KEYS) -> tuple[list[str], list[str]]:
    """(categorical, numeric) feature columns from the schema (no job)."""
    skip = set(keys) | set(LABELS) | set(DROP_COLUMNS) | set(ROW_COLUMNS)
    cat = [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.StringType)]
    num = [f.name for f in df.schema.fields if f.name not in skip and _is_numeric(f.dataType)]
    return cat, num


def level_counts(df: DataFrame, cat_cols: list[str], keys=KEYS) -> DataFrame:
    """A1: rows per (transition, column, level); NULL levels are not counted."""
    if not cat_cols:
        return df.sparkSession.createDataFrame([], f"{', '.join(k + ' string' for k in keys)}, column string, level string, n bigint")
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                                                for c in cat_cols])).alias("_kv"))
    return (long.select(*keys, "_kv.column", "_kv.level").where(F.col("level").isNotNull())
            .groupBy(*keys, "column", "level").agg(F.count(F.lit(1)).alias("n")))


def top_levels(counts: DataFrame, k: int = TOP_K, keys=KEYS) -> DataFrame:
    """A2: the k most frequent levels per (transition, column), ties broken by
    the smaller level.  Partitioned by transition and column, so the rank
    works on the (small) count table."""
    w = Window.partitionBy(*keys, "column").orderBy(F.col("n").desc(), F.col("level").asc())
    return counts.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def group_rare(df: DataFrame, top: DataFrame, cat_cols: list[str], keys=KEYS) -> DataFrame:
    """A3: levels outside ``top`` (and NULL) become ``"Other"``.

    ``top`` has at most k rows per transition and column; it is broadcast."""
    out = df
    for c in cat_cols:
        hit = (top.where(F.col("column") == c)
               .select(*[F.col(k).alias(f"_hk_{k}") for k in keys], F.col("level").alias("_hl"),
                       F.lit(True).alias("_hit")))
        cond = F.col(c) == F.col("_hl")
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_hk_{k}"))
        out = (out.join(F.broadcast(hit), cond, "left")
               .select(*[x for x in out.columns if x != c],
                       F.when(F.col("_hit"), F.col(c)).otherwise(F.lit(OTHER_LEVEL)).alias(c)))
    return out.select(*df.columns)


def column_stats(df: DataFrame, cols: list[str], keys=KEYS) -> dict[tuple, dict[str, tuple]]:
    """A5 per transition and column: mean, population std, min, max of the
    non-NULL, non-NaN values (transitions x columns numbers, model-sized)."""
    out = {}
    for k, m in column_moments(df, cols, list(keys)).items():
        n = np.maximum(m[0], 1)
        out[k] = {c: (float(m[1, i]), math.sqrt(m[2, i] / n[i]) if m[2, i] >= 0 else math.nan, float(m[3, i]), float(m[4, i])) if m[0, i] else (None,) * 4
                  for i, c in enumerate(cols)}
    return out


def wide_stats(df: DataFrame, cols: list[str], keys=KEYS) -> DataFrame:
    """``column_stats`` laid out as one row per transition."""
    fields = [T.StructField(k, T.StringType()) for k in keys]
    for c in cols:
        fields += [T.StructField(f"{c}__{s}", T.DoubleType()) for s in ("mean", "std", "min", "max")]
    data = [[*k, *[v for c in cols for v in d[c]]] for k, d in column_stats(df, cols, keys).items()]
    return df.sparkSession.createDataFrame(data, T.StructType(fields))


@dataclass
class PreprocessModel:
    keys: list[str]
    cat_cols: list[str]
    num_cols: list[str]
    dummy_cols: list[str]
    top: DataFrame            # (keys, column, level, n, rank)   -- small
    first_level: DataFrame    # (keys, column, first level)      -- small
    stats: DataFrame          # one wide row per transition      -- small
    include_dummies: bool = False
    feature_cols: list[str] = field(default_factory=list)

    def scaler_stats(self) -> DataFrame:
        """A5 in long form: (keys, column, mean, std, scale, keep)."""
        st = self.stats
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"),
                                            F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("mn"),
                                            F.col(f"{c}__max").alias("mx")) for c in self.feature_cols]))
        long = st.select(*self.keys, rows.alias("_s")).select(*self.keys, "_s.*")
        return long.select(*self.keys, "column", "mean", "std",
                           F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0)).otherwise(F.col("std")).alias("scale"),
                           F.coalesce(F.col("mn") < F.col("mx"), F.lit(False)).alias("keep"))

    def constant_columns(self) -> DataFrame:
        """The columns dropped per transition (zero variance after scaling)."""
        return self.scaler_stats().where(~F.col("keep")).select(*self.keys, "column")

    def encode(self, df: DataFrame) -> DataFrame:
        """Rare levels grouped and, with ``include_dummies``, the indicator columns."""
        df = group_rare(df, self.top, self.cat_cols, self.keys)
        if not self.include_dummies or not self.dummy_cols:
            return df
        fl = self.first_level
        out = df
        for c in self.cat_cols:
            f = fl.where(F.col("column") == c).select(*self.keys, F.col("first_level").alias(f"_first_{c}"))
            out = out.join(F.broadcast(f), self.keys, "left")
        dummies = []
        for name in self.dummy_cols:
            c, lvl = name.split("__", 1)
            dummies.append(F.when((F.col(c) == F.lit(lvl)) & (F.col(f"_first_{c}") != F.lit(lvl)), F.lit(1.0))
                           .otherwise(F.lit(0.0)).alias(name))
        return out.select(*df.columns, *dummies)

    def transform(self, df: DataFrame, also: list[str] = []) -> DataFrame:
        """Encode, scale with the training statistics of the row's
        transition, fill NULL with 0, zero the dropped columns.  Test rows get
        the training columns; a training column missing from ``df`` is 0.
        Columns named in ``also`` are passed on as they are."""
        df = self.encode(df)
        present = set(df.columns)
        st = self.stats
        # one row per transition: means, scales and which columns vary, as arrays
        def every(of):
            return F.array(*[of(c) for c in self.feature_cols])

        def scale_of(c):
            std = F.col(f"{c}__std")
            return F.when((std == 0) | std.isNull(), F.lit(1.0)).otherwise(std)
        if not self.feature_cols:
            return df.join(F.broadcast(st), self.keys, "inner").select(*[x for x in df.columns if x in self.keys or x in ROW_COLUMNS or x in LABELS or x in also])
        st = st.select(*self.keys, every(lambda c: F.col(f"{c}__mean")).alias("_mean"), every(scale_of).alias("_scale"),
                       every(lambda c: F.coalesce(F.col(f"{c}__min") < F.col(f"{c}__max"), F.lit(False))).alias("_keep"))
        j = df.join(F.broadcast(st), self.keys, "inner")
        scaled = []
        for i, c in enumerate(self.feature_cols):
            x = F.col(c).cast("double") if c in present else F.lit(0.0)
            x = F.when(~F.isnan(x), x)
            keep = F.col("_keep")[i]
            z = F.coalesce((x - F.col("_mean")[i]) / F.col("_scale")[i], F.lit(0.0))
            scaled.append(F.when(keep, z).otherwise(F.lit(0.0)).alias(c))
        passthrough = [x for x in df.columns if x in self.keys or x in ROW_COLUMNS or x in LABELS or x in also]
        return j.select(*passthrough, *scaled)


class Preprocessor:
    """Estimator of :class:`PreprocessModel` (fit on the labelled rows)."""

    def __init__(self, keys=KEYS, top_k: int = TOP_K, include_dummies: bool = False):
        self.keys = list(keys)
        self.top_k = top_k
        self.include_dummies = include_dummies

    def fit(self, train: DataFrame) -> PreprocessModel:
        keys = self.keys
        train = train.drop(*DROP_COLUMNS)
        cat_cols, num_cols = column_groups(train, keys)
        counts = level_counts(train, cat_cols, keys)
        top = top_levels(counts, self.top_k, keys)
        # the vocabulary is at most k rows per transition and column
        top = top.sparkSession.createDataFrame(top.collect(), top.schema) if cat_cols else top
        # levels after grouping: kept levels, plus "Other" where any row was
        # outside them; pandas orders them as strings and drops the first
        grouped = group_rare(train.select(*keys, *cat_cols), top, cat_cols, keys) if cat_cols else None
        dummy_cols: list[str] = []
        first_level = None
        if cat_cols:
            levels = level_counts(grouped, cat_cols, keys).select(*keys, "column", "level")
            first_level = levels.groupBy(*keys, "column").agg(F.min("level").alias("first_level"))
            lv = levels.collect()
            fl = {(tuple(r[k] for k in keys), r["column"]): r["first_level"] for r in first_level.collect()}
            first_level = train.sparkSession.createDataFrame(
                [(*k, c, v) for (k, c), v in fl.items()],
                f"{', '.join(k + ' string' for k in keys)}, column string, first_level string")
            if self.include_dummies:
                names = {f"{r['column']}__{r['level']}" for r in lv
                         if r["level"] != fl[(tuple(r[k] for k in keys), r["column"])]}
                dummy_cols = sorted(names)
        model = PreprocessModel(keys, cat_cols, num_cols, dummy_cols, top, first_level, None,
                                self.include_dummies)
        encoded = model.encode(train) if (self.include_dummies and dummy_cols) else train
        feature_cols = num_cols + dummy_cols
        stats = wide_stats(encoded, feature_cols, keys)
        model.stats = stats
        model.feature_cols = feature_cols
        return model
