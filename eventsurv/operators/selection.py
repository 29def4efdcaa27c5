"""Column selection and correlation.

Correlations are ordinary aggregates (``corr`` per pair or per feature and
transition): one pass, map-side partial aggregation, the result is
columns x columns (or transitions x columns) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsurv.operators.moments import column_moments


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r as covariance / (std x std) over the rows where both values
    exist; NULL when a variance is 0
    (the built-in ``corr`` raises under ANSI mode there)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def _moments(means: np.ndarray):
    """Per task the sums over rows where both columns exist, of every pair:
    rows, x, x^2 and x y, of the values less the column means."""
    p = len(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, p, p))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - means
            here = (~np.isnan(x)).astype(float)
            x = np.where(np.isnan(x), 0.0, x)
            total += np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
        yield pa.RecordBatch.from_pydict({"src": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})
    return run


def _add(key, table):
    total = sum(np.frombuffer(b.as_py()) for b in table.column("sums"))
    return pa.table({"src": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def correlation_matrix(df: DataFrame, cols: list[str], fan_in: int = 256) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete rows), long form
    ``(col_a, col_b, corr)`` with ``col_a`` before ``col_b`` in ``cols``; NULL
    where a column does not vary.  Matrix products of row blocks inside the
    tasks, one columns x columns result; tasks' sums meet in two steps."""
    spark = df.sparkSession
    p = len(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    means = np.array([0.0 if m is None else m for m in means])
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])
    parts = df.select(x.alias("x")).mapInArrow(_moments(means), "src int, sums binary")
    for step in (fan_in, 1):
        parts = parts.withColumn("src", F.col("src") % step).groupBy("src").applyInArrow(_add, "src int, sums binary")
    rows = parts.collect()
    n, sx, sxx, sxy = np.frombuffer(rows[0]["sums"]).reshape(4, p, p) if rows else np.zeros((4, p, p))
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy - sx * sx.T / n                      # sx[i, j]: sum of x_i where x_j exists
        var = sxx - sx * sx / n
        var[var <= 1e-12 * (sxx + n * means[:, None] ** 2)] = 0.0
        r = cov / np.sqrt(var * var.T)
    for i in range(p):
        for j in range(i + 1, p):
            flat = n[i, j] < 2 or var[i, j] == 0 or var[j, i] == 0
            out.append((cols[i], cols[j], None if flat else float(r[i, j])))
    return spark.createDataFrame(out, "col_a string, col_b string, corr double")


def label_correlations(df: DataFrame, cols: list[str], label: Column, keys: list[str]) -> DataFrame:
    """``(keys, feature, r)``: correlation of each column with ``label`` per
    group of ``keys`` over the rows where both exist (one pass, transitions x
    columns numbers); NULL where either does not vary."""
    out = []
    with np.errstate(invalid="ignore", over="ignore"):
        for k, m in column_moments(df, cols, keys, label, nan_is_null=False).items():
            scale = np.sqrt(m[2]) * np.sqrt(m[6])
            out += [(*k, c, None if m[0, i] < 2 or scale[i] == 0 else float(m[7, i] / scale[i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(out, ", ".join(f"{k} string" for k in keys) + ", feature string, r double")


def select_long(df: DataFrame, selection: DataFrame, cols: list[str], keys: list[str],
                ids: tuple[str, ...] = ("row_id", "split")) -> DataFrame:
    """P5 in long form: ``(keys, ids, feature, value)`` for the selected
    ``(keys, feature)`` pairs.  The selection becomes one row per transition
    (its features and their places), which is broadcast, so that a row gives
    its selected features only, never all columns first."""
    place = F.array_position(F.array(*map(F.lit, cols)), F.col("feature")).cast("int")
    sel = (selection.select(*keys, "feature").distinct().withColumn("_place", place).where("_place > 0")
           .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", "feature"))).alias("_sel")))
    wide = df.select(*keys, *ids, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).join(F.broadcast(sel), keys, "inner")
    return (wide.select(*keys, *ids, "_x", F.explode("_sel").alias("_s"))
            .select(*keys, *ids, F.col("_s.feature").alias("feature"), F.element_at("_x", F.col("_s._place")).alias("value")))


def project_by_ordinal(df: DataFrame, names: list[str], order: list[int], head: list[str]) -> DataFrame:
    """``head`` columns first, then ``names[i]`` for i in ``order``."""
    return df.select(*head, *[names[i] for i in order])
