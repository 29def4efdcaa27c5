"""Cox partial likelihood and gradients of given rows (M1 at a point, M11).

One Spark pass returns, per transition, the log-likelihood, gradient and
Hessian (p + p^2 numbers) at given coefficients.  The risk-set
sums S0(t) = sum_{t_j >= t} w_j, S1(t) and A(t) = sum_{s <= t} d_s / S0(s)
are ordered running sums over the distinct times, computed with the
range-partitioned scan (no single-task window).  With A(t):

        gradient = sum d_i x_i - sum_j w_j A(t_j) x_j
        hessian  = -(sum_j w_j A(t_j) x_j x_j' - sum_t D_t S1 S1' / S0^2)

Gradients of the Cox loss (M11) use the same sums with ``B(t) = sum_{s <= t}
d_s / S0(s)^2``.  The fitted models are in ``linear_models`` and ``booster``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsurv.operators.prefix import running_sums

KEYS = ["index_event", "outcome_event"]


def _dot(cols: list[str], coef_prefix: str = "_b_") -> Column:
    e = F.lit(0.0)
    for i, c in enumerate(cols):
        e = e + F.col(c) * F.col(f"{coef_prefix}{i}")
    return e


def _coef_table(spark, keys_list: list[tuple], betas: dict, p: int, keys=KEYS) -> DataFrame:
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys]
                          + [T.StructField(f"_b_{i}", T.DoubleType()) for i in range(p)])
    return spark.createDataFrame([(*k, *[float(v) for v in betas[k]]) for k in keys_list], schema)


def risk_sums(df: DataFrame, cols: list[str], coefs: DataFrame, keys=KEYS, time="timeDiff", event="status",
              with_s1: bool = True, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_w = exp(x beta)`` and the time table with S0, S1, A, B.

    Returns ``(rows, times)``; ``times`` has one row per (transition, time)."""
    rows = (df.join(F.broadcast(coefs), keys, "inner")
            .select(*keys, *carry, F.col(time).cast("double").alias("_t"), F.col(event).cast("double").alias("_d"),
                    *[F.col(c).cast("double").alias(c) for c in cols], _dot(cols).alias("_eta"))
            .withColumn("_w", F.exp("_eta")))
    sx = [F.sum(F.col("_w") * F.col(c)).alias(f"_sx_{i}") for i, c in enumerate(cols)] if with_s1 else []
    times = rows.groupBy(*keys, "_t").agg(F.sum("_w").alias("_sw"), F.sum("_d").alias("_D"), *sx)
    vals = ["_sw"] + ([f"_sx_{i}" for i in range(len(cols))] if with_s1 else [])
    # Sums over times >= t (descending order, inclusive)
    suf = running_sums(times, keys, [F.col("_t").desc()], vals, exclusive=False, prefix="_S")
    suf = suf.withColumn("_a", F.when(F.col("_D") > 0, F.col("_D") / F.col("_S_sw")).otherwise(F.lit(0.0))) \
             .withColumn("_bb", F.when(F.col("_D") > 0, F.col("_D") / (F.col("_S_sw") * F.col("_S_sw"))).otherwise(F.lit(0.0)))
    # A, B: sums over event times <= t (ascending, inclusive)
    pre = running_sums(suf, keys, [F.col("_t")], ["_a", "_bb"], exclusive=False, prefix="_P")
    return rows, pre


def cox_pass(df: DataFrame, cols: list[str], coefs: DataFrame, keys=KEYS, time="timeDiff", event="status"):
    """One pass: per transition ``(n, n_events, loglik, grad[p], hess[p x p])``."""
    p = len(cols)
    rows, times = risk_sums(df, cols, coefs, keys, time, event)
    j = rows.join(times.select(*keys, "_t", "_P_a"), [*keys, "_t"], "inner")
    wa = F.col("_w") * F.col("_P_a")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_d").alias("n_events"), F.sum(F.col("_d") * F.col("_eta")).alias("_deta")]
    aggs += [F.sum(F.col("_d") * F.col(c) - wa * F.col(c)).alias(f"_g_{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(wa * F.col(cols[a]) * F.col(cols[b])).alias(f"_h1_{a}_{b}") for a in range(p) for b in range(a, p)]
    r = {tuple(x[k] for k in keys): x.asDict() for x in j.groupBy(*keys).agg(*aggs).collect()}
    # time-table terms: sum_t D log S0 and sum_t D S1 S1' / S0^2
    ev = times.where(F.col("_D") > 0)
    taggs = [F.sum(F.col("_D") * F.log("_S_sw")).alias("_dlog")]
    taggs += [F.sum(F.col("_D") * F.col(f"_S_sx_{a}") * F.col(f"_S_sx_{b}") / (F.col("_S_sw") * F.col("_S_sw")))
              .alias(f"_h2_{a}_{b}") for a in range(p) for b in range(a, p)]
    tr = {tuple(x[k] for k in keys): x.asDict() for x in ev.groupBy(*keys).agg(*taggs).collect()}
    out = {}
    for k, a in r.items():
        b = tr.get(k, {})
        g = np.array([a[f"_g_{i}"] or 0.0 for i in range(p)])
        h = np.zeros((p, p))
        for u in range(p):
            for v in range(u, p):
                val = -((a[f"_h1_{u}_{v}"] or 0.0) - (b.get(f"_h2_{u}_{v}") or 0.0))
                h[u, v] = h[v, u] = val
        ll = (a["_deta"] or 0.0) - (b.get("_dlog") or 0.0)
        out[k] = {"n": a["n"], "n_events": a["n_events"], "loglik": ll, "grad": g, "hess": h}
    return out


def cox_gradients(df: DataFrame, margin: Column, keys=KEYS, time="timeDiff", event="status") -> DataFrame:
    """Per row ``g = w A(t) - d`` and ``h = w A(t) - w^2 B(t)`` of the
    Cox loss at the given margin (w = exp(margin))."""
    spark = df.sparkSession
    base = df.select("*", margin.alias("_m"))
    trans = [tuple(r[k] for k in keys) for r in base.select(*keys).distinct().collect()]
    coefs = _coef_table(spark, trans, {k: np.array([1.0]) for k in trans}, 1, keys)
    carry = tuple(c for c in ("row_id",) if c in base.columns)
    rows, times = risk_sums(base, ["_m"], coefs, keys, time, event, with_s1=False, carry=carry)
    rows = rows.join(times.select(*keys, "_t", "_P_a", "_P_bb"), [*keys, "_t"], "inner")
    w = F.col("_w")
    return rows.select(*keys, *carry, "_t", "_d", "_m", (w * F.col("_P_a") - F.col("_d")).alias("g"),
                       (w * F.col("_P_a") - w * w * F.col("_P_bb")).alias("h"))


def cox_loglik_at(df: DataFrame, cols: list[str], betas: dict, keys=KEYS) -> dict:
    """Partial log-likelihood (sum, Breslow) per transition at given coefficients."""
    spark = df.sparkSession
    trans = list(betas)
    res = cox_pass(df, cols, _coef_table(spark, trans, betas, len(cols), keys), keys)
    return {k: v["loglik"] for k, v in res.items()}
