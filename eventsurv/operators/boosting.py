"""Histogram split search of the Cox-loss booster (M11, first level).

Per round the booster needs, for every transition, node, feature and bin,
the sums of the gradient g and hessian h; the best split maximises

    gain = 1/2 [T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda)] - gamma

with T the soft threshold at alpha and both children holding at least
``min_child_weight`` hessian.  Rows move with one byte a feature, are unpivoted
over the features inside the scan and aggregated to (transition, feature, bin) -- transitions x
features x bins rows -- so all transitions share one job; the cumulative
sums run over at most ``bins`` rows per (transition, feature).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["index_event", "outcome_event"]


def equal_width_bins(df: DataFrame, cols: list[str], bins: int, keys=KEYS) -> DataFrame:
    """``(keys, row_id, bins)``: each feature cut into ``bins`` equal-width bins between
    its per-transition min and max, a row's bins as one array of bytes (null where the
    value is).  The ranges are one row a transition and are broadcast; rows stay where they are."""
    values = F.array(*[F.col(c).cast("double") for c in cols])
    rng = (df.select(*keys, F.posexplode(values).alias("_place", "_x")).groupBy(*keys, "_place").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
           .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", "_lo", "_hi"))).alias("_range")))
    j = df.join(F.broadcast(rng), keys, "inner")

    def number(i: int, c: str) -> Column:
        x, at = F.col(c).cast("double"), F.col("_range")[i]
        width = at["_hi"] - at["_lo"]
        b = F.when(width > 0, F.least(F.floor((x - at["_lo"]) / width * F.lit(bins)), F.lit(bins - 1))).otherwise(F.lit(0))
        return F.when(x.isNotNull(), b).cast("tinyint" if bins <= 128 else "int")
    return j.select(*keys, "row_id", F.array(*[number(i, c) for i, c in enumerate(cols)]).alias("bins"))


def soft_threshold(g: Column, alpha: float) -> Column:
    if alpha == 0:
        return g
    return F.signum(g) * F.greatest(F.abs(g) - F.lit(alpha), F.lit(0.0))


def best_first_split(binned: DataFrame, cols: list[str], lam: float = 1.0, alpha: float = 0.0, gamma: float = 0.0,
                     min_child_weight: float = 1.0, keys=KEYS) -> DataFrame:
    """``(keys, feature, bin, gain)``: the best root split per transition of rows
    ``(keys, bins, g, h)``, ``bins`` in the order of ``cols``
    (left child = bins <= ``bin``); ties go to the smaller feature name, then bin.
    The window ranks transitions x features x bins candidates (bounded)."""
    hist = (binned.select(*keys, "g", "h", F.posexplode("bins").alias("_place", "bin")).where(F.col("bin").isNotNull())
            .groupBy(*keys, "_place", "bin").agg(F.sum("g").alias("G"), F.sum("h").alias("H"))
            .select(*keys, F.array(*map(F.lit, cols))[F.col("_place")].alias("feature"), F.col("bin").cast("int").alias("bin"), "G", "H"))
    w = Window.partitionBy(*keys, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wt = Window.partitionBy(*keys, "feature")
    c = hist.select(*keys, "feature", "bin", F.sum("G").over(w).alias("GL"), F.sum("H").over(w).alias("HL"),
                    F.sum("G").over(wt).alias("GT"), F.sum("H").over(wt).alias("HT"))
    c = c.select("*", (F.col("GT") - F.col("GL")).alias("GR"), (F.col("HT") - F.col("HL")).alias("HR"))

    def score(g, h):
        t = soft_threshold(g, alpha)
        return t * t / (h + F.lit(lam))
    gain = F.lit(0.5) * (score(F.col("GL"), F.col("HL")) + score(F.col("GR"), F.col("HR"))
                         - score(F.col("GT"), F.col("HT"))) - F.lit(gamma)
    ok = (F.col("HL") >= min_child_weight) & (F.col("HR") >= min_child_weight)
    cand = c.where(ok).select(*keys, "feature", "bin", gain.alias("gain"))
    # gains equal up to float noise (features that cut the rows alike) are
    # ties: compare at 9 decimals, then by feature name and bin
    r = Window.partitionBy(*keys).orderBy(F.round("gain", 9).desc(), "feature", "bin")
    return cand.select("*", F.row_number().over(r).alias("_r")).where(F.col("_r") == 1).drop("_r")
