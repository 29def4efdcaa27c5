"""Duration quantiles and cap-and-recensor.

Quantiles are exact (linear interpolation) and distributed (see
``exact_quantiles``); the cap table has one row per transition, so it is
joined back with a broadcast whose size is the number of transitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsurv.functions.labels import signed_duration, signed_log_duration
from eventsurv.operators.prefix import running_sums
from eventsurv.sources.materialize import materialize

KEYS = ["index_event", "outcome_event"]


def value_counts(df: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """``(keys, _x, _n, _before)``: the distinct values of every group, how
    often each occurs and how many smaller ones there are.  Equal values meet
    map-side, so ties of any size are one row; distinct values are spread by
    range."""
    counts = (df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
              .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_sums(counts, list(keys), [F.col("_x")], ["_n"], exclusive=True, prefix="_before")
    return ranked.withColumnRenamed("_before_n", "_before")


def count_quantiles(counts: DataFrame, qs: list[float], keys=KEYS, cap: DataFrame | None = None) -> DataFrame:
    """``(keys, q, value)`` from :func:`value_counts`: exact linear-interpolated
    quantiles, the two order statistics around ``(n - 1) q`` picked by their
    counts.  With ``cap`` (``keys, cap``) the quantiles of the values clipped
    to [0, cap], without another count."""
    x = F.col("_x")
    if cap is not None:
        counts = counts.join(F.broadcast(cap), list(keys))
        x = F.least(F.greatest(x, F.lit(0.0)), F.col("cap"))
    pos = (F.col("_all") - 1) * F.col("q")
    targets = (counts.groupBy(*keys).agg(F.sum("_n").alias("_all")).select(*keys, "_all", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
               .select(*keys, "q", F.floor(pos).alias("_lo"), F.ceil(pos).alias("_hi"), (pos - F.floor(pos)).alias("_f")))
    # groups x quantiles rows
    j = counts.select(*keys, x.alias("_x"), "_before", (F.col("_before") + F.col("_n")).alias("_to")).join(F.broadcast(targets), list(keys))
    at = {c: (F.col("_before") <= F.col(c)) & (F.col(c) < F.col("_to")) for c in ("_lo", "_hi")}
    picked = j.where(at["_lo"] | at["_hi"]).groupBy(*keys, "q", "_f").agg(
        F.max(F.when(at["_lo"], F.col("_x"))).alias("_xlo"), F.max(F.when(at["_hi"], F.col("_x"))).alias("_xhi"))
    return picked.select(*keys, "q", (F.col("_xlo") + (F.col("_xhi") - F.col("_xlo")) * F.col("_f")).alias("value"))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], keys=KEYS) -> DataFrame:
    """``(keys, q, value)``: exact linear-interpolated quantiles per group.
    The built-in exact ``percentile`` keeps every distinct value of a group in
    one task when it merges; counting does not."""
    return count_quantiles(value_counts(df, value, keys), qs, keys)


def duration_cap(table: DataFrame, q: float) -> DataFrame:
    """``(keys, cap)``: the q-quantile of ``timeDiff`` per transition."""
    return exact_quantiles(table, "timeDiff", [q]).select(*KEYS, F.col("value").alias("cap"))


def cap_durations(table: DataFrame, q: float = 0.99, caps: DataFrame | None = None) -> DataFrame:
    """L4: ``timeDiff_capped = clip(t, 0, cap)``; events strictly beyond the
    cap become censored (``status_adjusted``)."""
    caps = duration_cap(table, q) if caps is None else caps
    j = table.join(F.broadcast(caps), KEYS, "inner")
    return j.select(
        "*",
        F.least(F.greatest(F.col("timeDiff"), F.lit(0.0)), F.col("cap")).alias("timeDiff_capped"),
        F.when((F.col("status") == 1) & (F.col("timeDiff") > F.col("cap")), F.lit(0))
         .otherwise(F.col("status")).cast("int").alias("status_adjusted"),
    )


def capped_labels(table: DataFrame, q: float = 0.99) -> DataFrame:
    """Signed and signed-log labels over the capped durations."""
    capped = cap_durations(table, q)
    return capped.select(
        "*",
        signed_duration(F.col("timeDiff_capped"), F.col("status_adjusted")).alias("label_signed_capped"),
        signed_log_duration(F.col("timeDiff_capped"), F.col("status_adjusted")).alias("label_signed_log_capped"),
    )


def cap_diagnostics(table: DataFrame, q: float = 0.98) -> DataFrame:
    """The cap, events turned into censored, and min/max/median of the
    durations before and after capping."""
    counts = materialize(value_counts(table, "timeDiff"), "duration-counts")      # one count serves all quantiles
    caps = count_quantiles(counts, [q]).select(*KEYS, F.col("value").alias("cap"))
    capped = cap_durations(table, q, caps)
    med = count_quantiles(counts, [0.5]).select(*KEYS, F.col("value").alias("median_t"))
    med_c = count_quantiles(counts, [0.5], cap=caps).select(*KEYS, F.col("value").alias("median_t_capped"))
    return capped.groupBy(*KEYS).agg(
        F.max("cap").alias("cap"),
        F.count_if((F.col("status") == 1) & (F.col("status_adjusted") == 0)).alias("n_recensored"),
        F.count_if(F.col("status") == 1).alias("n_events"),
        F.count_if(F.col("status") == 0).alias("n_censored_before"),
        F.count_if(F.col("status_adjusted") == 0).alias("n_censored_after"),
        F.min("timeDiff").alias("min_t"),
        F.max("timeDiff").alias("max_t"),
        F.max("timeDiff_capped").alias("max_t_capped"),
    ).join(med, KEYS, "inner").join(med_c, KEYS, "inner")
