"""Seeded splits and resampling (W3-W8), reproducible in SQL.

Randomness comes from an integer hash of ``row_id`` and a seed, so the same
rows are chosen on every run, on any number of partitions, and by the
DuckDB oracle.  NumPy's permutation cannot be reproduced by any engine, so
the reference's exact draws are not the target; the shares are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventsurv.operators.prefix import running_sums

KEYS = ["index_event", "outcome_event"]
HASH_DIGITS = 13  # hex digits: 52 bits, exact in a double


def unit_hash(x: Column, seed: int) -> Column:
    """A value in [0, 1) from an integer and a seed: 52 bits of the MD5 of
    both, so values for different integers are as good as independent and
    every one of up to 4.5e15 rows can be drawn."""
    text = F.concat(x.cast("string"), F.lit(f":{seed}"))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")
    return h / F.lit(float(16 ** HASH_DIGITS))


def unit_hash_sql(x: str, seed: int) -> str:
    """The same in DuckDB."""
    return f"(CAST('0x' || substr(md5(CAST({x} AS VARCHAR) || ':{seed}'), 1, {HASH_DIGITS}) AS BIGINT) / {float(16 ** HASH_DIGITS)!r})"


def seeded_split(df: DataFrame, holdout: float, seed: int, id_col: str = "row_id") -> DataFrame:
    """Adds ``part`` = 'fit' or 'holdout' (share ``holdout``)."""
    u = unit_hash(F.col(id_col), seed)
    return df.withColumn("part", F.when(u < F.lit(1.0 - holdout), F.lit("fit")).otherwise(F.lit("holdout")))


def oversample_exact(df: DataFrame, minority: Column, n_per_group: DataFrame, seed: int, keys=KEYS) -> DataFrame:
    """Exactly ``n`` draws with replacement from the minority rows of
    each group.  Draws are numbered 0..N-1 with ``range`` (distributed),
    assigned to groups by cumulative offsets (a table with one row per
    group), and matched to the minority's dense ordinal with an equi-join.

    ``n_per_group``: ``(keys, n)``."""
    spark = df.sparkSession
    mino = df.where(minority).withColumn("_one", F.lit(1))
    ordn = running_sums(mino, keys, [F.col("row_id")], ["_one"], exclusive=True, prefix="_ord")
    ordn = ordn.withColumn("_ord", F.col("_ord_one").cast("long")).drop("_ord_one", "_one")
    m = mino.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    sizes = n_per_group.join(m, keys, "inner").where((F.col("n") > 0) & (F.col("_m") > 0))
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # one row per group (transitions): bounded, collected to build the draw ranges
    rows = sizes.select(*keys, "n", "_m", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_off")).collect()
    total = sum(r["n"] for r in rows)
    if total == 0:
        return mino.drop("_one").limit(0)
    rows = sorted(rows, key=lambda r: r["_off"])
    groups = spark.createDataFrame([(i + 1, *[r[k] for k in keys], r["_off"], r["_m"]) for i, r in enumerate(rows)],
                                   ", ".join(["_g int"] + [f"{k} string" for k in keys] + ["_off long", "_m long"]))
    # a draw's group: how many groups begin at or before it
    starts = F.array(*[F.lit(r["_off"]).cast("long") for r in rows])
    draws = spark.range(total).select(F.col("id").alias("_k"))
    draws = draws.withColumn("_g", F.size(F.filter(starts, lambda s: s <= F.col("_k"))))
    assigned = draws.join(F.broadcast(groups), "_g")
    pick = F.floor(unit_hash(F.col("_k") - F.col("_off"), seed) * F.col("_m")).cast("long")
    assigned = assigned.select(*keys, (F.col("_k") - F.col("_off")).alias("draw"), pick.alias("_ord"))
    return assigned.join(ordn, [*keys, "_ord"], "inner").drop("_ord")
