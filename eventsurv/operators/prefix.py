"""Ordered running sums and dense ranks without a single-task window (§4.3a).

A ``Window.partitionBy(group).orderBy(x)`` puts a whole group into one task;
a group that holds a third of the rows would stall the job.  Instead:

1. ``repartitionByRange(group..., order...)``: every Spark partition holds a
   contiguous slice of the global order (a big group spans many partitions);
2. the partition id is stored as a column and the table is written to the
   checkpoint folder, so a recomputation cannot move rows;
3. running sums inside each (partition, group);
4. totals per (partition, group) and their cumulative sum over earlier
   partitions of the same group.  Only groups cut by a partition boundary
   get a non-zero offset, so the offset table has fewer rows than there are
   partitions: it is broadcast with that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize

PID = "_pid"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, group: list[str], order: list[Column], values: list[str],
                 exclusive: bool = True, partitions: int | None = None, prefix: str = "run_") -> DataFrame:
    """Adds ``run_<v>``: the sum of ``v`` over rows of the same ``group``
    that come earlier in ``order`` (also the row itself when not
    ``exclusive``).  ``(group, order)`` must identify a row (ties would be
    summed in an arbitrary order)."""
    n = partitions or _partitions(df)
    d = df.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn(PID, F.spark_partition_id())
    d = materialize(d, "ranged")
    frame_end = -1 if exclusive else Window.currentRow
    w = Window.partitionBy(PID, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    local = d.select("*", *[F.sum(v).over(w).alias(f"_loc_{v}") for v in values])
    tot = d.groupBy(PID, *group).agg(*[F.sum(v).alias(f"_tot_{v}") for v in values])
    wo = Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    off = (tot.select(PID, *group, *[F.sum(f"_tot_{v}").over(wo).alias(f"_off_{v}") for v in values])
           .where(F.coalesce(*[F.col(f"_off_{v}").isNotNull() for v in values])))
    # at most one group per partition boundary has an offset: < partitions rows
    j = local.join(F.broadcast(off), [PID, *group], "left")
    out = [(F.coalesce(F.col(f"_loc_{v}"), F.lit(0)) + F.coalesce(F.col(f"_off_{v}"), F.lit(0))).alias(f"{prefix}{v}")
           for v in values]
    return j.select(*[c for c in df.columns], *out)


def row_numbers(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds ``name``: how many rows of the same ``group`` come earlier in
    ``order``.  Ranges are sorted where they arrive and written with the place of
    each row, so rows are shuffled once; what is added to the places has a row per
    group and range that holds it.  For few groups: that table is broadcast."""
    n = partitions or _partitions(df)
    by = [F.col(g) for g in group]
    # the id is the number of the range (from bit 33 on) and the place in it
    d = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    d = materialize(d, "ranged").withColumn(PID, F.shiftright("_at", 33))
    parts = d.groupBy(PID, *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select(F.col(PID).alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                        (F.col("_first") - F.coalesce(earlier, F.lit(0))).alias("_base"))
    on = F.col(PID) == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return d.join(F.broadcast(base), on).select(*df.columns, (F.col("_at") - F.col("_base")).alias(name))


def dense_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank",
               partitions: int | None = None) -> DataFrame:
    """Dense rank (1-based) of the distinct ``order`` values inside each
    group, as ``(group, order, rank)``; join it back on those columns."""
    distinct = df.select(*group, *order).distinct().withColumn("_one", F.lit(1))
    r = running_sums(distinct, group, [F.col(o) for o in order], ["_one"], exclusive=False,
                     partitions=partitions, prefix="_r")
    return r.select(*group, *order, F.col("_r_one").cast("long").alias(name))


def in_time_ranges(rows: DataFrame, times: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``rows`` (with ``grp`` and ``t``) in ranges of (group, time descending).  The ranges'
    bounds come from the ``grp`` and ``t`` of ``times`` (the same rows) alone: a sample
    taken by ``repartitionByRange`` would compute all columns once more."""
    spark = rows.sparkSession
    total, wanted = max(sum(sizes.values()), 1), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = {g: max(round(wanted * n / total), 1) for g, n in sizes.items()}
    most = max(parts.values(), default=1)
    cuts = {}
    if most > 1:
        asked = sorted({i / k for k in parts.values() for i in range(1, k)})
        for r in times.groupBy("grp").agg(F.percentile_approx("t", F.array(*map(F.lit, asked)), F.lit(max(10000, 10 * most))).alias("at")).collect():
            at = dict(zip(asked, r["at"]))
            k = parts[r["grp"]]
            cuts[r["grp"]] = sorted({at[i / k] for i in range(1, k)})
    place, table = 0, []
    for g in sorted(sizes):
        table.append((g, place, [float(c) for c in cuts.get(g, [])]))
        place += len(table[-1][2]) + 1
    # one row a group; a later time has fewer bounds above it and comes first
    bounds = spark.createDataFrame(table, "grp int, _first int, _cuts array<double>")
    j = rows.join(F.broadcast(bounds), "grp", "inner")
    return (j.withColumn("_part", (F.col("_first") + F.size(F.filter("_cuts", lambda c: c > F.col("t")))).cast("int"))
            .select(*rows.columns, "_part").repartitionById(max(place, 1), F.col("_part")).select(*rows.columns))
