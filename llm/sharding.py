"""Sharding by histogram sort (operator 4, native).

Rows are put in the order of a 53-bit key, the range in which Spark's
quantiles are exact (by default the hash of the text, so equal texts are
neighbours), with the place in the written table to break
ties.  Splitters for shards of near equal bytes are found by counting: each
round counts the exact bytes and rows below all probes in one aggregation
(one row per interval), and takes new probes from the quantiles of the
intervals that still hold a splitter further than the tolerance from its
target; where an interval holds one key only, the probes split it by place.
Then the rows are exchanged once, by the fine ranges between the probes, and
numbered inside each; exact row counts below each range turn that into the
slot.  So a key with a third of all rows is cut like any other, and no shard
is ever in one task.

Law: ``bytes`` - the shards' bytes differ from an equal share by at most the
tolerance (0.1 % of a share) or one row.

Defined cases: a null text has no bytes (size 1) and CRC 0; null ids and
repeated rows are placed like others; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize
from llm.tables import partitions

SHARDS = 8
TOLERANCE = 0.001
MAX_RANGES = 4096
ROUNDS = 40
_TOP = (1 << 63) - 1


def sized_rows(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, key, place``, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.shiftrightunsigned(F.xxhash64(text), 11) if key is None else key).alias("key")).withColumn("place", F.monotonically_increasing_id()), "shard-rows")


def interval(df: DataFrame, probes: list[tuple[int, int]], name: str) -> DataFrame:
    """Adds how many of the sorted ``probes`` are at or below (key, place):
    a binary search over two literal arrays, in generated code."""
    if not probes:
        return df.withColumn(name, F.lit(0))
    steps = len(probes).bit_length()
    pad = (1 << steps) - len(probes)
    keys = F.lit([p[0] for p in probes] + [_TOP] * pad)
    places = F.lit([p[1] for p in probes] + [_TOP] * pad)
    df = df.withColumn(name, F.lit(0))
    for s in reversed(range(steps)):
        at = F.col(name) + F.lit(1 << s)  # element_at counts from 1
        k, p = F.element_at(keys, at), F.element_at(places, at)
        df = df.withColumn(name, F.when((F.col("key") > k) | ((F.col("key") == k) & (F.col("place") >= p)), at).otherwise(F.col(name)))
    return df


def splitters(rows: DataFrame, targets: list[tuple[int, float]], start: int) -> tuple[list, list, list]:
    """Refines probes until each target (bytes below, tolerance) has one as
    near as that.  Returns the probes and the exact bytes and rows below."""
    probes: list[tuple[int, int]] = []
    want = None
    for _ in range(ROUNDS):
        n = start if want is None else 15
        counted = interval(rows, probes, "i")
        wide = F.col("i").isin(want) if want is not None else F.lit(True)
        got = counted.groupBy("i").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"),
            _q(wide, "key", n), _q(wide, "place", n)).collect()  # one row per interval: bounded by the probes
        got = {r["i"]: r for r in got}
        below, rows_below, b, c = [], [], 0, 0
        for i in range(len(probes)):
            b += got[i]["bytes"] if i in got else 0
            c += got[i]["rows"] if i in got else 0
            below.append(b)
            rows_below.append(c)
        open_ = set()
        for t, tolerance in targets:
            at = bisect.bisect_left(below, t)  # the interval that holds the target
            near = min((abs(t - x) for x in below[max(0, at - 1):at + 1]), default=None)
            if (near is None or near > tolerance) and at in got and got[at]["rows"] > 1:
                open_.add(at)
        if not open_:
            return probes, below, rows_below
        new = set()
        for i in (open_ if want is not None else got):
            r = got[i]
            if want is not None and r["qkey"] is None:
                continue
            if r["lo"] == r["hi"]:
                new |= {(r["lo"], p) for p in r["qplace"] or ()}
            else:
                for k in r["qkey"] or ():
                    new |= {(k, 0)} | ({(k + 1, 0)} if k < _TOP else set())
        fresh = sorted(new - set(probes))
        if want is not None and not open_ <= set(want):
            want = sorted(open_)  # count again, with the quantiles of these intervals
            continue
        if not fresh:
            return probes, below, rows_below
        probes = sorted(set(probes) | set(fresh))
        # the next count has the intervals anew; quantiles are taken where a target may lie
        want = _open_after(probes, fresh)
    raise RuntimeError("the splitters did not settle")


def _q(where: Column, column: str, n: int) -> Column:
    return F.percentile_approx(F.when(where, F.col(column)), [(i + 1) / (n + 1) for i in range(n)], 20 * n).alias("q" + column)


def _open_after(probes: list, fresh: list) -> list[int]:
    """Intervals next to the fresh probes."""
    out = set()
    for f in fresh:
        i = bisect.bisect_left(probes, f)
        out |= {i, i + 1}
    return sorted(out)


def shard(docs: DataFrame, shards: int = SHARDS, key: Column | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    rows = sized_rows(docs, key)
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = min(MAX_RANGES, max(shards, 4 * partitions(docs.sparkSession)))
    targets = [total * i // shards for i in range(1, shards)]
    # the shards' ends closely; the ends of the fine ranges so that a hot key is cut too
    goals = [(t, tolerance * total / shards) for t in targets] + [(total * i // ranges, total / ranges) for i in range(1, ranges)]
    probes, below, rows_below = splitters(rows, goals, ranges)
    cuts, first_row = [], []
    for t in targets:  # the probe nearest to each target
        i = min(range(len(below)), key=lambda i: abs(below[i] - t), default=None)
        if i is not None:
            cuts.append(probes[i])
            first_row.append(rows_below[i])
    # fine ranges: the probes nearest to equal parts, and the cuts
    fine = set(cuts)
    for i in range(1, ranges):
        at = bisect.bisect_left(below, total * i // ranges)
        if at < len(probes):
            fine.add(probes[at])
    fine_list = sorted(fine)
    at_probe = dict(zip(probes, rows_below, strict=True))
    shard_of, base = [], []
    for i in range(len(fine_list) + 1):
        s = sum(1 for c in cuts if i > 0 and c <= fine_list[i - 1])
        shard_of.append(s)
        base.append((at_probe[fine_list[i - 1]] if i else 0) - (first_row[s - 1] if s else 0))
    placed = interval(rows, fine_list, "range")
    n = F.row_number().over(Window.partitionBy("range").orderBy("key", "place"))
    index = F.col("range") + 1
    return placed.withColumn("_n", n).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.element_at(F.lit(shard_of), index).cast("int").alias("shard"),
        (F.element_at(F.lit(base), index) + F.col("_n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
