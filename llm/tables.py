"""Helpers shared by the operators: input tables, bit filters, dropping rows
and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize, settings

WHITE = r"[\x20\x09-\x0D]+"
BITS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Python workers get whole texts in batches of bounded rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str) -> Iterator[None]:
    """Arrow batches of bounded rows and bytes for the jobs run inside; the
    caller's settings come back afterwards."""
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}):
        yield


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hide_extra(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, list[str], list[Column]]:
    """``df`` with the columns that an operator doesn't read renamed to
    ``extra0, extra1, ...``, so that no name of theirs can clash with an inner
    one; their hidden names, and the columns that give all back in order."""
    hidden = {c: c if c in needed else f"extra{i}" for i, c in enumerate(df.columns)}
    return (df.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]), list(hidden.values()),
            [F.col(h).alias(c) for c, h in hidden.items()])


def text_slices(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters together (one row at least)."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > at and held + n > chars:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


# -- bit filters -------------------------------------------------------------
def _position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + F.lit(1)


def bit_table(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """A bitmap of the hashed ``key`` values: at most ``bits / 32768`` rows of
    4 KB whatever the number of keys, so it may be broadcast."""
    p = _position(F.col(key), bits)
    return keys.groupBy(F.bitmap_bucket_number(p).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("_bits"))


def bit_flag(df: DataFrame, key: Column, bitmap: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Adds boolean ``name``: false only if ``key`` is certainly not among the
    keys of the bitmap (a few others may pass).  No shuffle of ``df``."""
    p = _position(key, bits)
    at = F.bitmap_bit_position(p)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return (df.withColumns({"_b": F.bitmap_bucket_number(p), "_at": at})
            .join(F.broadcast(bitmap), F.col("_b") == F.col("_bucket"), "left")
            .withColumn(name, hit).drop("_b", "_at", "_bucket", "_bits"))


def bit_filter(df: DataFrame, key: Column, keys: DataFrame, key_name: str, bits: int = BITS) -> DataFrame:
    """Rows whose key may be among ``keys``: a prune before an exact join."""
    return bit_flag(df, key, bit_table(keys, key_name, bits), "_hit", bits).where("_hit").drop("_hit")


def key_bits(count: int, low: int = 23, high: int = 28) -> int:
    """Bits of a bitmap for ``count`` keys: about eight a key, 1 MB to 32 MB."""
    return 1 << min(high, max(low, (8 * max(count, 1) - 1).bit_length()))


def collected_bits(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """The bitmap of already mixed 64-bit ``key`` values on the driver (its
    size is ``bits / 8`` bytes whatever the number of keys), for ``has_bit``."""
    p = F.col(key).bitwiseAND(F.lit(bits - 1)) + F.lit(1)
    rows = keys.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits")).collect()
    held = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * len(r["bits"])
        held[at:at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return held


def has_bit(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are certainly not in the bitmap."""
    at = keys.astype(np.uint64) & np.uint64(8 * len(held) - 1)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def drop_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``df`` without the rows whose ``column`` is in ``ids`` (one column of
    the same name).  Only rows that a bit filter can't clear are shuffled."""
    ids = materialize(ids.select(F.col(column).alias("_id")).distinct(), "drop-ids")
    flagged = bit_flag(df, F.col(column), bit_table(ids, "_id"), "_maybe")
    sure = flagged.where(~F.col("_maybe")).drop("_maybe")
    doubt = flagged.where("_maybe").drop("_maybe").join(ids, F.col(column) == F.col("_id"), "left_anti")
    return sure.unionByName(doubt)


# -- connected components ----------------------------------------------------
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges`` (longs), component =
    the smallest node reachable.  Alternating large-star and small-star
    steps; every step is aggregations and joins on narrow rows written to the
    checkpoint folder.  The loop ends when the edges are stars apart from each
    other: no node has two smaller neighbours, none has a smaller and a larger
    one."""
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct(), "cc")
    while True:
        ends = (e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
                .unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = materialize(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "cc")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
