"""Exact duplicates by progressive refinement (operator 2, native).

Texts are equal when identical after replacing each run of white space
``[\\x20\\x09-\\x0D]+`` by one space.  Three levels, each over the survivors
of the one before:

1. length of the normalised text: one count per length;
2. (length, hash of the first ``PREFIX`` characters);
3. the SHA-256 of the whole normalised text, computed only for rows whose
   level-2 group has more than one row.

Levels 1 and 2 work on a narrow table (16 bytes a row) written once.  The
surviving level-2 groups become a bitmap of fixed size; with it the second
scan of the documents tells, without a shuffle, the rows that are certainly
alone.  Only the others are hashed in full and exchanged.  Groups are counted
with map-side aggregation, and the join that brings the result back to the
rows reads its group side from a written table, so Spark can split a hot group.

Defined cases: a null text counts as empty; empty texts are equal to each
other; ``keep_id`` is the smallest doc_id (nulls count only when a group has
no other; such a row stays); rows repeated under one doc_id share the flag,
and ``exact_dedup`` keeps one of them; an empty table gives an empty result;
further columns pass through whatever their names; where one has the name of
a result column, the result column stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize
from llm.tables import WHITE, bit_flag, bit_table, hide_extra

PREFIX = 128


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def full_hash(text: str = "text") -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _levels(docs: DataFrame) -> DataFrame:
    norm = normalised()
    return docs.withColumns({"_len": F.length(norm), "_pre": F.xxhash64(F.substring(norm, 1, PREFIX))})


def surviving_groups(docs: DataFrame) -> DataFrame:
    """``_len, _pre`` of the level-2 groups with more than one row."""
    narrow = materialize(_levels(docs).select("_len", "_pre"), "exact-narrow")
    lengths = materialize(narrow.groupBy("_len").count().where("count > 1").select("_len"), "exact-lengths")
    left = narrow.join(lengths, "_len", "left_semi")
    return materialize(left.groupBy("_len", "_pre").count().where("count > 1").select("_len", "_pre"), "exact-prefixes")


def duplicate_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(single, several)``: rows that have no copy, and the rows of groups;
    both with the columns of ``docs`` and ``keep_id, group_size, keep_rows``
    (rows of the group that bear ``keep_id``)."""
    key = F.struct("_len", "_pre")
    bitmap = bit_table(surviving_groups(docs).select(key.alias("_key")), "_key")
    flagged = bit_flag(_levels(docs), key, bitmap, "_survives")
    single = flagged.where(~F.col("_survives")).select(
        *docs.columns, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(1).cast("long").alias("keep_rows"))
    rows = flagged.where("_survives").withColumn("_full", full_hash()).drop("_len", "_pre", "_survives")
    per_id = rows.groupBy("_full", F.col("doc_id").alias("_id")).count()
    groups = materialize(per_id.groupBy("_full").agg(
        F.coalesce(F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "count"))),
                   F.min(F.struct("_id", "count"))).alias("_first"),
        F.sum("count").alias("group_size")), "exact-groups")
    several = rows.join(groups, "_full").select(
        *docs.columns, F.col("_first._id").alias("keep_id"), "group_size", F.col("_first.count").alias("keep_rows"))
    return single, several


def duplicate_flags(docs: DataFrame) -> DataFrame:
    """Every row with ``keep_id, group_size`` and ``kept``."""
    hidden, _, shown = hide_extra(docs, ("doc_id", "text"))
    single, several = duplicate_groups(hidden)
    own = ["keep_id", "group_size", "kept"]
    both = single.unionByName(several).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return both.select(*[c for c, name in zip(shown, docs.columns, strict=True) if name not in own], *own)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    docs, _, shown = hide_extra(docs, ("doc_id", "text"))
    single, several = duplicate_groups(docs)
    stays = several.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    once = stays.where("keep_rows = 1").select(*docs.columns)
    # identical ids and texts: one row of them, by aggregation (no group is gathered)
    repeated = (stays.where("keep_rows > 1").groupBy(F.col("doc_id").alias("_i"), normalised().alias("_n"))
                .agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*"))
    return single.select(*docs.columns).unionByName(once).unionByName(repeated).select(*shown)
