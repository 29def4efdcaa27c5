"""Exact top-k search by inner product (operator 12).

Columnar branch and bound: every component becomes ``floor(256 * x)``.  Vectors
lie in blocks in vertical layout (one run of numbers per dimension).  A block
of queries meets a block of candidates; the inner products are accumulated a
few dimensions at a time, and after each step every pair has the bounds

    partial - |q_rest| * |c_rest|  <=  score  <=  partial + |q_rest| * |c_rest|

with the remaining mass of both sides (norms over the dimensions not yet read).
A query's threshold is the k-th best exact score its task has seen so far or,
if that is larger, the k-th best lower bound in the block.  Candidates whose
upper bound is below the threshold are compacted away; ties stay, so the result
is exact.  While many pairs live a step is one small matrix product; later only
the surviving (query, candidate) pairs are touched.

Layout on the cluster: candidates never move.  They are packed into blocks
inside their scan partitions; the query blocks are broadcast in rounds of at
most ``ROUND_BYTES``, so the broadcast does not grow with the table, only the
number of rounds does.  A task returns at most k rows a query for all its blocks.

Defined cases: vectors that are null or hold a null or non-finite component
take no part, nor do rows with a null id and vectors with a component outside
``(-2^24, 2^24)`` after scaling (their scores could leave 64 bits).  A shorter
vector counts as padded with zeros, an empty one scores 0.  Rows with the
query's id are its own and no candidates; equal rows of one query id are one
query, different vectors under one id are a query each.  Repeated candidate
rows count as often as they occur.  An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize
from llm.tables import arrow_batches

STEP = 8
QUERY_ROWS = 1024
BLOCK_ROWS = 8192
SUB_ROWS = 128
DENSE = 0.2
ROUND_BYTES = 32 << 20
LIMIT = 1 << 24
BLOCK = "block long, n int, dims int, ids binary, data binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, v array<int>`` of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double") * F.lit(256.0))
    outside = F.exists("x", lambda c: c.isNull() | (F.abs(c) >= F.lit(float(LIMIT))))  # NaN is above every number
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~outside)
            .select("vec_id", F.transform("x", lambda c: F.floor(c).cast("int")).alias("v")))


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``vec_id, v`` to vertical blocks, one per Arrow batch."""
    at = TaskContext.get().partitionId() << 24
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column("v")
        lengths = np.diff(lists.offsets.to_numpy().astype(np.int64))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        dims = int(lengths.max())
        data = np.zeros((len(ids), dims), np.int32)
        data[np.arange(dims) < lengths[:, None]] = flat
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([at], pa.int64()), "n": pa.array([len(ids)], pa.int32()), "dims": pa.array([dims], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([np.ascontiguousarray(data.T).tobytes()], pa.binary())})
        at += 1


class Best:
    """The k best (score, smaller id) so far of every query of one block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.kth = np.full(n, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids = np.concatenate([self.q, q]), np.concatenate([self.id, ids])
        score = np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        self.q, self.id, self.score, rank = q[keep], ids[keep], score[keep], rank[keep]
        full = rank == self.k - 1
        self.kth[self.q[full]] = self.score[full]


def rest_norms(data: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Row ``s``: norm of every column over the dimensions after step ``s``."""
    mass = np.stack([(data[a:b].astype(np.float64) ** 2).sum(axis=0) for a, b in steps])
    after = np.cumsum(mass[::-1], axis=0)[::-1] - mass
    return np.sqrt(np.maximum(after, 0.0))


def search(queries: np.ndarray, q_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Adds the candidates ``data`` (dims x n) to ``best`` of the queries (dims x m)."""
    dims = max(len(queries), len(data))
    if len(queries) < dims:
        queries = np.vstack([queries, np.zeros((dims - len(queries), queries.shape[1]), queries.dtype)])
    if len(data) < dims:
        data = np.vstack([data, np.zeros((dims - len(data), data.shape[1]), data.dtype)])
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(dims, 1)
    exact = np.float64 if top < 2.0 ** 52 else np.int64
    queries, data = queries.astype(exact), data.astype(exact)
    # dimensions of most mass first: the remaining mass then falls fastest
    order = np.argsort(-(data.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    queries, data = queries[order], data[order]
    steps = [(a, min(a + STEP, dims)) for a in range(0, dims, STEP)] or [(0, 0)]
    q_rest, c_rest = rest_norms(queries, steps), rest_norms(data, steps)
    for lo in range(0, queries.shape[1], SUB_ROWS):
        hi = min(lo + SUB_ROWS, queries.shape[1])
        _search_rows(queries[:, lo:hi], q_ids[lo:hi], lo, q_rest[:, lo:hi], data, ids, c_rest, steps, best)


def _search_rows(queries, q_ids, lo, q_rest, data, ids, c_rest, steps, best):
    m = queries.shape[1]
    kth = best.kth[lo:lo + m]
    cols = np.arange(data.shape[1])
    part = np.zeros((m, len(cols)), data.dtype)
    alive = q_ids[:, None] != ids[None, :]
    rows = None
    for s, (a, b) in enumerate(steps):
        if rows is None:
            part = part + queries[a:b].T @ data[a:b][:, cols]
            slack = q_rest[s][:, None] * c_rest[s][cols][None, :] * (1 + 1e-9) + 1e-6
            k = best.k
            if alive.shape[1] > k:
                low = np.where(alive, part - slack, -np.inf)
                kth = np.maximum(kth, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            alive &= part + slack >= kth[:, None]
            keep = alive.any(axis=0)
            if not keep.all():
                cols, part, alive = cols[keep], part[:, keep], alive[:, keep]
            if alive.size == 0:
                return
            if alive.mean() < DENSE:
                rows, pick = np.nonzero(alive)
                part, pick = part[rows, pick], cols[pick]
        else:
            for d in range(a, b):
                part = part + queries[d, rows] * data[d, pick]
            slack = q_rest[s, rows] * c_rest[s, pick] * (1 + 1e-9) + 1e-6
            keep = part + slack >= kth[rows]
            rows, pick, part = rows[keep], pick[keep], part[keep]
    if rows is None:
        rows, pick = np.nonzero(alive)
        part, pick = part[rows, pick], cols[pick]
    best.add(rows + lo, ids[pick], part)


def _best_of_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["q_block"] not in queries:
                    q_ids = np.frombuffer(r["q_ids"], np.int64)
                    q = np.frombuffer(r["q_data"], np.int32).reshape(r["q_dims"], r["q_n"])
                    queries[r["q_block"]] = (q, q_ids, Best(len(q_ids), k))
                q, q_ids, best = queries[r["q_block"]]
                search(q, q_ids, np.frombuffer(r["data"], np.int32).reshape(r["dims"], r["n"]), np.frombuffer(r["ids"], np.int64), best)
        for block, (_, q_ids, best) in queries.items():
            yield pa.RecordBatch.from_pydict({
                "query": pa.array((block << 12) + best.q, pa.int64()), "query_id": pa.array(q_ids[best.q], pa.int64()),
                "vec_id": pa.array(best.id, pa.int64()), "score": pa.array(best.score.astype(np.int64), pa.int64())})
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``vectors`` that
    meets ``is_query`` (a condition on ``vec_id``) the ``k`` rows of largest
    integer inner product, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = quantised(vectors)
    with arrow_batches(spark, BLOCK_ROWS, "8m"):
        blocks = materialize(rows.mapInArrow(pack_blocks, BLOCK), "topk-blocks")
    asked = materialize(rows.where(is_query).distinct(), "topk-queries")
    n, dims = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    with arrow_batches(spark, QUERY_ROWS, "8m"):
        # round robin, so that query blocks are of like size whatever the scan gave
        packed = asked.repartition(max(1, -(-n // QUERY_ROWS))).mapInArrow(pack_blocks, BLOCK)
        packed = materialize(packed, "topk-query-blocks")
    packed = packed.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "n", "dims", "ids", "data")])
    # blocks are numbered (partition << 24) + place; a round takes a fixed number of partitions
    a_round = max(1, ROUND_BYTES // (QUERY_ROWS * (4 * max(dims or 0, 1) + 8)))
    rounds = -(-max(1, -(-n // QUERY_ROWS)) // a_round)
    packed = packed.withColumn("round", F.floor(F.shiftright("q_block", 24) / F.lit(a_round)).cast("int"))
    schema = "query long, query_id long, vec_id long, score long"
    found = None
    with arrow_batches(spark, 8, "16m"):
        for i in range(rounds):
            q = F.broadcast(packed.where(F.col("round") == i))
            met = blocks.withColumn("round", F.lit(i)).join(q, "round").drop("round", "block")
            part = materialize(met.mapInArrow(_best_of_blocks(k), schema), "topk-found")
            found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
