"""Moments of many columns per transition in one pass.

Rows go to the tasks' NumPy as columns (Arrow), each batch is cut by its keys and
leaves per transition and column the count, mean, sum of squares, minimum and
maximum (and, with a label, the label's and the common ones over the rows where both
exist).  Spark merges the tasks' parts: transitions x columns numbers move,
not rows x columns.  Values are taken less the batch's minimum, so a constant
column has a variance of exactly 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 256
#: rows of one part: per column n, mean, M2, min, max, then mean and M2 of the label and the co-moment
PARTS = 8


def _part(x: np.ndarray, here: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    """Moments of the columns of ``x`` where ``here``."""
    out = np.zeros((PARTS, x.shape[1]))
    n = out[0] = here.sum(axis=0)
    some = np.maximum(n, 1)
    low, high = np.where(here, x, np.inf).min(axis=0), np.where(here, x, -np.inf).max(axis=0)
    shift = np.where(np.isfinite(low), low, 0.0)
    d = np.where(here, x - shift, 0.0)
    mean = d.sum(axis=0) / some
    d = np.where(here, d - mean, 0.0)
    out[1], out[2], out[3], out[4] = shift + mean, (d * d).sum(axis=0), low, high
    if y is not None:
        first = y[0] if np.isfinite(y[0]) else 0.0
        e = np.where(here, (y - first)[:, None], 0.0)
        mean = e.sum(axis=0) / some
        e = np.where(here, e - mean, 0.0)
        out[5], out[6], out[7] = first + mean, (e * e).sum(axis=0), (d * e).sum(axis=0)
    return out


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together (Chan's formula)."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy = (np.where(b[0] == 0, 0.0, np.where(a[0] == 0, b[i], b[i] - a[i])) for i in (1, 5))
    both = a[0] * share
    out = np.empty_like(a)
    out[0] = n
    out[1], out[5] = (np.where(a[0] == 0, b[i], a[i] + d * share) for i, d in ((1, dx), (5, dy)))
    out[2], out[6], out[7] = a[2] + b[2] + dx * dx * both, a[6] + b[6] + dy * dy * both, a[7] + b[7] + dx * dy * both
    out[3], out[4] = np.minimum(a[3], b[3]), np.maximum(a[4], b[4])
    return out


def _batch_parts(keys: int, width: int, label: bool, nan_is_null: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, names = np.zeros(batch.num_rows, np.int64), []
                for i in range(keys):
                    c = batch.column(i).dictionary_encode(null_encoding="encode")
                    names.append(c.dictionary.to_pylist())
                    codes = codes * len(names[-1]) + c.indices.to_numpy()
                numbers = [batch.column(keys + i) for i in range(width + label)]
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in numbers])
                here = np.column_stack([np.ones(len(c), bool) if not c.null_count else c.is_valid().to_numpy(zero_copy_only=False) for c in numbers])
                if nan_is_null:
                    here &= ~np.isnan(x)
                y = x[:, width] if label else None
                if label:
                    x, here = x[:, :width], here[:, :width] & here[:, width:]
                order = np.argsort(codes, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                    code, key = int(codes[rows[0]]), []
                    for n in reversed(names):
                        code, i = divmod(code, len(n))
                        key.insert(0, n[i])
                    part = _part(x[rows], here[rows], None if y is None else y[rows])
                    held[tuple(key)] = _merge(held[tuple(key)], part) if tuple(key) in held else part
        src = TaskContext.get().partitionId()
        if held:
            columns = [pa.array([k[i] for k in held], pa.string()) for i in range(keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([src] * len(held), pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary())],
                                             names=[*[f"k{i}" for i in range(keys)], "src", "sums"])
    return run


def _merge_parts(width: int):
    def run(table: pa.Table) -> pa.Table:
        total = None
        with np.errstate(invalid="ignore", over="ignore"):
            for b in table.column("sums"):
                part = np.frombuffer(b.as_py()).reshape(PARTS, width)
                total = part if total is None else _merge(total, part)
        first = table.slice(0, 1)
        return first.set_column(first.schema.get_field_index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))
    return run


def column_moments(df: DataFrame, cols: list[str], keys: list[str], label: Column | None = None, nan_is_null: bool = True) -> dict[tuple, np.ndarray]:
    """Per key tuple an array of ``PARTS`` rows and one column per name: n, mean, M2,
    min, max of the values that are not null, and with ``label`` (rows where both
    exist) mean and M2 of the label and the co-moment."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                     *([] if label is None else [label.cast("double").alias("y")]))
    ddl = ", ".join(f"{n} string" for n in names) + ", src int, sums binary"
    parts = rows.mapInArrow(_batch_parts(len(keys), len(cols), label is not None, nan_is_null), ddl)
    for step in (FAN_IN, 1):
        parts = parts.withColumn("src", F.col("src") % step).groupBy(*names, "src").applyInArrow(_merge_parts(len(cols)), ddl)
    return {tuple(r[n] for n in names): np.frombuffer(r["sums"]).reshape(PARTS, len(cols)) for r in parts.collect()}
