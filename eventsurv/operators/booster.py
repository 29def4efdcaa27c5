"""Gradient boosting of survival models for all transitions at once.

A *run* is one booster of one transition with its own parameters; all runs of
all transitions grow together, so a job serves the parameter table of M12, the
members of an ensemble and a variant grid alike.

Data.  The labelled rows are binned (32 quantile bins a column, cut from counts
on a scale-free grid), range partitioned by (transition, part, time descending)
and written once as *blocks*: one row of the table holds some thousand binned
rows of one transition in time order, one byte a value.  Blocks never move.

A round of the Cox loss (label order of the risk sets = time order):

1. one job returns the weight sum of each block; the driver turns these into
   the sum over earlier blocks (two numbers a block);
2. one job returns each block's sums of d/S0 and d/S0^2 and the loss;
3. one job a level sums histograms (g, h, rows) by (run, node, column, bin) --
   only of the smaller child of each split; the sibling is the written parent
   histogram minus it -- and returns each node's best split.

Tied times may lie in several blocks; every block also reports the sums at its
first and last time, so risk sets are exact (Breslow).  Trees are applied to
the binned rows on the fly; every ``CHECKPOINT`` rounds the margins are written
with the blocks, which cuts the work and the lineage.

A run whose transition fits into a task (``TASK_BYTES`` of bins) gets all its
blocks in one task, which does the same steps for all rounds in one job: rounds
in jobs of their own would cost some seconds each however few the rows are.

What reaches the driver: split candidates (one per node), the block sums and
the trees.  Blocks grow with the table so that there are at most ``MAX_BLOCKS``.

Gains and ``gamma`` are in the scale of T(GL)^2/(HL+lambda) + T(GR)^2/(HR+lambda)
- T(G)^2/(H+lambda); a tree is grown on positive gains and then pruned from the
bottom where the gain is below ``gamma``.

Fit isolation (M17): a transition whose rows can't be used (missing or negative
durations, a status other than 0 and 1, no rows) or whose loss stops being
finite gets status ``error`` with a message; the others train on in the same
jobs, which never mix groups.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventsurv.operators import boost_kernels as K
from eventsurv.operators.boost_kernels import BINS, Block, Run, State, Tree
from eventsurv.operators.prefix import in_time_ranges
from eventsurv.sources.materialize import Scratch

KEYS = ["index_event", "outcome_event"]
TRAIN, VALID = 0, 1
CHECKPOINT = 16
BLOCK_ROWS = 1 << 16
MAX_BLOCKS = 1_000_000
FAN_IN = 256
#: a run is trained in one task if its transition has at most this many bytes of bins
TASK_BYTES = 1 << 26
#: most bytes of bins that such runs may copy to have a task each
COPIED_BYTES = 1 << 29
BUFFER = 1 << 15
BLOCKS = "grp int, part int, place long, n int, t binary, d binary, y binary, row_id binary, bins binary, margin binary"


def _to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


# ---------------------------------------------------------------------------
# preparation
# ---------------------------------------------------------------------------
@dataclass
class Binned:
    """Binned training rows and all that is needed to bin further rows."""

    scratch: Scratch
    blocks: DataFrame
    features: list[str]
    groups: list[tuple]                 # index -> transition
    errors: dict[int, str]              # group -> why it can't be trained
    means: np.ndarray                   # groups x features
    cuts: list                          # group -> feature -> (upper cells, bins)
    base: np.ndarray                    # groups: mean label of the training rows
    slots: int
    sizes: dict[int, int] = field(default_factory=dict)   # group -> rows


def _values(features: list[str]) -> Column:
    nan = F.lit(float("nan"))
    return F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in features])


def _with_group(df: DataFrame, groups: list[tuple], keys: list[str]) -> DataFrame:
    """Adds the transition's number: a join with a table of one row a transition."""
    table = df.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(groups)], "grp int, " + ", ".join(f"{k} string" for k in keys))
    return df.join(F.broadcast(table), keys, "inner")


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


#: the cell of a row that tells how many values a column has and their sum
WHOLE = -(1 << 31)


def _count_cells(width: int):
    """(group, feature, cell, rows, total) of the values that are there, combined in the task; cell ``WHOLE`` tells all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flush(g: int) -> pa.RecordBatch:
            x = np.concatenate(held.pop(g))
            here = ~np.isnan(x)
            c = K.cells(np.where(here, x, 0.0))
            parts = [np.unique(c[here[:, f], f], return_counts=True) for f in range(width)]
            sizes = [len(u) for u, _ in parts]
            every = np.arange(width, dtype=np.int32)
            with np.errstate(invalid="ignore", over="ignore"):
                total = np.where(here, x, 0.0).sum(axis=0)
            return pa.RecordBatch.from_pydict({
                "grp": pa.array(np.full(sum(sizes) + width, g, np.int32)),
                "feature": pa.array(np.concatenate([np.repeat(every, sizes), every])),
                "cell": pa.array(np.concatenate([*[u for u, _ in parts], np.full(width, WHOLE, np.int32)])),
                "rows": pa.array(np.concatenate([*[n for _, n in parts], here.sum(axis=0)]).astype(np.int64)),
                "total": pa.array(np.concatenate([np.zeros(sum(sizes)), total]))})

        for batch in batches:
            x, groups = _matrix(batch, "x", width), batch.column("grp").to_numpy()
            for g in np.unique(groups):
                held.setdefault(int(g), []).append(x[groups == g])
                if sum(map(len, held[int(g)])) >= BUFFER:
                    yield flush(int(g))
        for g in list(held):
            yield flush(g)
    return run


def _bytes(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A binary column of ``width`` bytes a row as a matrix."""
    col = batch.column(name)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset:col.offset + len(col) + 1]
    if not width or not len(col):
        return np.zeros((len(col), width), np.uint8)
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(len(col), width)


def _to_rows_of_bins(means: np.ndarray, cuts: list):
    """The values of a row as one byte a feature."""
    width = means.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, x = batch.column("grp").to_numpy(), _matrix(batch, "x", width)
            bins = np.zeros((len(groups), width), np.uint8)
            for g in np.unique(groups):
                at = np.flatnonzero(groups == g)
                bins[at] = K.to_bins(x[at], means[g], cuts[g]).T
            offsets = np.arange(len(groups) + 1, dtype=np.int32) * width
            packed = pa.Array.from_buffers(pa.binary(), len(groups), [None, pa.py_buffer(offsets), pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)
    return run


def _pack(width: int, block_rows: int, base: np.ndarray):
    """Sorted rows to blocks of one (transition, part)."""
    from pyspark import TaskContext
    names = ("t", "d", "y", "row_id", "x")
    schema = pa.schema([("grp", pa.int32()), ("part", pa.int32()), ("place", pa.int64()), ("n", pa.int32())]
                       + [(c, pa.binary()) for c in ("t", "d", "y", "row_id", "bins", "margin")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        now, held, size = None, [], 0

        def block() -> pa.RecordBatch:
            nonlocal place, held, size
            g, part = now
            col = {c: np.concatenate([h[c] for h in held]) for c in names}
            row = {"grp": g, "part": part, "place": place, "n": size, "t": col["t"].astype(np.float64).tobytes(),
                   "d": col["d"].astype(np.int8).tobytes(), "y": col["y"].astype(np.float64).tobytes(),
                   "row_id": col["row_id"].astype(np.int64).tobytes(), "bins": np.ascontiguousarray(col["x"].T).tobytes(),
                   "margin": np.repeat(base[g], size).tobytes()}
            place, held, size = place + 1, [], 0
            return _to_batch([row], schema)

        for batch in batches:
            groups, parts = batch.column("grp").to_numpy(), batch.column("part").to_numpy()
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names[:-1]} | {"x": _bytes(batch, "x", width)}
            edges = np.flatnonzero(np.diff(groups) | np.diff(parts)) + 1
            for lo, hi in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(groups)]])):
                key = (int(groups[lo]), int(parts[lo]))
                while lo < hi:
                    if size and (key != now or size >= block_rows):
                        yield block()
                    now = key
                    to = min(hi, lo + block_rows - size)
                    held.append({c: v[lo:to] for c, v in cols.items()})
                    size += to - lo
                    lo = to
        if size:
            yield block()
    return run


def prepare(df: DataFrame, features: list[str], label: Column | None = None, valid: Column | None = None, keys=KEYS,
            time: str = "timeDiff", event: str = "status", expected: list[tuple] | None = None, slots: int = 1,
            base: bool = False, scratch: Scratch | None = None) -> Binned:
    """Bins and blocks of the rows of ``df`` (``keys, row_id, time, event`` and
    the raw ``features``, nulls allowed).  ``label`` is the target of the
    squared loss (default: the time), ``valid`` marks held-out rows, ``slots``
    is the largest number of runs of one transition, ``expected`` lists
    transitions that must be there."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    features = sorted(features)
    valid = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False)
    label = F.col(time).cast("double") if label is None else label.cast("double")
    rows = df.select(*keys, "row_id", F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("d"),
                     label.alias("y"), valid.cast("int").alias("part"), *[F.col(c).cast("double").alias(c) for c in features])
    bad = F.col("t").isNull() | F.isnan("t") | (F.col("t") < 0) | F.col("d").isNull() | ~F.col("d").isin(0, 1) | F.col("row_id").isNull()
    train = F.col("part") == TRAIN
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(train, 1)).alias("n"), F.count(F.when(bad, 1)).alias("bad"),
        F.avg(F.when(train, F.col("y"))).alias("base")).collect()
    found = {tuple(r[k] for k in keys): r for r in stats}
    groups = sorted(set(found) | set(map(tuple, expected or [])))
    errors: dict[int, str] = {}
    means, bases = np.zeros((len(groups), len(features))), np.zeros(len(groups))
    for i, g in enumerate(groups):
        r = found.get(g)
        if r is None or r["n"] == 0:
            errors[i] = "no training rows"
        elif r["bad"]:
            errors[i] = f"{r['bad']} rows without a usable duration, status or row_id"
        else:
            bases[i] = (r["base"] or 0.0) if base else 0.0
    rows = _with_group(rows, groups, list(keys)).where(~F.col("grp").isin(list(errors) or [-1]))
    rows = rows.select("grp", "part", "t", "d", "y", F.col("row_id").cast("long").alias("row_id"), _values(features).alias("x"))
    with scratch.arrow(4096, "16m"):
        # one pass for means and cells: values that are missing are counted in the cell of the mean afterwards
        counted = scratch.write(rows.where(train).select("grp", "x").mapInArrow(_count_cells(len(features)), "grp int, feature int, cell int, rows long, total double")
                                .groupBy("grp", "feature", "cell").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")), "boost-cells")
        missing = []
        for r in counted.where(F.col("cell") == WHOLE).collect():         # transitions x columns rows
            g, f = r["grp"], r["feature"]
            means[g, f] = r["total"] / r["rows"] if r["rows"] else 0.0
            if found[groups[g]]["n"] > r["rows"]:
                missing.append((g, f, int(K.cells(means[g:g + 1, f])[0]), found[groups[g]]["n"] - r["rows"]))
        counts = (counted.where(F.col("cell") != WHOLE).select("grp", "feature", "cell", "rows")
                  .unionByName(spark.createDataFrame(missing, "grp int, feature int, cell int, rows long"))
                  .groupBy("grp", "feature", "cell").agg(F.sum("rows").alias("rows")))
        w = Window.partitionBy("grp", "feature").orderBy("cell")
        before = F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("rows").over(Window.partitionBy("grp", "feature"))
        number = F.floor(before * BINS / total).cast("int")
        tops = (counts.select("grp", "feature", "cell", number.alias("bin")).groupBy("grp", "feature", "bin")
                .agg(F.max("cell").alias("upper")).collect())          # transitions x columns x bins numbers
        scratch.drop(counted)
        cuts = [[(np.zeros(0, np.int32), np.zeros(0, np.uint8))] * len(features) for _ in groups]
        by: dict[tuple[int, int], list] = {}
        for r in tops:
            by.setdefault((r["grp"], r["feature"]), []).append((r["upper"], r["bin"]))
        for (g, f), v in by.items():
            v.sort()
            cuts[g][f] = (np.array([u for u, _ in v], np.int32), np.array([b for _, b in v], np.uint8))
        n = sum(r["n"] for r in stats)
        block_rows = max(min(BLOCK_ROWS, max(1024, n // (4 * spark.sparkContext.defaultParallelism))), -(-n // MAX_BLOCKS))
        sizes = {i: found[g]["rows"] for i, g in enumerate(groups) if g in found and i not in errors}
        binned = rows.mapInArrow(_to_rows_of_bins(means, cuts), "grp int, part int, t double, d int, y double, row_id long, x binary")
        ordered = in_time_ranges(binned, rows.select("grp", "t"), sizes).sortWithinPartitions("grp", "part", F.col("t").desc(), "row_id")
        blocks = scratch.write(ordered.mapInArrow(_pack(len(features), block_rows, np.repeat(bases[:, None], slots, axis=1)), BLOCKS), "boost-blocks")
    return Binned(scratch, blocks, features, groups, errors, means, cuts, bases, slots, sizes)


# ---------------------------------------------------------------------------
# jobs of a round
# ---------------------------------------------------------------------------
_SUMS = ("run int, part int, place long, head_t double, tail_t double, one boolean, "
         "v0 double, h0 double, l0 double, v1 double, h1 double, l1 double, loss double, events double")
_SUMS_SCHEMA = pa.schema([("run", pa.int32()), ("part", pa.int32()), ("place", pa.int64()), ("head_t", pa.float64()), ("tail_t", pa.float64()),
                          ("one", pa.bool_())] + [(c, pa.float64()) for c in ("v0", "h0", "l0", "v1", "h1", "l1", "loss", "events")])


def _block_sums(state: State, features: int, hazards: bool):
    """Per (run, block): weight sums or, given those of other blocks, sums of
    d/S0 and d/S0^2 and the loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out = []
            block = Block(row, features)
            for r in state.runs.get(block.group, []):
                m = block.margin(r, state)
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    w = np.exp(m) if r.objective == "cox" else m
                    x = [w, np.zeros(0)]
                    loss = events = 0.0
                    if r.objective == "l2":
                        loss, events, x = float(((block.y - m) ** 2).sum()), float(block.n), []
                    elif hazards:
                        s0 = block.risk(w, r, state)
                        x = [block.d / s0, block.d / (s0 * s0)]
                        loss, events = float((block.d * (np.log(s0) - m)).sum()), float(block.d.sum())
                    v = [(float(a.sum()), float(block.head(a)), float(block.tail(a))) if len(a) else (0.0, 0.0, 0.0) for a in x] + [(0.0, 0.0, 0.0)] * 2
                out.append({"run": r.run, "part": block.part, "place": block.place, "head_t": float(block.t[0]), "tail_t": float(block.t[-1]),
                            "one": block.one_time, "v0": v[0][0], "h0": v[0][1], "l0": v[0][2], "v1": v[1][0], "h1": v[1][1], "l1": v[1][2],
                            "loss": loss, "events": events})
            if out:
                yield _to_batch(out, _SUMS_SCHEMA)
    return run


def weights_before(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Per block the weight of earlier blocks (later times) and the weight that
    later blocks hold at its last time."""
    rows = sorted(rows, key=lambda r: r["place"])
    out = np.zeros((len(rows), 2))
    out[1:, 0] = np.cumsum([r["v0"] for r in rows])[:-1]
    for i in range(len(rows) - 2, -1, -1):
        nxt = rows[i + 1]
        if nxt["head_t"] == rows[i]["tail_t"]:
            out[i, 1] = nxt["h0"] + (out[i + 1, 1] if nxt["one"] else 0.0)
    return np.array([r["place"] for r in rows], np.int64), out


def hazards_after(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Per block the sums over later blocks (earlier times) and what earlier
    blocks hold at its first time, of d/S0 and of d/S0^2."""
    rows = sorted(rows, key=lambda r: r["place"])
    out = np.zeros((len(rows), 4))
    for j, (v, tail) in enumerate((("v0", "l0"), ("v1", "l1"))):
        x = np.array([r[v] for r in rows])
        out[:, 2 * j] = np.cumsum(x[::-1])[::-1] - x
        for i in range(1, len(rows)):
            prev = rows[i - 1]
            if prev["tail_t"] == rows[i]["head_t"]:
                out[i, 2 * j + 1] = prev[tail] + (out[i - 1, 2 * j + 1] if prev["one"] else 0.0)
    return np.array([r["place"] for r in rows], np.int64), out


_HIST = "run int, parent int, node int, src int, hist binary"
_HIST_SCHEMA = pa.schema([("run", pa.int32()), ("parent", pa.int32()), ("node", pa.int32()), ("src", pa.int32()), ("hist", pa.binary())])


def _histograms(state: State, features: int, depth: int):
    """Histograms of the wanted nodes, summed over the task's blocks of a transition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        src = TaskContext.get().partitionId()
        now, held = None, {}

        def flush() -> pa.RecordBatch:
            out = [{"run": r, "parent": n // 2, "node": n, "src": src, "hist": x[i].tobytes()}
                   for r, x in held.items() for i, n in enumerate(state.wanted[r])]
            held.clear()
            return _to_batch(out, _HIST_SCHEMA)

        for row in _rows(batches):
            if row["part"] != TRAIN or row["grp"] not in state.runs:
                continue
            if now is not None and row["grp"] != now and held:
                yield flush()
            now = row["grp"]
            block = Block(row, features)
            for r in state.runs[now]:
                if not state.wanted.get(r.run):
                    continue
                g, h = block.gradients(r, state)
                use = K.drawn(block.row_id, r.subsample, r.seed, state.round)
                node = state.partial[r.run].nodes(block.bins, depth)
                x = K.histogram(block.bins, np.where(use, node, 0), state.wanted[r.run], g, h)
                held[r.run] = held[r.run] + x if r.run in held else x
        if held:
            yield flush()
    return run


def _sum_hists(key, table):
    total = sum(np.frombuffer(b.as_py()) for b in table.column("hist"))
    return pa.Table.from_batches([_to_batch([{"run": key[0].as_py(), "parent": key[1].as_py(), "node": key[2].as_py(),
                                              "src": 0, "hist": total.tobytes()}], _HIST_SCHEMA)])


_SPLIT = "run int, node int, feature int, bin int, gain double, g double, h double, n double, lg double, lh double, ln double, hist binary"
_SPLIT_SCHEMA = pa.schema([("run", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32())]
                          + [(c, pa.float64()) for c in ("gain", "g", "h", "n", "lg", "lh", "ln")] + [("hist", pa.binary())])


def _splits(state: State, features: int):
    """(run, parent): children's histograms (summed, or parent minus sibling) and their best splits."""
    runs = {r.run: r for rs in state.runs.values() for r in rs}
    columns = {k: K.column_draw(r, features, state.round) for k, r in runs.items()}

    def run(key, table):
        run_id, parent = key[0].as_py(), key[1].as_py()
        hists: dict[int, np.ndarray] = {}
        above = None
        for node, src, raw in zip(*[table.column(c).to_pylist() for c in ("node", "src", "hist")]):
            x = np.frombuffer(raw)
            if src < 0:
                above = x
            else:
                hists[node] = hists[node] + x if node in hists else x
        if above is not None:
            (node, x), = hists.items()
            hists[node ^ 1] = above - x
        out = []
        for node, x in sorted(hists.items()):
            best = K.best_split(x.reshape(features, BINS, 3), runs[run_id], columns[run_id])
            out.append({"run": run_id, "node": node, **best, "hist": x.tobytes()})
        return pa.Table.from_batches([_to_batch(out, _SPLIT_SCHEMA)])
    return run


def _write_margins(state: State, features: int, all_runs: dict[int, list[Run]]):
    schema = pa.schema([("grp", pa.int32()), ("part", pa.int32()), ("place", pa.int64()), ("n", pa.int32())]
                       + [(c, pa.binary()) for c in ("t", "d", "y", "row_id", "bins", "margin")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row, features)
            m = np.array(block._margin)
            for r in all_runs.get(block.group, []):
                m[r.slot] = block.margin(r, state)
            yield _to_batch([{**row, "margin": m.tobytes()}], schema)
    return run


def _alone(dealt: list[list[Run]], base: np.ndarray, features: int):
    """A task gets all blocks of the transition of its runs and trains them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[dict]] = {}
        at = None
        for row in _rows(batches):
            at = row["_at"]
            blocks.setdefault(row["part"], []).append(row)
        if at is None:
            return
        group, parts = dealt[at][0].group, {}
        for part, rows in blocks.items():
            rows.sort(key=lambda b: b["place"])
            n = sum(b["n"] for b in rows)
            bins = np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(features, b["n"]) for b in rows], axis=1)
            whole = {"grp": group, "part": part, "place": 0, "n": n, "bins": bins, "margin": np.repeat(base[group], n)}
            whole |= {c: b"".join(b[c] for b in rows) for c in ("t", "d", "y", "row_id")}
            rows.clear()
            parts[part] = Block(whole, features)
        for r in dealt[at]:
            model = K.train_alone(r, parts, TRAIN, VALID)
            yield pa.RecordBatch.from_pydict({"run": pa.array([r.run], pa.int32()), "model": pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary())})
    return run


# ---------------------------------------------------------------------------
# the trainer
# ---------------------------------------------------------------------------
@dataclass
class Boosted:
    """A trained model table set (all of it model-sized)."""

    binned: Binned
    runs: list[Run]
    keys: list[str]
    trees: dict[int, list[Tree]]
    ledger: np.ndarray                  # K.NODE: run, round, node, feature, bin, gain, n, h, value of the node
    trace: list[tuple]                  # run, part, round, loss
    status: dict[int, tuple[str, str]]
    best_round: dict[int, int]

    @property
    def splits(self) -> list[tuple]:
        return self.ledger.tolist()

    def _names(self, run: int) -> tuple:
        r = self.runs[run]
        return (*self.binned.groups[r.group], r.name)

    def _table(self, spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
        head = ", ".join(f"{k} string" for k in self.keys) + ", run string, "
        return spark.createDataFrame([(*self._names(r[0]), *r[1:]) for r in rows], head + ddl)

    def trace_table(self, spark: SparkSession) -> DataFrame:
        """``(keys, run, part, round, loss)``; round 0 is the empty model."""
        rows = [(r, "train" if p == TRAIN else "valid", n, x) for r, p, n, x in self.trace]
        return self._table(spark, rows, "part string, round int, loss double")

    def split_table(self, spark: SparkSession) -> DataFrame:
        """The ledger: one row per node of every tree; ``feature`` null at leaves."""
        names, s = self.binned.features, self.ledger

        def by_run(values: list) -> pa.Array:
            return pa.DictionaryArray.from_arrays(pa.array(s["run"]), pa.array(values, pa.string())).cast(pa.string())
        heads = [self._names(r) for r in range(len(self.runs))]
        leaf = s["feature"] < 0
        feature = pa.DictionaryArray.from_arrays(pa.array(s["feature"], mask=leaf), pa.array(names, pa.string())).cast(pa.string())
        cols = {c: by_run([h[i] for h in heads]) for i, c in enumerate([*self.keys, "run"])}
        cols |= {"round": pa.array(s["round"]), "node": pa.array(s["node"]), "feature": feature, "bin": pa.array(s["bin"].astype(np.int32), mask=leaf),
                 "gain": pa.array(s["gain"], mask=leaf), "n_rows": pa.array(s["n"]), "cover": pa.array(s["h"]), "value": pa.array(s["value"])}
        ddl = ", ".join(f"{c} string" for c in [*self.keys, "run"]) + ", round int, node int, feature string, bin int, gain double, n_rows double, cover double, value double"
        return spark.createDataFrame(pa.table(cols), ddl)

    def importance(self, spark: SparkSession) -> DataFrame:
        """``(keys, run, feature, gain, n_splits)``, mean gain per split."""
        return (self.split_table(spark).where("feature is not null").groupBy(*self.keys, "run", "feature")
                .agg(F.avg("gain").alias("gain"), F.count(F.lit(1)).alias("n_splits")))

    def status_table(self, spark: SparkSession) -> DataFrame:
        """One row per run: ``ok`` or ``error`` and why, rounds, best round."""
        rows = [(r.run, *self.status[r.run], len(self.trees[r.run]), self.best_round[r.run]) for r in self.runs]
        return self._table(spark, rows, "status string, message string, rounds int, best_round int")

    def margins(self, df: DataFrame, carry: list[str] = ["row_id"]) -> DataFrame:
        """``keys, carry, run, margin`` of further rows for every run with status
        ``ok``: bins by the training cuts, then the trees; no join on rows."""
        b = self.binned
        spark = df.sparkSession
        ok = [r for r in self.runs if self.status[r.run][0] == "ok"]
        by_group: dict[int, list] = {}
        for r in ok:
            by_group.setdefault(r.group, []).append((r.run, b.base[r.group] if r.objective == "l2" else 0.0, self.trees[r.run]))
        model = spark.sparkContext.broadcast((b.means, b.cuts, by_group))
        width = len(b.features)
        rows = _with_group(df, b.groups, self.keys).select("grp", F.struct(*carry).alias("carry"), _values(b.features).alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            means, cuts, models = model.value
            for batch in batches:
                groups, x = batch.column("grp").to_numpy(), _matrix(batch, "x", width)
                for g in np.unique(groups):
                    at = np.flatnonzero(groups == g)
                    bins = K.to_bins(x[at], means[g], cuts[g])
                    kept = batch.column("carry").take(pa.array(at))
                    for run_id, base, trees in models.get(int(g), []):
                        m = np.full(len(at), base)
                        for t in trees:
                            m += t.predict(bins)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), kept,
                                                          pa.array(np.full(len(at), run_id, np.int32)), pa.array(m)], ["grp", "carry", "run_id", "margin"])

        schema = f"grp int, carry {rows.schema['carry'].dataType.simpleString()}, run_id int, margin double"
        out = rows.mapInArrow(run, schema)
        names = spark.createDataFrame([(r.run, *self._names(r.run)) for r in self.runs],
                                      "run_id int, " + ", ".join(f"{k} string" for k in self.keys) + ", run string")
        return out.join(F.broadcast(names), "run_id").select(*self.keys, "carry.*", "run", "margin")


class Trainer:
    """Rounds of all runs over one block table."""

    def __init__(self, binned: Binned, runs: list[Run], keys=KEYS):
        self.b, self.keys = binned, list(keys)
        slots: dict[int, int] = {}
        self.runs = []
        for i, r in enumerate(runs):
            slot = slots.get(r.group, 0)
            slots[r.group] = slot + 1
            self.runs.append(replace(r, run=i, slot=slot))
        if max(slots.values(), default=0) > binned.slots:
            raise ValueError(f"prepare(slots=) allows {binned.slots} runs a transition")
        self.blocks = binned.blocks
        self.tasks = self.blocks.rdd.getNumPartitions()
        self.width = len(binned.features)
        self.trees: dict[int, list[Tree]] = {r.run: [] for r in self.runs}
        self.done_trees: dict[int, int] = {r.run: 0 for r in self.runs}
        self.trace: list[tuple] = []
        self.ledger: list[np.ndarray] = []
        self.status = {r.run: ("error", binned.errors[r.group]) if r.group in binned.errors else ("ok", "") for r in self.runs}
        self.best: dict[int, tuple[float, int]] = {}
        self.active = [r for r in self.runs if self.status[r.run][0] == "ok" and r.rounds > 0]

    # -- pieces ------------------------------------------------------------
    def _state(self, step: int, runs: list[Run] | None = None) -> State:
        by: dict[int, list[Run]] = {}
        for r in self.active if runs is None else runs:
            by.setdefault(r.group, []).append(r)
        return State(by, {r.run: self.trees[r.run][self.done_trees[r.run]:] for rs in by.values() for r in rs}, round=step)

    def _sums(self, state: State, hazards: bool) -> dict[tuple[int, int], list]:
        rows = self.blocks.mapInArrow(_block_sums(state, self.width, hazards), _SUMS).collect()
        out: dict[tuple[int, int], list] = {}
        for r in rows:
            out.setdefault((r["run"], r["part"]), []).append(r)
        return out

    def _gradients(self, state: State, step: int) -> None:
        """Offsets of the risk sets in ``state``, losses of the present model in the trace."""
        sums = self._sums(state, False)
        cox = any(r.objective == "cox" for rs in state.runs.values() for r in rs)
        state.weight_offsets = {k: weights_before(v) for k, v in sums.items()}
        if cox:
            hazard = self._sums(state, True)
            state.hazard_offsets = {k: hazards_after(v) for k, v in hazard.items()}
            sums = {k: hazard.get(k, v) for k, v in sums.items()}
        objective = {r.run: r.objective for r in self.runs}
        for (run, part), rows in sorted(sums.items()):
            events = math.fsum(r["events"] for r in rows)
            loss = math.fsum(r["loss"] for r in rows) / events if events else 0.0
            self.trace.append((run, part, step, math.sqrt(loss) if objective[run] == "l2" and loss >= 0 else loss))

    def _stop(self, step: int) -> None:
        """Ends runs that have their rounds, lost their patience or their loss."""
        now = {(r, p): x for r, p, n, x in self.trace if n == step}
        alive = []
        for r in self.active:
            watched = now.get((r.run, VALID), now.get((r.run, TRAIN), float("nan")))
            if not math.isfinite(watched) or not math.isfinite(now.get((r.run, TRAIN), float("nan"))):
                self.status[r.run] = ("error", f"loss is not finite after round {step}")
                self.trees[r.run], self.done_trees[r.run] = [], 0
                continue
            if r.run not in self.best or watched < self.best[r.run][0]:
                self.best[r.run] = (watched, step)
            late = r.patience and step - self.best[r.run][1] >= r.patience
            if step < r.rounds and not late:
                alive.append(r)
        self.active = alive

    def _grow(self, state: State, step: int) -> None:
        """One tree for every active run, level by level in shared jobs."""
        scratch, runs = self.b.scratch, {r.run: r for r in self.active}
        state.partial = {k: Tree.empty(r.max_depth) for k, r in runs.items()}
        state.wanted = {k: [1] for k in runs}
        nodes: dict[int, dict[int, dict]] = {k: {} for k in runs}
        above, used = None, []
        for depth in range(max(r.max_depth for r in self.active)):
            parts = self.blocks.mapInArrow(_histograms(state, self.width, depth), _HIST)
            if self.tasks > FAN_IN:
                parts = parts.withColumn("src", F.col("src") % FAN_IN).groupBy("run", "parent", "node", "src").applyInArrow(_sum_hists, _HIST)
            if above is not None:
                parts = parts.unionByName(above.select("run", F.col("node").alias("parent"), "node", F.lit(-1).alias("src"), "hist"))
            found = scratch.write(parts.groupBy("run", "parent").applyInArrow(_splits(state, self.width), _SPLIT), "boost-level")
            used.append(found)
            rows = found.drop("hist").collect()                       # one row a node
            wanted: dict[int, list[int]] = {}
            for r in rows:
                run, node = r["run"], r["node"]
                s = r.asDict()
                nodes[run][node] = s
                if depth + 1 > runs[run].max_depth or s["feature"] < 0:
                    s["feature"] = -1
                    continue
                state.partial[run].feature[node], state.partial[run].bin[node] = s["feature"], s["bin"]
                sides = ((s["lg"], s["lh"], s["ln"]), (s["g"] - s["lg"], s["h"] - s["lh"], s["n"] - s["ln"]))
                for k, (g, h, n) in enumerate(sides):
                    nodes[run][2 * node + k] = {"feature": -1, "bin": 0, "gain": 0.0, "g": g, "h": h, "n": n}
                if depth + 1 < runs[run].max_depth:
                    wanted.setdefault(run, []).append(2 * node + (sides[1][2] < sides[0][2]))
            state.wanted = wanted
            if not wanted:
                break
            # the parents whose children are wanted: one (run, node) row each, model-sized
            split = self.b.blocks.sparkSession.createDataFrame([(k, n // 2) for k, ns in wanted.items() for n in ns], "run int, node int")
            above = found.select("run", "node", "hist").join(F.broadcast(split), ["run", "node"], "left_semi")
        scratch.drop(*used)
        for run, ns in nodes.items():
            tree, found = K.finished(ns, runs[run], step)
            self.ledger.append(np.array(found, K.NODE))
            self.trees[run].append(tree)

    def _checkpoint(self) -> None:
        by: dict[int, list[Run]] = {}
        for r in self.active:
            by.setdefault(r.group, []).append(r)
        state = self._state(0)
        old = self.blocks
        self.blocks = self.b.scratch.write(old.mapInArrow(_write_margins(state, self.width, by), BLOCKS), "boost-blocks")
        self.tasks = self.blocks.rdd.getNumPartitions()
        for r in self.active:
            self.done_trees[r.run] = len(self.trees[r.run])
        if old is not self.b.blocks:
            self.b.scratch.drop(old)

    def _fit_alone(self) -> None:
        """Runs whose transition fits into a task (``TASK_BYTES``): all rounds in one job, a task a run."""
        runs = [r for r in self.active if self.width and r.group in self.b.sizes and self.b.sizes[r.group] * self.width <= TASK_BYTES]
        if not runs:
            return
        self.active = [r for r in self.active if r not in runs]
        # a task a run while the copies of the blocks are few, else a task a transition; the longest first
        copies = sum(self.b.sizes[r.group] for r in runs) * self.width
        tasks: dict[int, list[Run]] = {}
        for r in runs:
            tasks.setdefault(r.run if copies <= COPIED_BYTES else r.group, []).append(r)
        dealt = sorted(tasks.values(), key=lambda rs: -sum(r.rounds * r.max_depth for r in rs) * self.b.sizes[rs[0].group])
        spark, scratch = self.blocks.sparkSession, self.b.scratch
        table = spark.createDataFrame([(rs[0].group, i) for i, rs in enumerate(dealt)], "grp int, _at int")
        mine = self.blocks.drop("margin").join(F.broadcast(table), "grp").repartitionById(len(dealt), F.col("_at"))
        models = scratch.write(mine.mapInArrow(_alone(dealt, self.b.base, self.width), "run int, model binary"), "boost-models")
        got = models.collect()
        scratch.drop(models)
        for r in got:
            m = pickle.loads(zlib.decompress(r["model"]))
            self.trees[m["run"]], self.status[m["run"]] = m["trees"], m["status"]
            self.trace += m["trace"]
            self.ledger.append(m["ledger"])
            if m["best"] is not None:
                self.best[m["run"]] = m["best"]

    def fit(self) -> Boosted:
        step = 0
        with self.b.scratch.arrow(4, "32m"):
            self._fit_alone()
            while self.active:
                state = self._state(step + 1)
                self._gradients(state, step)
                self._stop(step)
                if not self.active:
                    break
                state.runs = self._state(step + 1).runs
                step += 1
                self._grow(state, step)
                if step % CHECKPOINT == 0:
                    self._checkpoint()
        if self.blocks is not self.b.blocks:
            self.b.scratch.drop(self.blocks)
        best = {r.run: 0 for r in self.runs}
        for r in self.runs:
            if self.status[r.run][0] == "ok":
                best[r.run] = self.best[r.run][1] if r.patience and r.run in self.best else len(self.trees[r.run])
                if r.patience:
                    self.trees[r.run] = self.trees[r.run][:best[r.run]]
        kept = np.concatenate([np.zeros(0, K.NODE), *self.ledger])
        most = np.array([best[r.run] if self.status[r.run][0] == "ok" else -1 for r in self.runs], np.int64)
        kept = kept[kept["round"] <= most[kept["run"]]] if len(most) else kept
        kept = kept[np.lexsort((kept["node"], kept["run"], kept["round"]))]
        return Boosted(self.b, self.runs, self.keys, self.trees, kept, sorted(self.trace), self.status, best)


def train(binned: Binned, runs: list[Run], keys=KEYS) -> Boosted:
    """Trains every run on its transition; see the module's text."""
    return Trainer(binned, runs, keys).fit()


def runs_from_table(table: DataFrame, binned: Binned, name: str | None = None, keys=KEYS, **fixed) -> list[Run]:
    """Runs from a configuration table (P12, E4, M18: one row a run, at most a
    few per transition)."""
    number = {g: i for i, g in enumerate(binned.groups)}
    out = []
    for row in table.collect():
        r = row.asDict()
        key = tuple(r[k] for k in keys)
        if key not in number:
            continue
        # a member's name tells rounds and place too: one strategy may be used twice
        out.append(Run(run=len(out), group=number[key], slot=0, name=str(r[name]) if name else "", rounds=int(r["rounds"]),
                       max_depth=int(r["max_depth"]), eta=float(r["eta"]), subsample=float(r["subsample"]), colsample=float(r["colsample_bytree"]),
                       min_child_weight=float(r["min_child_weight"]), lam=float(r["lambda"]), alpha=float(r["alpha"]), gamma=float(r["gamma"]),
                       seed=int(r.get("seed") or 0)))
    return [replace(r, **fixed) for r in out]


def top_features(model: Boosted, spark: SparkSession, n: int) -> DataFrame:
    """``(keys, run, feature, gain, rank)``, the ``n`` columns of largest
    mean gain of every run (ties: the smaller name)."""
    w = Window.partitionBy(*model.keys, "run").orderBy(F.round("gain", K.GAIN_DIGITS).desc(), "feature")
    return model.importance(spark).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def two_stage(binned: Binned, runs: list[Run], n: int, second: dict | None = None, keys=KEYS) -> tuple[Boosted, DataFrame, Boosted]:
    """A first fit, the ``n`` best columns of every run by mean gain, a
    second fit of the same run on those only (over the same binned rows)."""
    spark = binned.blocks.sparkSession
    first = train(binned, runs, keys)
    top = top_features(first, spark, n)
    number = {f: i for i, f in enumerate(binned.features)}
    chosen: dict[tuple, list[int]] = {}
    for r in top.collect():                                           # at most n rows a run
        chosen.setdefault((*[r[k] for k in keys], r["run"]), []).append(number[r["feature"]])
    again = [replace(r, features=tuple(sorted(chosen.get((*binned.groups[r.group], r.name), []))), **(second or {})) for r in first.runs]
    return first, top, train(binned, again, keys)
