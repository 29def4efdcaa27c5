"""NumPy kernels of the booster, run inside Spark tasks on blocks of rows.

A block holds up to some ten thousand rows of one (transition, part) in
descending order of time, columns side by side: ``t``, ``d`` (event flag),
``y`` (label of the squared loss), ``row_id``, ``bins`` (features x rows, one
byte each) and ``margin`` (runs x rows).  Nothing here knows how rows are
spread; sums over other blocks arrive as ``offsets`` from the driver, two
numbers a block.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

BINS = 32
#: cells of the logarithmic grid that bins are cut from: some 1.1 % wide
CELL = 92.0
ZERO_CELL = 1 << 17
#: gains are compared at 6 decimals, so that float noise does not decide between equal splits
GAIN_DIGITS = 6
MIN_GAIN = 1e-6


@dataclass
class Run:
    """One booster of one transition: a row of the run table."""

    run: int
    group: int
    slot: int                      # row of the block's margins
    name: str = ""
    objective: str = "cox"         # cox | l2
    rounds: int = 10
    max_depth: int = 6
    eta: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 1.0
    min_leaf: int = 1
    lam: float = 1.0
    alpha: float = 0.0
    gamma: float = 0.0
    seed: int = 0
    patience: int = 0              # 0: no early stopping
    base: float = 0.0
    features: tuple[int, ...] | None = None   # None: all


@dataclass
class Tree:
    """Nodes in heap order (root 1, children 2n and 2n + 1); a row goes right
    if its bin is above ``bin``.  ``feature`` is -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        size = 2 << depth
        return Tree(np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size))

    def nodes(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        n = bins.shape[1]
        node, at = np.ones(n, np.int64), np.arange(n)
        levels = int(len(self.feature)).bit_length() - 2 if depth is None else depth
        for _ in range(levels):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[np.where(inner, f, 0), at] > self.bin[node]
            node = np.where(inner, 2 * node + right, node)
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class State:
    """What a task needs beside its blocks: trees since the margins were last
    written and, per run, the sums over other blocks."""

    runs: dict[int, list[Run]]                                  # group -> runs still trained
    trees: dict[int, list[Tree]] = field(default_factory=dict)  # run -> trees not yet in the margins
    partial: dict[int, Tree] = field(default_factory=dict)      # run -> tree being grown
    weight_offsets: dict[tuple[int, int], tuple] = field(default_factory=dict)   # (run, part) -> places, values
    hazard_offsets: dict[tuple[int, int], tuple] = field(default_factory=dict)
    wanted: dict[int, list[int]] = field(default_factory=dict)  # run -> nodes whose histograms are summed
    round: int = 0


class Timed:
    """Rows in descending order of time and their ties."""

    def __init__(self, t: np.ndarray):
        self.t, self.n = t, len(t)
        change = np.flatnonzero(np.diff(t)) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [self.n]]) - 1
        tie = np.zeros(self.n, np.int64)
        tie[change] = 1
        tie = np.cumsum(tie)
        self.start, self.end = starts[tie], ends[tie]
        self.one_time = len(starts) == 1

    def head(self, x: np.ndarray):
        """Sum over the rows of the block's first time."""
        return x[..., :self.end[0] + 1].sum(axis=-1)

    def tail(self, x: np.ndarray):
        return x[..., self.start[-1]:].sum(axis=-1)

    def from_later(self, x: np.ndarray, before, more) -> np.ndarray:
        """Sum of ``x`` over all rows with the same or a later time: ``before``
        of earlier blocks, ``more`` of later blocks at this block's last time."""
        out = (np.cumsum(x, axis=-1)[..., self.end].T + before).T
        out[..., self.start[-1]:] += np.asarray(more)[..., None] if np.ndim(more) else more
        return out

    def up_to(self, x: np.ndarray, after: float, more: float) -> np.ndarray:
        """Sum of ``x`` over all rows with the same or an earlier time."""
        out = after + np.cumsum(x[::-1])[::-1][self.start]
        out[:self.end[0] + 1] += more
        return out


def at_place(offsets: tuple[np.ndarray, np.ndarray], place: int) -> np.ndarray:
    places, values = offsets
    return values[np.searchsorted(places, place)]


class Block(Timed):
    def __init__(self, row: dict, features: int):
        super().__init__(np.frombuffer(row["t"], np.float64))
        self.group, self.part, self.place = row["grp"], row["part"], row["place"]
        self.d = np.frombuffer(row["d"], np.int8)
        self.y = np.frombuffer(row["y"], np.float64)
        self.row_id = np.frombuffer(row["row_id"], np.int64)
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(features, self.n)
        self._margin = np.frombuffer(row["margin"], np.float64).reshape(-1, self.n)

    def margin(self, run: Run, state: State) -> np.ndarray:
        m = self._margin[run.slot]
        for tree in state.trees.get(run.run, []):
            m = m + tree.predict(self.bins)
        return m

    def risk(self, w: np.ndarray, run: Run, state: State) -> np.ndarray:
        """S0 of every row."""
        return self.from_later(w, *at_place(state.weight_offsets[run.run, self.part], self.place))

    def gradients(self, run: Run, state: State) -> tuple[np.ndarray, np.ndarray]:
        m = self.margin(run, state)
        if run.objective == "l2":
            return m - self.y, np.ones(self.n)
        w = np.exp(m)
        s0 = self.risk(w, run, state)
        off = at_place(state.hazard_offsets[run.run, self.part], self.place)
        a = self.up_to(self.d / s0, *off[:2])
        b = self.up_to(self.d / (s0 * s0), *off[2:])
        return w * a - self.d, w * a - w * w * b


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(ids: np.ndarray, share: float, seed: int, step: int) -> np.ndarray:
    """Hashed draw of a share of the rows: the same wherever a row lies."""
    if share >= 1.0:
        return np.ones(len(ids), bool)
    key = mix(np.array([(seed << 20) + step + 1], np.uint64))[0]
    return (mix(ids.astype(np.uint64) + key) >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


def column_draw(run: Run, features: int, step: int) -> np.ndarray:
    """Columns of one tree: the ``colsample`` share of the run's columns with the smallest hashes."""
    own = np.arange(features) if run.features is None else np.asarray(run.features, np.int64)
    out = np.zeros(features, bool)
    k = max(1, int(len(own) * run.colsample)) if len(own) else 0
    key = mix(np.array([(run.seed << 20) + step + 1], np.uint64))[0] ^ np.uint64(0x9E3779B97F4A7C15)
    out[own[np.argsort(mix(own.astype(np.uint64) + key), kind="stable")[:k]]] = True
    return out


def histogram(bins: np.ndarray, node: np.ndarray, wanted: list[int], g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of (g, h, 1) by (wanted node, feature, bin)."""
    index = np.full(int(max(node.max(initial=1), max(wanted))) + 1, -1, np.int64)
    index[wanted] = np.arange(len(wanted))
    at = index[node]
    rows = np.flatnonzero(at >= 0)
    out = np.zeros((len(wanted), len(bins), BINS, 3))
    if len(rows) == 0:
        return out
    base, g, h = at[rows] * BINS, g[rows], h[rows]
    size = len(wanted) * BINS
    for f in range(len(bins)):
        key = base + bins[f, rows]
        out[:, f, :, 0] = np.bincount(key, g, size).reshape(-1, BINS)
        out[:, f, :, 1] = np.bincount(key, h, size).reshape(-1, BINS)
        out[:, f, :, 2] = np.bincount(key, minlength=size).reshape(-1, BINS)
    return out


def threshold(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def split_score(g, h, run: Run):
    t = threshold(g, run.alpha)
    return t * t / (h + run.lam)


def best_split(hist: np.ndarray, run: Run, columns: np.ndarray) -> dict:
    """Best split of one node, children holding ``min_child_weight`` hessian
    and ``min_leaf`` rows; ties go to the first column, then the lowest bin."""
    total = hist[0].sum(axis=0)
    left = np.cumsum(hist[:, :-1], axis=1)
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (split_score(left[..., 0], left[..., 1], run) + split_score(right[..., 0], right[..., 1], run)
                - split_score(total[0], total[1], run))
    ok = ((left[..., 1] >= run.min_child_weight) & (right[..., 1] >= run.min_child_weight)
          & (left[..., 2] >= run.min_leaf) & (right[..., 2] >= run.min_leaf) & columns[:, None])
    gain = np.where(ok & np.isfinite(gain), np.round(gain, GAIN_DIGITS), -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[f, b])
    found = best > MIN_GAIN
    g, h, n = (float(x) for x in total)
    lg, lh, ln = (float(x) for x in left[f, b]) if found else (0.0, 0.0, 0.0)
    return {"feature": int(f) if found else -1, "bin": int(b), "gain": best if found else 0.0,
            "g": g, "h": h, "n": n, "lg": lg, "lh": lh, "ln": ln}


# -- all rounds of one run in one place ----------------------------------------
#: a node of the split ledger
NODE = np.dtype([("run", "i4"), ("round", "i4"), ("node", "i4"), ("feature", "i2"), ("bin", "i2"), ("gain", "f8"), ("n", "f8"), ("h", "f8"), ("value", "f8")])


def prune(nodes: dict[int, dict], gamma: float, node: int = 1) -> None:
    """Bottom-up: a split of two leaves whose gain is below ``gamma`` goes."""
    s = nodes[node]
    if s["feature"] < 0:
        return
    prune(nodes, gamma, 2 * node)
    prune(nodes, gamma, 2 * node + 1)
    if nodes[2 * node]["feature"] < 0 and nodes[2 * node + 1]["feature"] < 0 and s["gain"] < gamma:
        s["feature"] = -1
        del nodes[2 * node], nodes[2 * node + 1]


def finished(nodes: dict[int, dict], run: Run, step: int) -> tuple[Tree, list[tuple]]:
    """The pruned tree with its leaf values and its rows of the ledger."""
    tree, ledger = Tree.empty(run.max_depth), []
    if nodes:
        prune(nodes, run.gamma)
    for node, s in sorted(nodes.items()):
        value = float(-run.eta * threshold(np.float64(s["g"]), run.alpha) / (s["h"] + run.lam)) if s["feature"] < 0 and s["n"] > 0 else 0.0
        tree.feature[node], tree.bin[node], tree.value[node] = s["feature"], s["bin"], value
        ledger.append((run.run, step, node, int(s["feature"]), int(s["bin"]), float(s["gain"]), float(s["n"]), float(s["h"]), value))
    return tree, ledger


def best_splits(hists: np.ndarray, run: Run, columns: np.ndarray) -> list[dict]:
    """``best_split`` of many nodes (nodes x columns x bins x sums) among the columns at the places ``columns``."""
    total = hists[:, 0].sum(axis=1)
    left = np.cumsum(hists[:, columns, :-1], axis=2)
    right = total[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (split_score(left[..., 0], left[..., 1], run) + split_score(right[..., 0], right[..., 1], run)
                - split_score(total[:, 0], total[:, 1], run)[:, None, None])
    ok = (left[..., 1] >= run.min_child_weight) & (right[..., 1] >= run.min_child_weight)
    if hists.shape[-1] > 2:
        ok &= (left[..., 2] >= run.min_leaf) & (right[..., 2] >= run.min_leaf)
    gain = np.where(ok & np.isfinite(gain), np.round(gain, GAIN_DIGITS), -np.inf).reshape(len(hists), -1)
    at = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(hists), np.int64)
    out = []
    for i, k in enumerate(at):
        best = float(gain[i, k]) if gain.shape[1] else -np.inf
        found = best > MIN_GAIN
        f, b = divmod(int(k), BINS - 1)
        lg, lh = (float(x) for x in left[i, f, b, :2]) if found else (0.0, 0.0)
        out.append({"at": int(columns[f]) if found else -1, "bin": b, "gain": best if found else 0.0,
                    "g": float(total[i, 0]), "h": float(total[i, 1]), "lg": lg, "lh": lh})
    return out


#: nodes whose splits are searched at once
NODES = 32


def grow(run: Run, step: int, bins: np.ndarray, row_id: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[Tree, list[tuple]]:
    """One tree over all rows of a run: the steps of the trainer's jobs (histograms of the smaller children, the sibling is
    the parent minus it) without the rows that were not drawn and the columns that were not."""
    features, used = len(bins), np.flatnonzero(drawn(row_id, run.subsample, run.seed, step))
    drawn_columns = column_draw(run, features, step)
    kept = np.flatnonzero(drawn_columns | (np.arange(features) == 0))          # sums of all rows come from the first column
    columns = np.flatnonzero(drawn_columns[kept])
    x, g, h = bins[np.ix_(kept, used)], g[used], h[used]
    # rows of both sides need no count where each holds a positive hessian
    sums = 2 if run.min_leaf <= 1 and run.min_child_weight > 0 else 3

    def histograms(at: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """Of ``rows``, which lie in the nodes ``at`` (0 to ``count`` - 1)."""
        out, size = np.zeros((count, len(kept), BINS, sums)), count * BINS
        base, gr, hr, whole = at * BINS, g[rows], h[rows], len(rows) == len(used)
        for f in range(len(kept)):
            key = base + (x[f] if whole else x[f].take(rows))
            out[:, f, :, 0] = np.bincount(key, gr, size).reshape(-1, BINS)
            out[:, f, :, 1] = np.bincount(key, hr, size).reshape(-1, BINS)
            if sums > 2:
                out[:, f, :, 2] = np.bincount(key, minlength=size).reshape(-1, BINS)
        return out

    nodes: dict[int, dict] = {}
    node, flat = np.ones(len(used), np.int64), x.ravel()
    level = {1: histograms(np.zeros(len(used), np.int64), np.arange(len(used)), 1)[0]} if run.max_depth > 0 else {}
    n_of = {1: float(len(used))}
    for depth in range(run.max_depth):
        names, split = sorted(level), []
        for lo in range(0, len(names), NODES):
            some = names[lo:lo + NODES]
            for name, s in zip(some, best_splits(np.stack([level[k] for k in some]), run, columns)):
                at = s.pop("at")
                nodes[name] = {"feature": int(kept[at]) if at >= 0 else -1, "n": n_of[name], **s}
                if at >= 0:
                    split.append((name, at))
        if not split:
            break
        size = 2 << depth
        column, cut = np.full(size, -1, np.int64), np.zeros(size, np.uint8)
        for name, at in split:
            column[name], cut[name] = at, nodes[name]["bin"]
        f = column[node]
        rows = np.flatnonzero(f >= 0)
        old = node[rows]
        node[rows] = 2 * old + (flat.take(f[rows] * len(used) + rows) > cut[old])
        done = np.flatnonzero(f < 0)
        node[done] = 0
        counts = np.bincount(node, minlength=2 * size)
        wanted = []
        for name, _ in split:
            s = nodes[name]
            sides = ((s["lg"], s["lh"]), (s["g"] - s["lg"], s["h"] - s["lh"]))
            for k, (a, b) in enumerate(sides):
                n_of[2 * name + k] = float(counts[2 * name + k])
                nodes[2 * name + k] = {"feature": -1, "bin": 0, "gain": 0.0, "g": a, "h": b, "n": n_of[2 * name + k]}
            # a node below twice the least weight of a child can't be split
            if max(b for _, b in sides) >= 2 * run.min_child_weight * (1 - 1e-9):
                wanted.append(2 * name + (counts[2 * name + 1] < counts[2 * name]))
        if depth + 1 == run.max_depth or not wanted:
            break
        index = np.full(2 * size, -1, np.int64)
        index[wanted] = np.arange(len(wanted))
        at = index[node]
        rows = np.flatnonzero(at >= 0)
        found, below = histograms(at[rows], rows, len(wanted)), {}
        for i, name in enumerate(wanted):
            below[name], below[name ^ 1] = found[i], level[name // 2] - found[i]
        level = {k: v for k, v in below.items() if nodes[k]["h"] >= 2 * run.min_child_weight * (1 - 1e-9)}
    return finished(nodes, run, step)


def train_alone(run: Run, parts: dict[int, Block], train: int = 0, valid: int = 1) -> dict:
    """All rounds of one run over all rows of its transition; what the trainer's jobs do round by round."""
    run, nowhere = replace(run, slot=0), np.zeros(1, np.int64)
    state = State({}, weight_offsets={(run.run, p): (nowhere, np.zeros((1, 2))) for p in parts},
                  hazard_offsets={(run.run, p): (nowhere, np.zeros((1, 4))) for p in parts})
    margin = {p: np.array(b._margin[0]) for p, b in parts.items()}
    trace, ledger, trees, best, status, step = [], [], [], None, ("ok", ""), 0
    while True:
        now = {}
        for p, b in sorted(parts.items()):
            m = margin[p]
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                if run.objective == "l2":
                    loss = float(((b.y - m) ** 2).sum()) / b.n
                    now[p] = float(np.sqrt(loss)) if loss >= 0 else loss
                else:
                    w = np.exp(m)
                    s0 = b.risk(w, run, state)
                    events = float(b.d.sum())
                    now[p] = float((b.d * (np.log(s0) - m)).sum()) / events if events else 0.0
                    if p == train:
                        a, c = b.up_to(b.d / s0, 0.0, 0.0), b.up_to(b.d / (s0 * s0), 0.0, 0.0)
                        g, h = w * a - b.d, w * a - w * w * c
            trace.append((run.run, p, step, now[p]))
        watched = now.get(valid, now[train])
        if not (np.isfinite(watched) and np.isfinite(now[train])):
            status, trees = ("error", f"loss is not finite after round {step}"), []
            break
        if best is None or watched < best[0]:
            best = (watched, step)
        if step >= run.rounds or (run.patience and step - best[1] >= run.patience):
            break
        step += 1
        if run.objective == "l2":
            g, h = margin[train] - parts[train].y, np.ones(parts[train].n)
        tree, found = grow(run, step, parts[train].bins, parts[train].row_id, g, h)
        trees.append(tree)
        ledger.append(np.array(found, NODE))
        for p, b in parts.items():
            margin[p] += tree.predict(b.bins)
    return {"run": run.run, "trace": trace, "ledger": np.concatenate(ledger) if ledger else np.zeros(0, NODE), "trees": trees, "best": best, "status": status}


# -- binning -----------------------------------------------------------------
def cells(x: np.ndarray) -> np.ndarray:
    """Cell of a value on a signed logarithmic grid (monotone, scale-free)."""
    size = np.abs(x)
    with np.errstate(divide="ignore"):
        c = np.floor(np.log(np.where(size > 0, np.clip(size, 1e-300, 1e300), 1.0)) * CELL).astype(np.int64) + ZERO_CELL
    return np.where(size > 0, np.sign(x).astype(np.int64) * c, 0).astype(np.int32)


def to_bins(values: np.ndarray, means: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``rows x features`` raw values to ``features x rows`` bins; missing
    values take the training mean.  ``cuts``: upper cells and bin numbers."""
    x = np.where(np.isnan(values), means, values)
    c = cells(x)
    out = np.zeros((values.shape[1], values.shape[0]), np.uint8)
    for f, (upper, number) in enumerate(cuts):
        if len(upper) > 1:
            out[f] = number[np.minimum(np.searchsorted(upper, c[:, f]), len(upper) - 1)]
    return out
