"""Conversation structure repair by weighted CYK interval parsing (operator 11).

A repaired conversation has role initials ``(s?(ua)+)?``.  Its rows are the
terminals; edits are Keep (0), Rerole to user or assistant (1), Delete (2,
required for blank and duplicate rows) and Insert of an empty user or assistant
turn anywhere (5); a truncated row that stays costs 5 more.

Grammar, in Chomsky normal form: the non-terminal ``(p, q)`` derives the spans
that lead the structure from state ``p`` to state ``q`` (start, after system,
after user, after assistant), with the rules ``(p, q) -> (p, r) (r, q)``,
``(p, q) -> edited row`` and, closed under insertion, ``(p, q) -> inserted
turns``.  A cell holds the least (cost, audit) of its non-terminal over a span;
cells are combined bottom-up by span length.  Because the non-terminals are
state pairs, every cut of a span has the same least cell (tests compare all
cuts), so a span needs one cut: lengths 1, 2, 4, ... in a stack of ready spans,
n joins of at most 24 cell pairs instead of n^3.  Audits of equal cost
over the same span are never prefixes of each other, so the least audit of a
span is built from the least audits of its parts.

Layout on the cluster: rows are range partitioned by (conversation, turn, role,
start of text), so a conversation of any size is spread over many tasks.  A
conversation inside one partition is parsed and repaired there in one pass.
Of the others (the first and the last of each partition, and those whose text
exceeds ``HELD`` code points) each partition returns the cells of its span;
the spans of a conversation are combined in order, and a second pass streams
their rows in order through the digest, which the contract makes sequential.
Duplicates are found by a map-side combined aggregate on digests; identical
rows of one turn lie next to each other.

Defined cases: nulls in conv_id (for the damage key), turn (key), role and text
become one space; a null conv_id is a conversation of its own; null turns come
first; rows of one turn are ordered by role, then text (bytes); other roles and
empty ones must be reroled or deleted.  A conversation without rows after the
damage gives zeros, an empty audit and the hash of the empty string; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize
from llm.tables import arrow_batches, bit_flag, bit_table

# --- fixed values: the states, the moves by role initial and the costs -----------
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
# ---------------------------------------------------------------------------------
MUST_GO = "x"
SHORT = 16
HELD = 1 << 24
PREFIX = 32

Cells = dict[tuple[int, int], tuple[int, str]]


def join_cells(left: Cells, right: Cells) -> Cells:
    """``(p, q) -> (p, r) (r, q)`` with the least (cost, audit)."""
    out: Cells = {}
    for (p, r), (c1, a1) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is None:
                continue
            cost, now = c1 + other[0], out.get((p, q))
            if now is None or cost < now[0] or cost == now[0] and a1 + other[1] < now[1]:
                out[p, q] = (cost, a1 + other[1])
    return out


def _inserted() -> Cells:
    """The empty span: shortest insertions from state to state."""
    cells: Cells = {(p, p): (0, "") for p in range(4)}
    one: Cells = {(p, q): (INSERT, "I") for (p, i), q in MOVES.items() if i in ROLES}
    while (more := join_cells(cells, {**one, **{(p, p): (0, "") for p in range(4)}})) != cells:
        cells = more
    return cells


EMPTY = _inserted()


def _row(terminal: str) -> Cells:
    cells: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if terminal != MUST_GO:
        more = TRUNCATED if terminal.isupper() else 0
        for (p, i), q in MOVES.items():
            options = [(more, "K")] if i == terminal.lower() else []
            if i in ROLES:
                options.append((REROLE + more, "R"))
            for o in options:
                cells[p, q] = min(o, cells.get((p, q), o))
    return join_cells(join_cells(EMPTY, cells), EMPTY)


@lru_cache(maxsize=200_000)
def _short_span(terminals: str) -> Cells:
    if len(terminals) == 1:
        return _row(terminals)
    cut = 1 << (len(terminals) - 1).bit_length() - 1
    return join_cells(_short_span(terminals[:cut]), _short_span(terminals[cut:]))


def span_cells(terminals: str) -> Cells:
    """The cells of a whole span, bottom-up by span length: ready spans wait
    on a stack until one of their own length follows."""
    return combine((len(t), _short_span(t)) for t in (terminals[i:i + SHORT] for i in range(0, len(terminals), SHORT)))


def combine(spans: Iterable[tuple[int, Cells]]) -> Cells:
    stack: list[tuple[int, Cells]] = []
    for size, cells in spans:
        stack.append((size, cells))
        while len(stack) > 1 and stack[-2][0] <= stack[-1][0]:
            (n, right), (m, left) = stack.pop(), stack.pop()
            stack.append((m + n, join_cells(left, right)))
    while len(stack) > 1:
        (n, right), (m, left) = stack.pop(), stack.pop()
        stack.append((m + n, join_cells(left, right)))
    return stack[0][1] if stack else EMPTY


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[START, q] for q in FINAL if (START, q) in cells)


class Replay:
    """Applies an audit row by row; ``feed`` gives the repaired lines that end
    with this row (inserted turns before it included), ``rest`` those after."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _target(self) -> str:
        return "a" if self.state == USER else "u"

    def rest(self) -> list[str]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            i = self._target()
            out.append(ROLES[i] + ":")
            self.state = MOVES[self.state, i]
            self.at += 1
        return out

    def feed(self, role: str, text: str) -> list[str]:
        out = self.rest()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            i = self._target() if edit == "R" else role[0]
            out.append(f"{ROLES[i] if edit == 'R' else role}:{text}")
            self.state = MOVES[self.state, i]
        return out


class Digest:
    """SHA-256 of lines joined by newlines, line by line."""

    def __init__(self):
        self.sha, self.n = hashlib.sha256(), 0

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.sha.update((("\n" if self.n else "") + line).encode("utf-8", "surrogatepass"))
            self.n += 1

    def hex(self) -> str:
        return self.sha.hexdigest()


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the damage that the contract
    fixes; dropped rows stay as ``gone`` without text."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def flag_rows(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: 1 blank, 2 duplicate of a row of an earlier turn, 3
    truncated, else 0 (copies inside one turn are seen when sorted)."""
    core = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    last = F.substring(core, -1, 1)
    fault = F.when(core == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = rows.withColumns({"fault": F.when(F.col("gone"), 0).otherwise(fault), "digest": digest, "at": F.xxhash64("conv_id", digest)})
    alone = (rows.where("not gone and fault <> 1").groupBy("conv_id", "digest", "at")
             .agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("n"), F.count("turn").alias("n_set")))
    # equal rows at more than one turn; a null turn is the earliest
    many = alone.where("(n_set > 0 and n_set < n) or first < last").select(
        F.col("conv_id").alias("c"), F.col("digest").alias("g"), "at", F.when(F.col("n_set") == F.col("n"), F.col("first")).alias("first"))
    many = materialize(many, "repair-repeats")
    rows = bit_flag(rows, F.col("at"), bit_table(many, "at"), "maybe")
    sure = rows.where(~F.col("maybe")).select("conv_id", "turn", "role", "text", "gone", "fault")
    doubt = (rows.where("maybe").drop("at").join(many.drop("at"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")), "left"))
    later = F.col("g").isNotNull() & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first")))
    doubt = doubt.select("conv_id", "turn", "role", "text", "gone",
                         F.when(later & ~F.col("gone") & (F.col("fault") != 1), 2).otherwise(F.col("fault")).alias("fault"))
    return sure.unionByName(doubt)


class Span:
    """Rows of one conversation in one task, in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.terminals: list[str] = []
        self.lines: list[tuple[str, str]] | None = []
        self.held = 0
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.before = None
        self.first = self.last = ""

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if fault != 1 and self.before == (turn, role, text):
            fault = 2
        self.before = (turn, role, text)
        initial = role[:1]
        if not self.terminals:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.faults[fault] += 1
        known = initial if initial in ("s", "u", "a") else "o"
        self.terminals.append(MUST_GO if fault in (1, 2) else known.upper() if fault == 3 else known)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.lines is not None:
            self.lines.append((role, text))
            self.held += len(text)
            if self.held > HELD:
                self.lines = None

    def row(self, whole: bool) -> dict:
        terminals = "".join(self.terminals)
        out = {"conv_id": self.conv_id, "place": TaskContext.get().partitionId(), "n": len(terminals), "whole": whole, "low": self.low,
               "high": self.high, "turns": self.turns, "blank": self.faults[1], "duplicate": self.faults[2], "truncated": self.faults[3],
               "illegal": self.illegal, "first": self.first, "last": self.last, "cost": None, "audit": None, "sha": None, "cells": None}
        cells = span_cells(terminals)
        if whole:
            out["cost"], out["audit"] = cheapest(cells)
            replay, digest = Replay(out["audit"]), Digest()
            for role, text in self.lines:
                digest.add(replay.feed(role, text))
            digest.add(replay.rest())
            out["sha"] = digest.hex()
        else:
            out["cells"] = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()]
        return out


SPAN = pa.schema([("conv_id", pa.int64()), ("place", pa.int32()), ("n", pa.int64()), ("whole", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()),
                  ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                  ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()),
                  ("cells", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
SPAN_DDL = ("conv_id long, place int, n long, whole boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
            "first string, last string, cost long, audit string, sha string, cells array<struct<p int, q int, cost long, audit string>>")


def _batch_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in names])


def parse_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row a conversation: repaired if the conversation
    lies inside the partition, else the cells of its span."""
    out: list[dict] = []
    now, is_first = None, True
    for conv_id, turn, role, text, gone, fault in _batch_rows(batches, ["conv_id", "turn", "role", "text", "gone", "fault"]):
        if now is None or conv_id != now.conv_id:
            if now is not None:
                out.append(now.row(not is_first and now.lines is not None))
                is_first = False
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, SPAN)
                    out = []
            now = Span(conv_id)
            if is_first:
                now.lines = None
        if not gone:
            now.add(turn, role, text, fault)
    if now is not None:
        out.append(now.row(False))
    if out:
        yield pa.RecordBatch.from_pylist(out, SPAN)


def _join_spans(key, pdf):
    """The spans of one conversation, in order, as one row without its digest."""
    import pandas as pd
    rows = pdf.sort_values("place").to_dict("records")
    total = {c: int(sum(r[c] for r in rows)) for c in ("turns", "blank", "duplicate", "truncated", "illegal")}
    low = high = None
    last = None
    for r in rows:
        if r["n"] == 0:
            continue
        if last is not None and last + r["first"] not in ("su", "ua", "au"):
            total["illegal"] += 1
        last = r["last"]
        if not pd.isna(r["low"]):
            if high is not None and int(r["low"]) == high:
                total["turns"] -= 1
            low, high = int(r["low"]) if low is None else low, int(r["high"])
    spans = ((int(r["n"]), {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in r["cells"]}) for r in rows if r["n"])
    cost, audit = cheapest(combine(spans))
    gaps = 0 if low is None else high - low + 1 - total["turns"]
    return pd.DataFrame([{"conv_id": key[0], "gaps": gaps, **{c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")},
                          "cost": cost, "audit": audit}]).astype({"conv_id": "Int64"})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its audit (kind 0), then its rows in order, to the hash."""
    ids, hashes = [], []
    now, replay, digest = None, None, None
    for conv_id, kind, role, text in _batch_rows(batches, ["conv_id", "kind", "role", "text"]):
        if kind == 0:
            if replay is not None:
                digest.add(replay.rest())
                ids.append(now)
                hashes.append(digest.hex())
            now, replay, digest = conv_id, Replay(text), Digest()
        else:
            digest.add(replay.feed(role, text))
    if replay is not None:
        digest.add(replay.rest())
        ids.append(now)
        hashes.append(digest.hex())
    if ids:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "sha": pa.array(hashes, pa.string())})


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation of ``turns`` after the damage."""
    spark = turns.sparkSession
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = flag_rows(damage(turns))
    order = ["conv_id", "turn", "role"]
    ranged = (rows.repartitionByRange(*order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text"))
    with arrow_batches(spark, 2000, "8m"):
        spans = materialize(ranged.mapInArrow(parse_spans, SPAN_DDL), "repair-spans")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    whole = spans.where("whole").select("conv_id", gaps.alias("gaps"), *numbers[1:], "audit", F.col("sha").alias("repaired_sha256"))
    cut = spans.where("not whole")
    joined = cut.groupBy("conv_id").applyInPandas(_join_spans, "conv_id long, " + ", ".join(f"{c} long" for c in numbers) + ", audit string")
    joined = materialize(joined, "repair-cut")
    audits = joined.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    again = (damage(turns).where("not gone").alias("a")
             .join(joined.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
             .select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))
    stream = audits.unionByName(again).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    with arrow_batches(spark, 2000, "8m"):
        hashes = materialize(stream.mapInArrow(_digests, "conv_id long, sha string"), "repair-digests")
    hashes = hashes.select(F.col("conv_id").alias("c"), "sha")
    done = joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", *numbers, "audit", F.col("sha").alias("repaired_sha256"))
    return whole.unionByName(done)
