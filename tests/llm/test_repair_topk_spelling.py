"""Conversation repair, exact top-k search and spelling variants against
brute force, with the defined edge cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import conversation_repair as cr
from llm import spelling, top_k

TURNS = "conv_id long, turn long, role string, text string, kind string, at long"


# -- operator 11 -------------------------------------------------------------
def plain_edits(terminals):
    """Least (cost, audit) by Dijkstra over (row, state), audits and all."""
    queue, seen = [(0, "", 0, cr.START)], set()
    while queue:
        cost, audit, i, p = heapq.heappop(queue)
        if (i, p) in seen:
            continue
        seen.add((i, p))
        if i == len(terminals) and p in cr.FINAL:
            return cost, audit
        for (a, initial), q in cr.MOVES.items():
            if a == p and initial in "ua":
                heapq.heappush(queue, (cost + 5, audit + "I", i, q))
        if i < len(terminals):
            t = terminals[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, p))
            for (a, initial), q in cr.MOVES.items():
                if a == p and t != "x":
                    late = 5 if t.isupper() else 0
                    if initial == t.lower():
                        heapq.heappush(queue, (cost + late, audit + "K", i + 1, q))
                    if initial in "ua":
                        heapq.heappush(queue, (cost + 1 + late, audit + "R", i + 1, q))


def test_cells_equal_all_edits():
    rng = random.Random(3)
    for n in range(0, 4):
        for t in itertools.product("suaoUAx", repeat=n):
            assert cr.cheapest(cr.span_cells("".join(t))) == plain_edits("".join(t))
    for _ in range(150):
        t = "".join(rng.choice("ssuuuuaaaaoSUAOxx") for _ in range(rng.randint(4, 60)))
        assert cr.cheapest(cr.span_cells(t)) == plain_edits(t)


def test_every_cut_of_a_span_gives_the_same_cells():
    rng = random.Random(4)
    for _ in range(10):
        t = "".join(rng.choice("suaoSUAx") for _ in range(9))
        chart = {}
        for size in range(1, len(t) + 1):                       # bottom-up by span length, all cuts
            for i in range(len(t) - size + 1):
                cells = [cr.join_cells(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)] or [cr.span_cells(t[i])]
                assert all(c == cells[0] for c in cells)
                chart[i, i + size] = cells[0]
        assert cr.span_cells(t) == chart[0, len(t)]


def plain_repair(rows):
    """The contract in plain Python, conversation by conversation."""
    convs = {}
    for conv_id, turn, role, text, *_ in rows:
        kept = convs.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        terminals, faults, seen = [], Counter(), set()
        for turn, role, text in kept:
            core = text.strip(" \t\n\x0b\x0c\r")
            f = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[f] += 1
            i = role[:1] if role[:1] in ("s", "u", "a") else "o"
            terminals.append("x" if f in ("blank", "duplicate") else i.upper() if f else i)
        cost, audit = plain_edits(terminals)
        lines, state, at = [], cr.START, 0
        for e in audit:
            if e == "D":
                at += 1
                continue
            i = "a" if state == cr.USER else "u"
            role = {"u": "user", "a": "assistant"}[i] if e != "K" else kept[at][1]
            lines.append(f"{role}:{kept[at][2] if e != 'I' else ''}")
            state = cr.MOVES[state, role[0]]
            at += e != "I"
        ts = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out[conv_id] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal,
                        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def turns(seed, convs, most):
    rng = random.Random(seed)
    said = ["yes.", "no!", "what?", "cut off", "cut off ", " \n", "", None, "é▁.", "long " * 50 + "."]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            text = rng.choice(said) if rng.random() < 0.3 else f"text {c} {t} {rng.random()}."
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else rng.choice([None, "", "system", "tool", "u"]) if rng.random() < 0.2 else ["user", "assistant"][t % 2]
            rows.append((c, t if rng.random() < 0.9 else None if rng.random() < 0.5 else t + 3, role, text, "k", t))
    return rows + [(None, 0, "user", "a.", "k", 0), (None, None, None, None, None, None)] + rows[:3]


def repaired(df):
    return {r["conv_id"]: tuple(r)[1:] for r in cr.repair(df).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("convs, most, held", [(60, 9, 1 << 24), (3, 120, 1 << 24), (12, 30, 200)])
def test_repair_equals_the_contract(spark, monkeypatch, convs, most, held):
    monkeypatch.setattr(cr, "HELD", held)
    rows = turns(convs, convs, most)
    assert repaired(spark.createDataFrame(rows, TURNS).repartition(5)) == plain_repair(rows)


def test_a_conversation_spread_over_partitions(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}" + "." * (t % 7 > 0), "k", 0) for t in range(400)] + [(0, 0, "user", "a.", "", 0)]
    assert repaired(spark.createDataFrame(rows, TURNS)) == plain_repair(rows)


def test_repair_of_empty_tables_and_dropped_conversations(spark):
    assert repaired(spark.createDataFrame([], TURNS)) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(gone, 0, "user", "hi.", "", 1)], TURNS)) == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# -- operator 12 -------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, score string, n int"


def plain_top_k(rows, every, k):
    ok = [(i, np.floor(256 * np.array(v, np.float64))) for i, v, *_ in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % every == 0:
            scores = []
            for c, w in ok:
                if c != q:
                    m = min(len(v), len(w))
                    scores.append((-int(v[:m] @ w[:m]), c))
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", block)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 1024 if block > 40 else 16)
    monkeypatch.setattr(top_k, "ROUND_BYTES", 32 << 20 if block > 40 else 3000)
    rng = np.random.default_rng(block)
    base = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in (base[i % 12] + rng.normal(size=24) * 0.1).astype(np.float32)], 1, "s", 2) for i in range(600)]
    rows += [(700 + i, rows[i % 5][1], 1, "s", 2) for i in range(40)]                      # ties
    rows += [(900, None, 1, "s", 2), (901, [1.0, None], 1, "s", 2), (902, [float("nan")] * 24, 1, "s", 2), (903, [float("inf")], 1, "s", 2),
             (910, [], 1, "s", 2), (920, [0.5, -0.5], None, None, None), (930, [3.0] * 30, 1, "s", 2), (None, [1.0] * 24, 1, "s", 2)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = {tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()}
    assert got == plain_top_k(rows, 10, 5)


def test_top_k_of_few_and_no_rows(spark):
    one = [(50, [1.0, 2.0], 0, "", 0), (51, [0.5, 0.25], 0, "", 0), (51, [0.5, 0.25], 0, "", 0)]
    got = sorted(tuple(r) for r in top_k.top_k(spark.createDataFrame(one, VECTORS), F.col("vec_id") % 50 == 0).collect())
    assert got == [(50, 1, 51, 256 * 128 + 512 * 64), (50, 2, 51, 256 * 128 + 512 * 64)]
    assert top_k.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_prune_candidates():
    rng = np.random.default_rng(0)
    data = np.floor(rng.normal(size=(64, 4000)) * np.linspace(3, 0.1, 64)[:, None] * 50).astype(np.int32)
    best = top_k.Best(4, 5)
    top_k.search(data[:, :4], np.arange(4), data, np.arange(4000), best)
    scores = data[:, :4].T.astype(np.int64) @ data
    for q in range(4):
        scores[q, q] = -1 << 60
        assert sorted(best.score[best.q == q]) == sorted(np.sort(scores[q])[-5:])


# -- operator 13 -------------------------------------------------------------
DOCS = "doc_id long, text string, word string, n string, key long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, plant):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if plant and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], count[w], None if form[w] is None else n[form[w]])
    return out


def word_docs(seed):
    rng = random.Random(seed)
    base = ["aaaaa", "éclairs", "Straße", "abcde", "letters", "aabbaa"]
    words = list(base)
    for _ in range(150):
        w = rng.choice(words)
        at = rng.randrange(len(w) + 1)
        words.append(rng.choice([w[:at] + rng.choice("abeéß") + w[at:], w[:at] + w[at + 1:], w[:at] + rng.choice("abcé") + w[at + 1:]]) or "a")
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(base) for _ in range(60)), "w", "n", 1) for i in range(60)]
    return rows + rows[:2] + [(None, "aaaaa LETTERS letters", None, None, None), (100, None, "", "", 0), (101, "", "", "", 0), (102, "×÷×÷× 12 _", "", "", 0)]


@pytest.mark.parametrize("plant, long", [(True, 1_000_000), (False, 100)])
def test_spelling_equals_brute_force(spark, monkeypatch, plant, long):
    monkeypatch.setattr(spelling, "LONG", long)
    monkeypatch.setattr(spelling, "HELD", 20 if long == 100 else 200_000)
    rows = word_docs(7)
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(spark.createDataFrame(rows, DOCS).repartition(4), plant=plant).collect()}
    want = plain_variants(rows, plant)
    assert got == want and any(v[0] is not None and v[1] != v[0] for v in want.values())


def test_spelling_of_an_empty_table(spark):
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).collect() == []
