"""Repeated passages by compact windows (operator 7).

A text is the sequence of its 5-word shingle hashes; a passage of ``words``
(50) words is ``L`` = 46 shingles in a row.  For each of ``HASHES`` min-hash
functions the sub-sequences of a text are grouped into compact windows
``(left, centre, right)``: all sub-sequences that start at or after ``left``,
end at or before ``right`` and hold ``centre`` have their minimum there.  The
windows are the nodes of the Cartesian tree over the hash values that span at
least ``L`` shingles; only positions that are the minimum of some ``L`` in a
row can be such nodes, so a sliding minimum finds them and a stack over them
gives left and right: about ``2 n / L`` windows a function, not ``n^2 / 2``.

Windows of the same function and value share a signature.  Candidates, in
linear work each, never all pairs of a group:

1. Each group is joined with its first window (smallest doc_id, then
   position).  Joined windows are intervals aligned by their centres and must
   have ``L`` shingles in common room; a pair (document, source) that does so
   under ``NEEDED`` of the functions is a candidate.
2. Windows whose centre no confirmed passage covers are searched again.  Each
   run of ``L`` shingles in such a window of the first function is hashed, and
   every document that has the run is a candidate with the first document that
   has it: no exact repeat outside the passages found so far is missed, whatever
   earlier documents hold.
3. They are also joined by *pairs* of signatures: two functions whose windows
   have ``L`` shingles in common room, with the distance of their centres.  An
   earlier document that holds only a part of a passage shares a pair only if
   both centres lie in that part, so passages that are merely similar find each
   other behind it.

Windows are computed and written once; those whose signature no other document
has are dropped by a bitmap of fixed size.  The two whole texts confirm a candidate: spans are
stretches in which every ``L`` shingles in a row have a Jaccard similarity of
0.8 or more with shingles of the source.

Result: one row per repeated passage, ``doc_id, source_id, start_word,
end_word, start_byte, end_byte, similarity``: the words [start, end) of
``doc_id`` repeat words of ``source_id``, an earlier document.  The first
document that holds the passage has no row for it; repeats inside one
document alone are not searched.

Defined cases: null and empty texts and texts under 50 words have no windows;
rows with a null doc_id are left alone; rows repeated under one doc_id are
told apart only by their text, equal ones count as one text; empty tables
give empty results; further columns pass through ``remove_passages``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsurv.sources.materialize import Scratch, materialize
from llm.tables import arrow_batches, bit_filter, bit_flag, bit_table, collected_bits, has_bit, hide_extra, key_bits, small_batches, text_slices
from llm.words import constants, mix, powers, shingles, utf8, word_hashes

GRAM = 5
WORDS = 50
HASHES = 6
NEEDED = 3
THRESHOLD = 80
TOGETHER = 256
_U = np.uint64
SPANS = "doc_id long, source_id long, start_word int, end_word int, start_byte int, end_byte int, similarity double"


def sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum, maximum) of every ``width`` values in a row, by doubling."""
    m, span = x, 1
    while span * 2 <= width:
        m = best(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return best(m[:len(m) - rest], m[rest:]) if rest else m


def compact_windows(x: np.ndarray, width: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``left, centre, right`` (inclusive) of the Cartesian tree nodes over
    ``x`` that span at least ``width``; equal values share their left end.
    ``x`` may string texts together that stop before ``ends``, each with
    ``width`` values or more: every text has a tree of its own."""
    n = len(x)
    if n < width:
        z = np.zeros(0, np.int64)
        return z, z, z
    ends = np.array([n]) if ends is None else ends
    low = sliding(np.minimum, x, width).copy()
    low[(ends[:-1, None] - np.arange(1, width)).ravel()] = 0  # these reach into the next text
    edge = np.zeros(width - 1, dtype=low.dtype)
    # a centre is the minimum of a window over it: the greatest of their minima
    centre = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, low, edge]), width) == x)
    text = np.searchsorted(ends, centre, side="right")
    left, right = np.concatenate([[0], ends[:-1]])[text].tolist(), (ends[text] - 1).tolist()
    place, value, stack, now = centre.tolist(), x[centre].tolist(), [], -1
    alone = list(left)  # left end up to an equal value
    for i, (v, t) in enumerate(zip(value, text.tolist(), strict=True)):
        if t != now:
            stack, now = [], t
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[i] - 1
        if stack:
            above = stack[-1]
            alone[i] = place[above] + 1
            left[i] = left[above] if value[above] == v else alone[i]
        stack.append(i)
    right = np.array(right)
    first = right - np.array(alone) + 1 >= width  # others share all their sub-sequences with the equal value before
    return np.array(left)[first], centre[first], right[first]


def run_hashes(s: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` values in a row, in their order, by doubling."""
    mul = constants(1, 73)[0]
    h, span = s, 1
    while span * 2 <= width:
        h = mix(h[:-span] * mul + h[span:])
        span *= 2
    rest = width - span
    return mix(h[:len(h) - rest] * mul + h[rest:]) if rest else h


def content_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``s[start:end]``, in their order, by prefix sums."""
    p, inv = powers(len(s) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(s * p[:len(s)], dtype=_U)])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(_U))


def _text_windows(batches, words: int, functions: int = HASHES):
    """Per slice of texts and function: shingles, signatures, ids and windows."""
    width = words - GRAM + 1
    mul, flip = constants(HASHES, 71), constants(HASHES, 72)
    for pdf in batches:
        ids, texts = pdf["doc_id"].to_numpy(np.int64), pdf["text"].tolist()
        for a, b in text_slices(texts, 2_000_000):
            w = word_hashes(texts[a:b])
            long = np.flatnonzero(np.diff(w.bounds) >= words)
            if not len(long):
                continue
            begin, sizes = w.bounds[long], np.diff(w.bounds)[long] - GRAM + 1
            ends = np.cumsum(sizes)
            s = shingles(w.hashes, GRAM)[np.arange(ends[-1]) + np.repeat(begin - (ends - sizes), sizes)]
            for k in range(functions):
                x = (s ^ flip[k]) * mul[k]
                left, centre, right = compact_windows(x, width, ends)
                text = np.searchsorted(ends, centre, side="right")
                content = np.zeros(len(centre), _U)
                if k == 0:  # all runs of ``width`` shingles that hold the centre
                    content = content_hashes(s, np.maximum(left, centre - width + 1), np.minimum(right, centre + width - 1) + 1)
                yield k, s, mix(x[centre] + _U(k)), content, ids[a + long[text]], left, centre, right, (ends - sizes)[text]


def _windows(words: int):
    """All windows; ``content`` (first function only): the hash of the shingles
    in reach of the centre."""
    def run(batches):
        for k, _, key, content, ids, left, centre, right, base in _text_windows(batches, words):
            yield pd.DataFrame({"key": key.astype(np.int64), "doc_id": ids, "k": np.full(len(ids), k, np.int32),
                                "l": (left - base).astype(np.int32), "c": (centre - base).astype(np.int32), "r": (right - base).astype(np.int32),
                                "content": pd.arrays.IntegerArray(content.astype(np.int64), np.full(len(ids), k > 0))})
    return run


def _runs(words: int, held: np.ndarray):
    """``run, doc_id``: the hashes of all runs of ``width`` shingles that hold the
    centre of a window of the first function whose id is in the bitmap."""
    width = words - GRAM + 1

    def run(batches):
        for _, s, key, content, ids, left, centre, right, _ in _text_windows(batches, words, 1):
            at = np.flatnonzero(has_bit(held, key ^ content ^ ids.astype(_U)))
            if not len(at):
                continue
            runs = run_hashes(s, width).astype(np.int64)
            start = np.maximum(left[at], centre[at] - width + 1)
            n = np.minimum(centre[at], right[at] - width + 1) + 1 - start
            places = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pd.DataFrame({"run": runs[places], "doc_id": np.repeat(ids[at], n)})
    return run


def _signature_pairs(words: int):
    """Windows sorted by (doc_id, c) to ``pair, doc_id``: two functions whose
    windows share ``width`` shingles with both centres, and their distance, a third
    of ``width`` at least: pairs far apart rarely lie in the part of a passage that
    an earlier document holds.  A window is paired with the nearest such window
    of each other function.  Only windows within ``width`` places are carried
    from batch to batch."""
    width = words - GRAM + 1
    mul = constants(2, 74)

    def run(batches):
        names = ["key", "doc_id", "k", "l", "c", "r"]
        old = None
        for pdf in batches:
            v = {n: pdf[n].to_numpy(np.int64) for n in names}
            seen = 0
            if old is not None:
                seen = len(old["c"])
                v = {n: np.concatenate([old[n], v[n]]) for n in names}
            n, step = len(v["c"]), 1
            left, taken = np.arange(n), np.zeros((n, HASHES), bool)
            while True:
                left = left[left + step < n]
                # a row out of reach at one step is out of reach at all later ones
                left = left[(v["doc_id"][left] == v["doc_id"][left + step]) & (v["c"][left + step] - v["c"][left] < width)]
                if not len(left):
                    break
                i, j = left, left + step
                apart = v["c"][j] - v["c"][i] >= width // 3
                lo, hi = np.maximum(v["l"][i], v["l"][j]), np.minimum(v["r"][i], v["r"][j])
                ok = apart & (v["k"][i] != v["k"][j]) & (j >= seen) & (lo <= v["c"][i]) & (hi >= v["c"][j]) & (hi - lo + 1 >= width)
                i, j = i[ok], j[ok]
                first = ~taken[i, v["k"][j]]  # of every other function the nearest only
                i, j = i[first], j[first]
                if len(i):
                    taken[i, v["k"][j]] = True
                    off = (v["c"][j] - v["c"][i] + (1 << 20)).astype(_U)
                    pair = mix(v["key"][i].astype(_U) * mul[0] + mix(v["key"][j].astype(_U) * mul[1] + off))
                    yield pd.DataFrame({"pair": pair.astype(np.int64), "doc_id": v["doc_id"][i]})
                step += 1
            tail = (v["doc_id"] == v["doc_id"][-1]) & (v["c"] > v["c"][-1] - width) if n else np.zeros(0, bool)
            old = {name: x[tail] for name, x in v.items()}
    return run


def matching_spans(sx: np.ndarray, sy: np.ndarray, width: int) -> list[tuple[int, int, float]]:
    """Stretches ``[p, q)`` of the shingles ``sx`` in which every ``width`` in
    a row have Jaccard similarity of 0.8 or more with shingles of ``sy`` (for
    two sets of one size that is a share of 2 * 0.8 / 1.8 in common), trimmed
    to common shingles at both ends, with the share in common."""
    if len(sx) < width:
        return []
    common = np.isin(sx, sy)
    total = np.concatenate([[0], np.cumsum(common)])
    good = (total[width:] - total[:-width]) * (100 + THRESHOLD) >= 2 * THRESHOLD * width
    mark = np.zeros(len(sx) + 1, dtype=np.int64)
    at = np.flatnonzero(good)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + width, -1)
    inside = np.cumsum(mark)[:-1] > 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    out = []
    for p, q in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        hit = np.flatnonzero(common[p:q])
        p, q = int(p + hit[0]), int(p + hit[-1]) + 1
        out.append((p, q, float(total[q] - total[p]) / (q - p)))
    return out


def _confirm(words: int):
    """Rows (doc_id, source_id, text, source_text): spans."""
    width = words - GRAM + 1

    def run(batches):
        names = ["doc_id", "source_id", "start_word", "end_word", "start_byte", "end_byte", "similarity"]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                w = word_hashes([r.text, r.source_text])
                sx, sy = (shingles(w.hashes[w.bounds[i]:w.bounds[i + 1]], GRAM) for i in (0, 1))
                for p, q, share in matching_spans(sx, sy, width):
                    e = q + GRAM - 1
                    if e - p >= words:
                        rows.append((r.doc_id, r.source_id, p, e, int(w.start[p]), int(w.end[e - 1]), share))
            yield pd.DataFrame(rows, columns=names)
    return run


def _checked(pairs: DataFrame, base: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """The spans of candidate pairs ``doc_id, source_id``, by their whole texts."""
    need = scratch.write(pairs.select(F.col("doc_id").alias("id")).unionByName(pairs.select(F.col("source_id").alias("id"))).distinct(), "passage-ids")
    # a source's pairs are dealt into parts, of about ``TOGETHER`` documents where it has more
    many = pairs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER)   # a row for so many pairs
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce(F.ceil(F.col("n") / TOGETHER), F.lit(1))).alias("part")
    dealt = scratch.write(pairs.join(F.broadcast(many), "source_id", "left").select("doc_id", "source_id", part), "passage-dealt")
    # texts are dealt by id once, for the join with either id
    texts = bit_filter(base.withColumnRenamed("doc_id", "_id"), F.col("_id"), need, "id", 1 << 25).repartition("_id").distinct()
    of_doc = dealt.join(texts, F.col("doc_id") == F.col("_id")).drop("_id")
    of_source = dealt.select("source_id", "part").distinct().join(texts.withColumnsRenamed({"_id": "_sid", "text": "source_text"}), F.col("source_id") == F.col("_sid"))
    both = of_doc.join(of_source, ["source_id", "part"])
    found = materialize(both.select("doc_id", "source_id", "text", "source_text").mapInPandas(_confirm(words), SPANS), "passage-found")
    scratch.drop(need, dealt)
    return found


def _exact_pairs(open_: DataFrame, base: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """Every document that has a run in an open window, with the first document that has it."""
    # windows with equal content are a class: its first document holds all their runs, and
    # only that one's runs are compared, where other classes have the signature too
    ones = open_.where("k = 0").select("key", "content", "doc_id")
    classes = scratch.write(ones.groupBy("key", "content").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last")), "passage-classes")
    copied = classes.where("source_id < last").select("key", "content", "source_id")
    exact = ones.join(copied, ["key", "content"]).where("doc_id <> source_id").select("doc_id", "source_id")
    mixed = classes.groupBy("key").agg(F.min("content").alias("_a"), F.max("content").alias("_b")).where("_a < _b").select("key")
    firsts = scratch.write(classes.join(mixed, "key").select(F.col("key").bitwiseXOR(F.col("content")).bitwiseXOR(F.col("source_id")).alias("id"),
                                                           F.col("source_id").alias("doc")), "passage-firsts")
    held = collected_bits(firsts, "id", key_bits(firsts.count()))
    runs = scratch.write(bit_filter(base, F.col("doc_id"), firsts, "doc", 1 << 25).mapInPandas(_runs(words, held), "run long, doc_id long"), "passage-runs")
    holders = scratch.write(runs.groupBy("run").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last"))
                          .where("source_id < last").select("run", "source_id"), "passage-holders")
    return exact.unionByName(bit_filter(runs, F.col("run"), holders, "run", 1 << 25).join(holders, "run")
                             .where("doc_id <> source_id").select("doc_id", "source_id"))


def _unexplained(shared: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Windows with their centre outside the passages found so far, of
    signatures that such windows of two documents share."""
    spans = found.select(F.col("doc_id").alias("_id"), "start_word", "end_word").distinct()
    flagged = bit_flag(shared, F.col("doc_id"), bit_table(spans, "_id", 1 << 25), "_maybe", 1 << 25)
    doubt = flagged.where("_maybe").drop("_maybe").join(
        spans, (F.col("doc_id") == F.col("_id")) & (F.col("c") >= F.col("start_word")) & (F.col("c") + GRAM <= F.col("end_word")), "left_anti")
    left = scratch.write(flagged.where(~F.col("_maybe")).drop("_maybe").unionByName(doubt), "passage-open", "zstd")
    # a source's own windows are open too: they stay where a document still has the signature
    alive = left.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    open_ = scratch.write(left.join(alive, "key", "left_semi"), "passage-alive", "zstd")
    scratch.drop(left)
    return open_


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The repeated passages of at least ``words`` words (module docstring)."""
    spark = docs.sparkSession
    small_batches(spark)
    width = words - GRAM + 1
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    scratch = Scratch(spark)
    windows = scratch.write(base.mapInPandas(_windows(words), "key long, doc_id long, k int, l int, c int, r int, content long"), "passage-windows", "zstd")
    # one half of the keys after the other: their shuffles are as large as the windows themselves
    halves = [scratch.write(windows.where(half).groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key"),
                            "passage-keys") for half in ("key < 0", "key >= 0")]
    shared = scratch.write(bit_filter(windows, F.col("key"), halves[0].unionByName(halves[1]), "key", 1 << 25), "passage-shared", "zstd")
    scratch.drop(windows, *halves)
    first = F.min(F.struct("doc_id", "c", "l", "r")).alias("f")
    groups = (shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"), first).where("last > f.doc_id")
              .select("key", "n", F.col("f.doc_id").alias("source_id"), F.col("f.c").alias("fc"), F.col("f.l").alias("fl"), F.col("f.r").alias("fr")))
    groups = scratch.write(groups, "passage-groups", "zstd")
    hits = shared.drop("content").join(groups.drop("n"), "key")
    off = F.col("c") - F.col("fc")
    lo = F.greatest("l", F.col("fl") + off, F.col("c") - (width - 1))
    hi = F.least("c", F.least("r", F.col("fr") + off) - (width - 1))
    near = (hits.withColumns({"off": off, "lo": lo, "hi": hi}).where("lo <= hi and doc_id <> source_id")
            .groupBy("doc_id", "source_id").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("ks"))
            .where(F.bit_count("ks") >= NEEDED).select("doc_id", "source_id"))
    pairs = scratch.write(near, "passage-pairs")
    found = _checked(pairs, base, words, scratch)
    # what no passage found so far explains: by runs and by pairs of signatures
    open_ = _unexplained(shared, found, scratch)
    scratch.drop(shared)
    crowded = open_.join(groups.where("n > 2").select("key"), "key", "left_semi")      # signatures of two were compared already
    twos = (crowded.drop("content").repartition("doc_id").sortWithinPartitions("doc_id", "c")
            .mapInPandas(_signature_pairs(words), "pair long, doc_id long"))
    with arrow_batches(spark, 1 << 16, "16m"):          # narrow rows
        twos = scratch.write(twos, "passage-twos", "zstd")
    heads = scratch.write(twos.groupBy("pair").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last"))
                        .where("source_id < last").select("pair", "source_id"), "passage-heads", "zstd")
    again = bit_filter(twos, F.col("pair"), heads, "pair", 1 << 25).join(heads, "pair").where("doc_id <> source_id")
    again = again.select("doc_id", "source_id").unionByName(_exact_pairs(open_, base, words, scratch)).distinct()
    again = scratch.write(again.join(pairs, ["doc_id", "source_id"], "left_anti"), "passage-again")
    more = _checked(again, base, words, scratch)
    scratch.close()
    return found.unionByName(more)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the byte ranges (each from the start of a word to the
    end of one); the white space around a cut collapses to what stood before."""
    raw = utf8(text)
    out, at = [], 0
    for s, e in sorted(spans):
        if s > at:
            out.append(raw[at:s])
        at = max(at, e)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with every repeated passage but its first occurrence cut from
    the text; ``n_chars``, where there is such a column, follows.  Documents
    without a repeated passage stay as they are; one that consists of nothing
    else stays with what is left (an empty text)."""
    spans = materialize(repeated_passages(docs, words), "passage-spans")
    per_doc = materialize(spans.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("start_byte").alias("s"), F.col("end_byte").alias("e")))).alias("_spans")), "passage-cuts")

    def cut(batches):
        for pdf in batches:
            pdf["_new"] = [cut_spans(t, [(x["s"], x["e"]) for x in sp]) for t, sp in zip(pdf["text"], pdf["_spans"], strict=True)]
            yield pdf.drop(columns=["text", "_spans"])

    docs, _, shown = hide_extra(docs, ("doc_id", "text", "n_chars"))
    flagged = bit_flag(docs, F.col("doc_id").cast("long"), bit_table(per_doc, "_id"), "_maybe")
    same = flagged.where(~F.col("_maybe")).select(*docs.columns)
    doubt = flagged.where("_maybe").drop("_maybe").join(per_doc, F.col("doc_id").cast("long") == F.col("_id"), "left")
    rest = doubt.where("_id is null").select(*docs.columns)
    hit = doubt.where("_id is not null")
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["_new string"])
    new = hit.select(*[F.col(f"`{f.name}`") for f in others], "text", "_spans").mapInPandas(cut, schema)
    new = new.withColumn("text", F.col("_new"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(rest).unionByName(new.select(*docs.columns)).select(*shown)
