"""Mixture-controlled packing of token sequences (operator 10).

Each source is a queue of documents (in table order); a document is its token
ids and then id 1.  Deficit round-robin: of every window of ``WINDOW`` tokens
each source that still has tokens is due a share proportional to its target; it
is served in quanta of ``QUANTUM`` tokens when its deficit reaches half a
quantum, and what is not served is carried to the next window.  A dry queue
leaves its share to the others in proportion to their targets.  ``targets`` maps
sources to weights; a source not named weighs its share of the corpus, which is
also the default for all.

No window or partition needs another's state, because the carried deficits
have a closed form.  On a clock on which every live queue is served its target
``p`` per tick, quantum ``c`` of a queue is due at tick ``(c + 1/2) * QUANTUM / p`` and
a queue of ``T`` tokens runs dry at tick ``T / p``.  By tick ``v`` the stream holds
``F(v) = sum of min(p v, T)`` over the queues, and the quantum belongs to window
``F(v) div WINDOW``.  ``F`` is linear between the ticks at which queues run dry (a
table of one row per source); with corpus shares all run dry together and ``F(v) =
v``.  ``window_deficits`` lists what each source was due, got and carries after
every window.  The served quanta, ordered by window, source and place in the
queue, form one stream that is cut every ``LENGTH`` tokens; only the last
sequence is not full.

Positions in queue and stream are running sums over ranges of rows
(``prefix.running_sums``), so no task holds a source.  Texts are tokenized
once; the compressed ids are written once and exchanged once, when the pieces
of a document meet its ids.

Tokens: the ids of ``tokenizers`` with the given file.  Where the file is a
byte-level BPE whose merges are listed in the order of their ids and whose
tokens all encode to themselves, merging by rank gives the same ids, so
``tiktoken`` runs the file's own vocabulary (several times faster and without a
cache of words); texts with a special token's string or a very long run of
white space, and all texts under other files, go through ``tokenizers`` itself.

Defined cases: null and empty texts are id 1 alone; null sources form one
queue; rows repeated under one doc_id are packed separately; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventsurv.operators.prefix import running_sums
from eventsurv.sources.materialize import materialize
from llm.tables import small_batches, text_slices

LENGTH = 2048
WINDOW = 64 * LENGTH
QUANTUM = 512
END = 1
# the split of a byte-level pre-tokenizer (fixed value)
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GAP = re.compile(r"\s{256}")
_LOADED: dict[str, tuple] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Vocabulary as ranks, or None if merging by rank could give other ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
             and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    if not plain:
        return None
    vocab, byte = model["vocab"], _byte_of()
    special = {a["content"] for a in spec.get("added_tokens", [])}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])) or len(set(made)) + 256 != len([t for t in vocab if t not in special]):
        return None
    return {bytes([byte[c] for c in t]): i for t, i in vocab.items() if t not in special}


def _tokenizer(path: str):
    if path not in _LOADED:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        ranks = _ranks(path)
        fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        _LOADED[path] = (t, [a.content for a in t.get_added_tokens_decoder().values()], fast)
    return _LOADED[path]


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Token ids (uint32) of each text, without special tokens added."""
    t, special, fast = _tokenizer(path)
    out = []
    for text in texts:
        text = text or ""
        if fast is None or any(s in text for s in special) or _GAP.search(text):
            out.append(np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4"))
        else:
            out.append(np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4"))
    return out


def _tokenize(path: str, end: int):
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            blobs, counts = [], []
            for a, b in text_slices(texts, 2_000_000):
                for ids in encode(texts[a:b], path):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    counts.append(len(ids))
                    small = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                    blobs.append(bytes([small.itemsize]) + zlib.compress(small.tobytes(), 1))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "queue": pdf["queue"], "doc_tokens": counts, "blob": blobs})
    return run


def _cut(batches):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "source"]
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            ids = np.frombuffer(zlib.decompress(r.blob[1:]), dtype=f"<u{r.blob[0]}").astype("<u4")
            merged: list[list] = []
            for p in sorted(r.pieces, key=lambda p: p["start"]):
                s, n, seq, off, win = p["start"], p["length"], p["sequence_id"], p["offset"], p["window"]
                if merged and merged[-1][2] == seq and merged[-1][0] + merged[-1][1] == s and merged[-1][3] + merged[-1][1] == off:
                    merged[-1][1] += n
                else:
                    merged.append([s, n, seq, off, win])
            for s, n, seq, off, win in merged:
                rows.append((r.doc_id, s, n, zlib.crc32(ids[s:s + n].tobytes()), r.doc_tokens, seq, off, win, r.queue))
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, source string"


def _clock(totals: DataFrame, targets: dict[str, float]) -> tuple[dict[str, float], list[tuple[float, float, float]]]:
    """Target of every queue (they sum to 1) and, ordered by the tick at which
    each runs dry, ``(tick, F there, rate of F after it)``: one row per source."""
    rows = {r["queue"]: r["total"] for r in totals.collect()}
    total = sum(rows.values())
    weight = {q: float(targets.get(q, t / total)) for q, t in rows.items()}
    if any(not w > 0 for w in weight.values()):
        raise ValueError("targets must be positive")
    share = {q: w / sum(weight.values()) for q, w in weight.items()}
    rate, v, f, steps = 1.0, 0.0, 0.0, [(0.0, 0.0, 1.0)]
    for q in sorted(rows, key=lambda q: (rows[q] / share[q], q)):
        dry = rows[q] / share[q]
        f, v, rate = f + rate * (dry - v), dry, max(rate - share[q], 0.0)
        steps.append((v, f, rate))
    return share, steps


def window_deficits(pieces: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """``window, source, due, served, deficit`` from the pieces of :func:`pack`:
    tokens each source was due and got in every window, and what it carries."""
    spark = pieces.sparkSession
    got = pieces.groupBy("window", "source").agg(F.sum("length").alias("served"))
    got = materialize(got, "pack-served")
    totals = got.groupBy(F.col("source").alias("queue")).agg(F.sum("served").alias("total"))
    share, steps = _clock(totals, targets or {})
    last = got.agg(F.max("window")).first()[0]
    ticks = np.interp([(w + 1) * float(window) for w in range(-1, (-1 if last is None else last) + 1)], [f for _, f, _ in steps], [v for v, _, _ in steps])
    size = {r["queue"]: r["total"] for r in totals.collect()}
    rows = [(w, q, float(min(p * ticks[w + 1], size[q]) - min(p * ticks[w], size[q]))) for w in range(len(ticks) - 1) for q, p in share.items()]
    due = spark.createDataFrame(rows, "window long, source string, due double")        # windows x sources
    w = Window.partitionBy("source").orderBy("window")
    return (due.join(got, ["window", "source"], "left").withColumn("served", F.coalesce("served", F.lit(0)))
            .withColumn("deficit", F.sum(F.col("due") - F.col("served")).over(w)))


def pack(docs: DataFrame, path: str, length: int = LENGTH, window: int = WINDOW, quantum: int = QUANTUM, end: int = END,
         targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, window, source``."""
    spark = docs.sparkSession
    small_batches(spark)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    tokens = (docs.select(F.col("doc_id").cast("long"), F.coalesce(source, F.lit("")).alias("queue"), "text")
              .mapInPandas(_tokenize(path, end), "doc_id long, queue string, doc_tokens long, blob binary")
              .withColumn("rid", F.monotonically_increasing_id()))
    tokens = materialize(tokens, "pack-tokens")
    totals = materialize(tokens.groupBy("queue").agg(F.sum("doc_tokens").alias("total")), "pack-totals")
    everything = totals.agg(F.sum("total")).first()[0]
    if not everything:
        return spark.createDataFrame([], PIECES)
    windows = -(-everything // window)
    due = (F.col("c") + 0.5) * quantum * windows / F.col("total")
    if targets:
        share, steps = _clock(totals, targets)
        rates = spark.createDataFrame([(q, p) for q, p in share.items()], "queue string, rate double")
        totals = totals.join(rates, "queue")
        tick = (F.col("c") + 0.5) * quantum / F.col("rate")
        clock = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(s, ("v", "f", "r"))]) for s in steps])
        at = F.element_at(F.filter(clock, lambda s: s["v"] <= tick), -1)
        due = (at["f"] + at["r"] * (tick - at["v"])) / float(window)
    placed = running_sums(tokens.select("rid", "queue", "doc_tokens"), ["queue"], [F.col("rid")], ["doc_tokens"])
    pos, n = F.col("run_doc_tokens"), F.col("doc_tokens")
    q = F.lit(quantum)
    served = (placed.join(totals, "queue")
              .withColumn("c", F.explode(F.sequence(F.expr(f"run_doc_tokens div {quantum}"), F.expr(f"(run_doc_tokens + doc_tokens - 1) div {quantum}"))))
              .withColumns({"from": F.greatest(pos, F.col("c") * q), "to": F.least(pos + n, (F.col("c") + 1) * q)})
              .withColumn("window", F.least(F.lit(windows - 1), F.floor(due)).cast("long"))
              .select("rid", "queue", "window", F.col("from").alias("at"), (F.col("from") - pos).alias("start"), (F.col("to") - F.col("from")).alias("tokens")))
    stream = running_sums(served, [], [F.col("window"), F.col("queue"), F.col("at")], ["tokens"])
    first, last = F.expr(f"run_tokens div {length}"), F.expr(f"(run_tokens + tokens - 1) div {length}")
    pieces = (stream.withColumn("sequence_id", F.explode(F.sequence(first, last)))
              .withColumns({"a": F.greatest(F.col("run_tokens"), F.col("sequence_id") * length),
                            "b": F.least(F.col("run_tokens") + F.col("tokens"), (F.col("sequence_id") + 1) * length)})
              .select("rid", F.struct((F.col("start") + F.col("a") - F.col("run_tokens")).alias("start"), (F.col("b") - F.col("a")).alias("length"),
                                      "sequence_id", (F.col("a") - F.col("sequence_id") * length).alias("offset"), "window").alias("piece")))
    per_doc = pieces.groupBy("rid").agg(F.collect_list("piece").alias("pieces"))
    return (tokens.join(per_doc, "rid").select("doc_id", "queue", "doc_tokens", "blob", "pieces").mapInPandas(_cut, PIECES))
