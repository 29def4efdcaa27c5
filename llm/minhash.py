"""MinHash near-duplicates by a multi-index Hamming join (operator 1).

A document is the set of its distinct ``n``-word shingles.  Its signature has
64 min-hash symbols of 16 bits.  For Jaccard similarity 0.8 a symbol differs
with probability 0.2, so 12.8 of 64 differ on average (deviation 3.2); the
signature distance searched is ``RADIUS`` = 27, 4.4 deviations away.

*Pigeonhole.*  The symbols are split into 14 chunks (eight of 5, six of 4).
Two signatures at distance <= 27 = 14 * 2 - 1 have a chunk with at most one
wrong symbol.  Every allowed error is enumerated: for each chunk and each of
its symbols one key over the others, 64 keys a document.  So every pair
within the radius meets in a bucket.

*Skew.*  Equal sets are collapsed first (one representative, the smallest
doc_id).  Buckets of one row are dropped by a bitmap of fixed size before the
exchange.  A bucket is compared in blocks of ``BLOCK`` signatures, in tasks,
and gives a spanning forest, never its pairs; every row of a larger bucket is
joined to its first member without a test (candidates only), so that pairs
dealt to different blocks meet in the exact step.  The
components of that candidate graph are then confirmed on the full sets in
blocks of ``BLOCK_DOCS`` documents.  A component of more than one block is
dealt into random blocks twice; members that are still outside its largest
part are then compared with all the others in a grid of bounded blocks, so
no link between components is lost and no task holds the group.

Defined cases: null and empty texts (or without words) have 0 shingles and
link with nothing; rows with a null doc_id link with nothing and stay; equal
rows form one class; an empty table gives an empty result; further columns
are ignored (``near_dedup`` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize
from llm.tables import bit_filter, components, drop_ids, hide_extra, small_batches, text_slices
from llm.words import constants, mix, shingles, word_hashes

SYMBOLS = 64
CHUNKS = [5] * 8 + [4] * 6
ERRORS = 1
RADIUS = len(CHUNKS) * (ERRORS + 1) - 1
BLOCK = 64
BLOCK_DOCS = 256
_U = np.uint64


def signature(s: np.ndarray) -> np.ndarray:
    """64 symbols of 16 bits of a set of hashes (int16 view of uint16)."""
    mul, flip = constants(SYMBOLS, 101), constants(SYMBOLS, 202)
    low = np.full(SYMBOLS, np.iinfo(_U).max, dtype=_U)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[at:at + 2048, None] ^ flip) * mul).min(axis=0))
    return (mix(low) >> _U(48)).astype(np.uint16)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for a, b in text_slices(texts):
        w = word_hashes(texts[a:b])
        for i in range(b - a):
            yield np.unique(shingles(w.hashes[w.bounds[i]:w.bounds[i + 1]], n))


def _sign(n: int):
    def run(batches):
        fold = constants(2, 303)
        for pdf in batches:
            rows = []
            for doc, s in zip(pdf["doc_id"], shingle_sets(pdf["text"].tolist(), n), strict=True):
                k = [int((mix(s * c).sum(dtype=_U) + _U(len(s))).astype(np.int64)) for c in fold]
                rows.append((doc, len(s), *k, signature(s).tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "k1", "k2", "sig"]).astype({"doc_id": "Int64"})
    return run


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """``(documents, 64)`` bucket keys: chunk by chunk, one symbol left out."""
    mul = constants(SYMBOLS, 404)
    weighted = sig.astype(_U) * mul
    leave = constants(SYMBOLS, 505)
    out = np.empty(sig.shape, dtype=_U)
    at = 0
    for size in CHUNKS:
        whole = weighted[:, at:at + size].sum(axis=1, dtype=_U)
        for j in range(at, at + size):
            out[:, j] = mix(whole - weighted[:, j] + leave[j])
        at += size
    return out


def _keys(batches):
    for pdf in batches:
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(-1, SYMBOLS)
        yield pd.DataFrame({"key": chunk_keys(sig).astype(np.int64).ravel(), "rep": np.repeat(pdf["rep"].to_numpy(), SYMBOLS)})


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest node linked with it."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _bucket_links(batches):
    """Rows sorted by (key, block): a spanning forest of the pairs within the
    radius in each block, and a link from each row of a larger bucket to the
    bucket's first member."""
    rest = None

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        key, block, rep = (pdf[c].to_numpy() for c in ("key", "block", "rep"))
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(-1, SYMBOLS)
        same = (key[1:] == key[:-1]) & (block[1:] == block[:-1])
        group = np.concatenate([[0], np.cumsum(~same)])
        ii, jj, lag = [], [], 1
        while lag < len(rep):
            at = np.flatnonzero(group[lag:] == group[:-lag])
            if not len(at):
                break
            for part in np.array_split(at, len(at) // 100_000 + 1):
                near = part[(sig[part] != sig[part + lag]).sum(axis=1) <= RADIUS]
                ii.append(near)
                jj.append(near + lag)
            lag += 1
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ii, jj))
        label = _forest(len(rep), i, j)
        moved = np.flatnonzero(label != np.arange(len(rep)))
        # of a tree, the root stands for the others
        far = np.flatnonzero((label == np.arange(len(rep))) & pdf["split"].to_numpy())
        return pd.DataFrame({"a": np.concatenate([rep[moved], rep[far]]),
                             "b": np.concatenate([rep[label[moved]], pdf["lead"].to_numpy()[far]])})

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        key, block = pdf["key"].to_numpy(), pdf["block"].to_numpy()
        cut = len(pdf) - int(np.argmax(((key != key[-1]) | (block != block[-1]))[::-1])) if (key != key[-1]).any() or (block != block[-1]).any() else 0
        rest = pdf.iloc[cut:]
        if cut:
            yield links(pdf.iloc[:cut])
    if rest is not None and len(rest):
        yield links(rest.reset_index(drop=True))


def _confirm(n: int, threshold: int):
    """Confirms links of one block on full sets.  Columns: rep, part (its
    component so far), side (0, or 1 for the rows to compare with all
    others; null: compare all), text.  Gives a spanning forest."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(pdf["text"].tolist(), n))
        sig = np.array([signature(s) for s in sets], dtype=np.uint16).reshape(-1, SYMBOLS)
        size = np.array([len(s) for s in sets])
        rep, part = pdf["rep"].to_numpy(), pdf["part"].to_numpy()
        side = pdf["side"].to_numpy(dtype=np.float64, na_value=np.nan)
        ii, jj, dd = [], [], []
        for i in range(len(sets)):
            if side[i] == 0:
                continue
            other = np.arange(i + 1, len(sets)) if np.isnan(side[i]) else np.flatnonzero(side == 0)
            other = other[part[other] != part[i]]
            other = other[100 * np.minimum(size[other], size[i]) >= threshold * np.maximum(size[other], size[i])]
            far = (sig[other] != sig[i]).sum(axis=1)
            near = far <= RADIUS
            ii.append(np.full(near.sum(), i))
            jj.append(other[near])
            dd.append(far[near])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        if ii:
            i, j, d = (np.concatenate(x) for x in (ii, jj, dd))
            for k in np.argsort(d, kind="stable"):
                x, y = find(int(part[i[k]])), find(int(part[j[k]]))
                if x == y:
                    continue
                a, b = sets[i[k]], sets[j[k]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= threshold * (len(a) + len(b) - both):
                    root[max(x, y)] = min(x, y)
                    out.append((rep[i[k]], rep[j[k]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def near_components(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.  Links:
    ``100 * intersection >= threshold * union``."""
    if threshold < 80:
        raise ValueError("the signature radius is laid out for a similarity of 0.8 or more")
    small_batches(docs.sparkSession)
    signed = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        _sign(n), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"), "near-signed")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "near-reps")
    keys = reps.select("rep", "sig").mapInPandas(_keys, "key long, rep long")
    buckets = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lead")).where("n > 1"), "near-buckets")
    entries = (bit_filter(keys, F.col("key"), buckets, "key", 1 << 25).join(buckets, "key")
               .withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)))
               .select("key", "block", (F.col("n") > BLOCK).alias("split"), "lead", "rep"))
    entries = entries.join(reps.select("rep", "sig"), "rep").repartition("key", "block").sortWithinPartitions("key", "block")
    maybe = materialize(components(entries.mapInPandas(_bucket_links, "a long, b long")), "near-maybe")
    sizes = materialize(maybe.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    members = materialize(maybe.join(sizes, "component").select(F.col("node").alias("rep"), "component", "n"), "near-members")
    texts = (bit_filter(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), F.col("rep"), members, "rep")
             .join(members, "rep"))
    confirm = _confirm(n, threshold)
    blocks = F.ceil(F.col("n") / BLOCK_DOCS)
    links = []
    state = members.withColumn("part", F.col("rep"))
    rows = texts.withColumn("part", F.col("rep"))
    big = materialize(sizes.where(F.col("n") > BLOCK_DOCS).select(F.col("component"), F.col("n")), "near-big")
    for seed in (1, 2):
        dealt = (rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(seed)), blocks))
                 .withColumn("side", F.lit(None).cast("double")).select("component", "block", "rep", "part", "side", "text"))
        found = materialize(dealt.groupBy("component", "block").applyInPandas(confirm, "a long, b long"), "near-links")
        links.append(found)
        if big.isEmpty():
            break
        all_links = links[0].unionByName(links[1]) if len(links) > 1 else links[0]
        parts = components(all_links).withColumnRenamed("component", "_part")
        state = materialize(members.join(big.select("component"), "component", "left_semi")
                            .join(parts, F.col("rep") == F.col("node"), "left")
                            .select("rep", "component", "n", F.coalesce("_part", "rep").alias("part")), "near-state")
        rows = (bit_filter(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), F.col("rep"), state, "rep")
                .join(state, "rep"))
    else:
        # what is still outside the largest part of its component, against all the others
        shares = state.groupBy("component", "part").agg(F.count(F.lit(1)).alias("_m"))
        largest = shares.groupBy("component").agg(F.max(F.struct("_m", F.col("part").alias("_main"))).alias("_top"))
        plan = materialize(largest.join(big, "component").select(
            "component", F.col("_top._main").alias("_main"), F.ceil((F.col("n") - F.col("_top._m")) / BLOCK_DOCS).alias("_few"),
            F.ceil(F.col("n") / BLOCK_DOCS).alias("_all")).where("_few > 0"), "near-plan")
        wide = rows.drop("n").join(plan, "component")
        grid = [wide.withColumns({"i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_few") - 1)),
                                  "j": F.pmod(F.xxhash64("rep", F.lit(3)), F.col("_all")), "side": F.lit(0.0)}),
                wide.where("part <> _main").withColumns({"i": F.pmod(F.xxhash64("rep", F.lit(4)), F.col("_few")),
                                                         "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1)),
                                                         "side": F.lit(1.0)})]
        cells = [g.select("component", "i", "j", "rep", "part", "side", "text") for g in grid]
        links.append(materialize(cells[0].unionByName(cells[1]).groupBy("component", "i", "j")
                                 .applyInPandas(confirm, "a long, b long"), "near-links"))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    parts = components(found)
    classes = materialize(reps.select("k1", "k2", "rep").join(parts, F.col("rep") == F.col("node"), "left")
                          .select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), "near-classes")
    linked = linkable.join(classes, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = (signed.where("n_shingles = 0 or doc_id is null")
             .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without the rows that are not the first of their component."""
    flags = near_components(docs, n, threshold)
    hidden, _, shown = hide_extra(docs, ("doc_id",))
    return drop_ids(hidden, flags.where("not kept").select("doc_id")).select(*shown)
