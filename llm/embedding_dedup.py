"""Embedding near-duplicates by product quantisation (operator 5).

Vectors are scaled to unit length.  Equal vectors are collapsed to one class
(smallest vec_id, number of rows).  A coarse quantiser of about ``sqrt(n)``
centroids (at most ``MAX_LISTS``) gives inverted lists; the residual to the
list's centroid is coded in ``SUBSPACES`` parts of ``CODEWORDS`` codewords.
Both are fitted on a bounded sample of ``SAMPLE`` classes, or four for each list
if that is more (smallest hash); every row is indexed and every row is a query.

Search: a query goes to its ``PROBES`` nearest lists.  Table lookups give the
distance to the coded vector; the code's own error ``e`` is stored, and the
triangle inequality ``|x - y| >= |x - coded y| - e`` drops only vectors that
can't reach the threshold, so inside the probed lists nothing is lost.  What
is left is ranked by the exact cosine in double precision.  Recall against
brute force is measured in the tests and in the README.

Skew: list members and queries are dealt into cells of at most about
``BLOCK`` by ``QUERY_BLOCK`` rows; a cell gives counts of links and a spanning
forest, never its pairs.  A pair that meets in two lists is counted in one.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, as do rows with a null vec_id; vectors of
different length never link; equal rows are links of each other; an empty
table gives an empty result; further columns (labels too) are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize
from llm.minhash import _forest
from llm.tables import components

MAX_LISTS = 16384
SAMPLE = 16384
SUBSPACES = 8
CODEWORDS = 64
PROBES = 16
BLOCK = 1024
QUERY_BLOCK = 4096


def unit(vectors: list, dim: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to ``dim``."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's iterations from ``k`` rows spread over ``x``."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def _fit(dim: int, lists: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf.sort_values("k1", kind="stable")["embedding"].tolist(), dim)
        coarse = kmeans(x, min(lists, len(x)))
        rest = x - coarse[nearest(x, coarse)]
        books = [kmeans(part, min(CODEWORDS, len(part))) for part in np.array_split(rest, min(SUBSPACES, dim), axis=1)]
        return pd.DataFrame({"model": [pickle.dumps((coarse, books))]})
    return run


def encode(x: np.ndarray, coarse: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and code error of unit vectors."""
    own = nearest(x, coarse)
    rest = x - coarse[own]
    codes = np.empty((len(x), len(books)), dtype=np.uint8)
    miss = np.zeros(len(x))
    for m, part in enumerate(np.array_split(rest, len(books), axis=1)):
        codes[:, m] = nearest(part, books[m])
        miss += ((part - books[m][codes[:, m]]) ** 2).sum(axis=1)
    return own, codes, np.sqrt(miss)


def _blobs(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=object)
    out[:] = [r.tobytes() for r in rows]
    return out


def _index(dim: int, model, probes: int):
    """Class rows -> one row for each probed list; ``own`` marks the list
    that holds the vector."""
    def run(batches):
        coarse, books = model
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(pdf["embedding"].tolist(), dim)
            own, codes, miss = encode(x, coarse, books)
            far = (coarse * coarse).sum(axis=1) - 2 * x @ coarse.T
            n = min(probes, len(coarse))
            near = np.argpartition(far, n - 1, axis=1)[:, :n].astype(np.int32)
            yield pd.DataFrame({
                "list": near.ravel(), "rep": np.repeat(pdf["rep"].to_numpy(), n), "m": np.repeat(pdf["m"].to_numpy(), n),
                "home": np.repeat(own.astype(np.int32), n), "own": near.ravel() == np.repeat(own, n),
                "embedding": np.repeat(pdf["embedding"].to_numpy(), n), "codes": np.repeat(_blobs(codes), n),
                "miss": np.repeat(miss, n), "probes": np.repeat(_blobs(near), n)})
    return run


def _cell(dim: int, model, threshold: float):
    reach = np.sqrt(2 - 2 * threshold)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        coarse, books = model
        member = pdf["member"].to_numpy(dtype=bool)
        base, query = pdf[member], pdf[~member]
        out = pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        if not len(base) or not len(query):
            return out
        x, y = unit(query["embedding"].tolist(), dim), unit(base["embedding"].tolist(), dim)
        lx, ly = (np.array([len(v) for v in q["embedding"]]) for q in (query, base))
        codes = np.frombuffer(b"".join(base["codes"]), dtype=np.uint8).reshape(len(base), -1)
        limit = base["miss"].to_numpy() + reach + 1e-9
        rx, ry = query["rep"].to_numpy(), base["rep"].to_numpy()
        wide = [np.frombuffer(p, dtype=np.int32) for p in base["probes"]]
        home = query["home"].to_numpy()
        rest = x - coarse[int(key[0])]
        parts = np.array_split(rest, len(books), axis=1)
        ii, jj = [], []
        step = max(1, 4_000_000 // len(base))
        for a in range(0, len(x), step):
            adc = np.zeros((min(step, len(x) - a), len(base)))
            for m, book in enumerate(books):  # asymmetric distances by table
                part = parts[m][a:a + step]
                lut = (part * part).sum(axis=1)[:, None] - 2 * part @ book.T + (book * book).sum(axis=1)
                adc += lut[:, codes[:, m]]
            i, j = np.nonzero(adc <= limit ** 2)
            i += a
            ok = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
            ok &= (rx[i] != ry[j]) & (lx[i] == ly[j])
            i, j = i[ok], j[ok]
            # a pair that also meets in the query's own list counts in one of the two
            both = np.fromiter((home[p] in wide[q] for p, q in zip(i, j, strict=True)), dtype=bool, count=len(i))
            ok = ~both | (rx[i] < ry[j])
            ii.append(i[ok])
            jj.append(j[ok])
        i, j = np.concatenate(ii), np.concatenate(jj)
        if not len(i):
            return out
        mx, my = query["m"].to_numpy(), base["m"].to_numpy()
        cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        np.add.at(cx, i, my[j])
        np.add.at(cy, j, mx[i])
        nodes, place = np.unique(np.concatenate([rx, ry]), return_inverse=True)
        label = _forest(len(nodes), place[i], place[len(rx) + j])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        reps = np.concatenate([rx[cx > 0], ry[cy > 0]])
        return pd.DataFrame({"a": np.concatenate([reps, nodes[moved]]), "b": np.concatenate([reps, nodes[label[moved]]]),
                             "links": np.concatenate([cx[cx > 0], cy[cy > 0], np.zeros(len(moved), np.int64)])})
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, probes: int = PROBES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding"))
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & finite & some, F.lit(False)))
    clean = F.transform(v, lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c))
    rows = rows.withColumns({"embedding": F.when(F.col("ok"), clean)}).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    classes = materialize(rows.where("ok").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding")), "vec-classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    empty = spark.createDataFrame([], "a long, b long, links long")
    found = empty
    if n > 1:
        lists = int(min(MAX_LISTS, 1 << max(0, round(np.log2(np.sqrt(n))))))
        size = max(SAMPLE, 4 * lists)
        bound = int(min(1.0, size / n) * 2 ** 40)
        sample = classes.where(F.shiftrightunsigned(F.xxhash64("k2"), 24) <= bound) if n > size else classes
        fitted = sample.select("k1", "embedding").groupBy(F.lit(1).alias("one")).applyInPandas(_fit(dim, lists), "model binary").first()
        model = pickle.loads(fitted["model"])
        index = materialize(classes.select("rep", "m", "embedding").mapInPandas(
            _index(dim, model, probes), "list int, rep long, m long, home int, own boolean, embedding array<double>, codes binary, miss double, probes binary"), "vec-index")
        sizes = materialize(index.groupBy("list").agg(
            F.ceil(F.count_if("own") / BLOCK).alias("nb"), F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("nq")).where("nb > 0"), "vec-lists")
        dealt = index.join(F.broadcast(sizes), "list")  # at most MAX_LISTS rows
        base = dealt.where("own").withColumns({"b": F.pmod(F.xxhash64("rep"), F.col("nb")), "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)), "member": F.lit(True)})
        query = dealt.withColumns({"b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)), "q": F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("nq")), "member": F.lit(False)})
        columns = ["list", "b", "q", "member", "rep", "m", "home", "embedding", "codes", "miss", "probes"]
        found = materialize(base.select(*columns).unionByName(query.select(*columns)).groupBy("list", "b", "q")
                            .applyInPandas(_cell(dim, model, threshold), "a long, b long, links long"), "vec-links")
    links = found.groupBy("a").agg(F.sum("links").alias("_links")).withColumnRenamed("a", "rep")
    parts = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    of_class = materialize(classes.select("k1", "k2", "rep", "m").join(links, "rep", "left").join(parts, "rep", "left").select(
        "k1", "k2", (F.col("m") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vec-result")
    linked = rows.where("ok").select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
