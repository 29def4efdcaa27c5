"""Language identification (operator 6).

Features are hashed character 1- to 3-grams of the lower-cased text, other
characters than letters counted as one space; weights are TF-IDF, scaled to
unit length.  The document frequencies cover every training document.  The
classifier is a multinomial logistic regression trained by follow the
regularised leader (FTRL-proximal) with L1 and L2 penalties, on a sample of
``SAMPLE`` labelled rows shared out equally over all languages, but not less
than ``SHARE`` rows (or all there are) of each: the rows with the smallest hash
of (text, doc_id).  The model holds ``DIM`` weights a language.  A temperature
fitted on rows left out of training calibrates the probabilities.  Prediction
reads whole texts and nothing else.

Defined cases: null texts and texts without a letter are ``und`` with score
0; rows with a null ``lang`` don't train; without any training row every
text is ``und``; ties go to the smaller language name; texts longer than
``SLICE`` characters are counted slice by slice.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.tables import hide_extra, small_batches

DIM_BITS = 13
DIM = 1 << DIM_BITS
SAMPLE = 3000
SHARE = 46
SLICE = 1 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UND = "und"
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None without a letter."""
    if not text:
        return None
    total = None
    for at in range(0, len(text), SLICE):
        c = np.frombuffer(text[at:at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        solid = _letters()[c]
        if not solid.any():
            continue
        c = np.where(solid, c, 32)
        c = c[solid | np.concatenate([[True], solid[:-1]])].astype(np.uint64)
        grams = [c * _MUL[0]]
        if len(c) > 1:
            grams.append((c[:-1] * np.uint64(0x110001) + c[1:] + np.uint64(1)) * _MUL[1])
        if len(c) > 2:
            grams.append(((c[:-2] * np.uint64(0x110001) + c[1:-1]) * np.uint64(0x110003) + c[2:] + np.uint64(2)) * _MUL[2])
        n = np.bincount((np.concatenate(grams) >> np.uint64(64 - DIM_BITS)).astype(np.int64), minlength=DIM)
        total = n if total is None else total + n
    return total


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / max(np.linalg.norm(x), 1e-12)


def _document_frequencies(batches):
    df, n = np.zeros(DIM + 1, dtype=np.int64), 0
    for pdf in batches:
        for t in pdf["text"]:
            c = gram_counts(t)
            if c is not None:
                df[:DIM] += c > 0
                n += 1
    df[DIM] = n
    at = np.flatnonzero(df)
    yield pd.DataFrame({"gram": at.astype(np.int32), "df": df[at]})


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights ``(DIM, classes)`` from sparse rows (places, values)."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))
    w = np.zeros((DIM, classes))
    for _ in range(epochs):
        for (at, x), y in zip(xs, ys, strict=True):
            p = softmax(x @ w[at])
            p[y] -= 1.0
            g = x[:, None] * p
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w[at]
            n[at] = after
            za = z[at]
            w[at] = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(after)) / ALPHA + L2))
    return w


def temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on ``ys``."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(ys)), ys], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _fit(idf: np.ndarray, langs: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "lang"], kind="stable")
        xs, ys = [], []
        for t, lang in zip(pdf["text"], pdf["lang"], strict=True):
            c = gram_counts(t)
            if c is not None:
                x = tf_idf(c, idf)
                at = np.flatnonzero(x)
                xs.append((at, x[at]))
                ys.append(langs.index(lang))
        cut = max(1, len(xs) * 4 // 5) if len(xs) > 4 else len(xs)
        w = ftrl(xs[:cut], ys[:cut], len(langs))
        rest, truth = (xs[cut:], ys[cut:]) if cut < len(xs) else (xs, ys)
        t = temperature(np.array([x @ w[at] for at, x in rest]), np.array(truth)) if rest else 1.0
        return pd.DataFrame({"model": [pickle.dumps((w.astype(np.float32), t))]})
    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A model from ``text`` and ``lang`` of ``docs`` (rows without a label
    are ignored); None without any."""
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("text", "lang", F.shiftrightunsigned(F.xxhash64("text", "doc_id"), 24).alias("h"))
    counts = rows.groupBy("lang").count().collect()  # the classes of the model
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    df = np.zeros(DIM + 1)
    for r in rows.select("text").mapInPandas(_document_frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        df[r["gram"]] = r["df"]
    idf = np.log((1.0 + df[DIM]) / (1.0 + df[:DIM])) + 1.0
    share = max(SHARE, sample // len(langs))
    # about twice the share by hash, then exactly the share
    bounds = docs.sparkSession.createDataFrame(
        [(r["lang"], int(min(1.0, (2.0 * share + 50.0) / r["count"]) * 2 ** 40)) for r in counts], "lang string, _bound long")
    picked = (rows.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("_bound")).drop("_bound")
              .withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
              .where(F.col("_n") <= share).drop("_n"))
    fitted = picked.groupBy(F.lit(1).alias("one")).applyInPandas(_fit(idf, langs), "model binary").collect()
    w, t = pickle.loads(fitted[0]["model"])
    return {"langs": langs, "idf": idf, "w": w, "t": t}


def predict(model: dict | None, text: str = "text") -> Column:
    """``struct<lang string, score double>`` of each whole text."""
    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            c = gram_counts(t) if model else None
            if c is None:
                out.append((UND, 0.0))
                continue
            at = np.flatnonzero(c)
            x = np.log1p(c[at]) * model["idf"][at]
            p = softmax((x / max(np.linalg.norm(x), 1e-12)) @ model["w"][at].astype(np.float64) / model["t"])
            k = int(np.argmax(p))
            out.append((model["langs"][k], float(p[k])))
        return pd.DataFrame(out, columns=["lang", "score"])
    return of(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; held-out rows don't train."""
    model = train(docs.where(~held_out()))
    return (docs.select("doc_id", held_out().alias("held_out"), predict(model).alias("_p"))
            .select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``).
    Where nothing could be learned, nothing is rejected for that reason."""
    model = train(docs.where(~held_out()))
    if model is None:
        return docs
    hidden, _, shown = hide_extra(docs, ("text",))
    return hidden.withColumn("told", predict(model)["lang"]).where(F.col("told") != UND).select(*shown)
