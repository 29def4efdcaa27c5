"""Toxicity scores (operator 8).

*Lexicon.*  Learned from the labelled training rows, each distinct text
counted once: all words in at least ``LEAST`` toxic texts, however many those
are, whose smoothed share of toxic texts is ``PURITY`` or more and whose log
odds, their weight, are above 0.  Words are counted and selected in Spark,
those that a sixteenth of the clean texts already makes impure without a count
of the others;
the selected ones, all of them, are the model and go to the driver and to the
workers.

*Misspellings.*  The lexicon is a trie; its intersection with Levenshtein
automata (no error under 5 letters, one error up to 8, two beyond) is
determinised on demand, so a word is matched in one pass and most words leave
it after two or three letters.  Words near a term that occur in clean
training texts are no misspellings of it (``known`` words).

*Context.*  A hit counts less where the window of ``CONTEXT`` words around it
has quotation marks on both sides or a word that reports speech.  Heaviest
weights of exact hits and of misspellings, number of distinct terms, plain and
quoted hits and their share of the words enter a logistic regression, fitted on
at most ``SAMPLE`` labelled rows.  The fit is crossed: the training texts are
dealt into ``FOLDS`` parts by their hash and a text is measured with the lexicon
and the known words learned from the other parts, so the regression sees terms
and near matches as unseen texts have them.  Scores use the lexicon of all.

Defined cases: null, empty and hit-less texts get the score of no hit; rows
without a label don't train; without toxic training rows the score is 0;
repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize
from llm.tables import BITS, bit_filter, small_batches

LEAST = 3
PURITY = 0.8
CONTEXT = 6
SAMPLE = 20_000
FOLDS = 5
PARTS = 16
FEATURES = 6
THRESHOLD = 0.3
QUOTES = set("\"'“”„«»‘’`")
REPORTING = set("said says wrote quote quoted called term word slur sagte schrieb zitat wort dit écrit cité mot dijo escribió cita palabra".split())
WORD = re.compile(r"\w+")
_CACHE = 300_000


def allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) <= 8 else 2


class Lexicon:
    """Trie of the terms and its product with the Levenshtein automata."""

    def __init__(self, terms: dict[str, float], known: set[str]):
        self.terms, self.known = terms, known
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in sorted(terms):
            at = 0
            for c in t:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                at = self.child[at][c]
            self.term[at] = t
        # errors that some term below a node may still take
        self.room = [0] * len(self.child)
        for t in terms:
            at = 0
            self.room[0] = max(self.room[0], allowed(t))
            for c in t:
                at = self.child[at][c]
                self.room[at] = max(self.room[at], allowed(t))
        self.alphabet = {c for m in self.child for c in m}
        self._reset()
        self.words: dict[str, tuple[str, int] | None] = {}

    def _reset(self) -> None:
        start = self._close({0: 0})
        self.ids, self.states, self.step = {start: 1}, {1: start}, {}

    def _close(self, errors: dict[int, int]) -> tuple:
        """Adds the nodes reached by leaving out letters of a term."""
        todo = list(errors.items())
        while todo:
            node, e = todo.pop()
            for nxt in self.child[node].values():
                if e + 1 <= self.room[nxt] and errors.get(nxt, 99) > e + 1:
                    errors[nxt] = e + 1
                    todo.append((nxt, e + 1))
        return tuple(sorted(errors.items()))

    def _move(self, state: int, c: str) -> int:
        errors: dict[int, int] = {}
        for node, e in self.states[state]:
            for letter, nxt in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.room[nxt] and errors.get(nxt, 99) > cost:
                    errors[nxt] = cost
            if e + 1 <= self.room[node] and errors.get(node, 99) > e + 1:
                errors[node] = e + 1
        if not errors:
            return 0
        key = self._close(errors)
        if key not in self.ids:
            self.ids[key] = len(self.ids) + 1
            self.states[self.ids[key]] = key
        return self.ids[key]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed errors, and the errors."""
        if word in self.words:
            return self.words[word]
        if word in self.terms:
            return word, 0
        found = None
        if word not in self.known and len(word) > 2:
            state = 1
            for c in word:
                c = c if c in self.alphabet else "\0"
                nxt = self.step.get((state, c))
                if nxt is None:
                    nxt = self.step[(state, c)] = self._move(state, c)
                state = nxt
                if not state:
                    break
            else:
                ends = [(e, self.term[node]) for node, e in self.states[state] if self.term[node] and e <= allowed(self.term[node])]
                if ends:
                    e, t = min(ends)
                    found = (t, e)
        if len(self.step) > _CACHE:
            self._reset()
        if len(self.words) > _CACHE:
            self.words.clear()
        self.words[word] = found
        return found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Heaviest weight of an exact hit and of a misspelling, distinct terms,
    plain hits, quoted hits, share."""
    low = (text or "").lower()
    words = WORD.findall(low)
    hits = {w: m for w in set(words) if (m := lexicon.match(w))}
    if not hits:
        return [0.0] * FEATURES
    weight = {w: lexicon.terms[t] * (1 - e / len(t)) for w, (t, e) in hits.items()}
    spots = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    best, plain, quoted = [0.0, 0.0], 0.0, 0.0
    for i, (w, s, e) in enumerate(spots):
        if w in hits:
            a, b = max(0, i - CONTEXT), min(len(spots), i + CONTEXT + 1)
            before, after = low[spots[a][1]:s], low[e:spots[b - 1][2]]
            marks = bool(QUOTES & set(before)) and bool(QUOTES & set(after))
            told = any(spots[k][0] in REPORTING for k in range(a, b))
            x = weight[w] * (0.3 if marks or told else 1.0)
            near = int(hits[w][1] > 0)
            best[near] = max(best[near], x)
            quoted += marks or told
            plain += not (marks or told)
    return [*best, np.log1p(len({t for t, _ in hits.values()})), np.log1p(plain), np.log1p(quoted), 10 * (plain + quoted) / len(words)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _words_of(keep):
    """Gives (_id, words): the distinct words of each text that ``keep`` holds."""
    def run(batches):
        for pdf in batches:
            words = [[w for w in set(WORD.findall(t.lower())) if keep(w)] for t in pdf["text"]]
            some = np.array([bool(w) for w in words], dtype=bool)
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy()[some], "words": pd.Series([w for w in words if w], dtype=object)})
    return run


def word_counts(texts: DataFrame, rows: DataFrame, keep) -> DataFrame:
    """``word, clean, toxic`` (arrays by fold): the texts of ``rows`` (_id, toxic,
    fold) with each word that ``keep`` holds.  Only these words are shuffled, no text."""
    words = bit_filter(texts, F.col("_id"), rows, "_id").mapInPandas(_words_of(keep), "_id long, words array<string>")

    def by_fold(value: int) -> Column:
        return F.array(*[F.count(F.when((F.col("toxic") == value) & (F.col("fold") == f), 1)) for f in range(FOLDS)])
    return (words.join(rows, "_id").select(F.explode("words").alias("word"), "toxic", "fold").groupBy("word")
            .agg(by_fold(0).alias("clean"), by_fold(1).alias("toxic")))


def fold_of(text_hash: Column) -> Column:
    return F.pmod(text_hash, F.lit(FOLDS)).cast("int")


def selected(row, totals: np.ndarray) -> float | None:
    """Weight of a word with ``row = (clean, toxic)`` texts if it is a term."""
    (clean, toxic), (c_all, a_all) = row, totals
    if toxic < LEAST or toxic / (toxic + clean + 0.5) < PURITY:
        return None
    w = np.log((toxic + 0.5) / (a_all - toxic + 0.5)) - np.log((clean + 0.5) / (c_all - clean + 0.5))
    return float(w) if w > 0 else None


def word_filter(words: DataFrame):
    """``keep`` for ``word_counts``: false only for words that are certainly
    not in ``words``.  A bitmap of 1 MB whatever their number."""
    p = F.crc32(F.col("word").cast("binary")) % BITS + 1
    rows = words.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits")).collect()
    held = bytearray(BITS // 8)
    for r in rows:
        at = (r["bucket"] - 1) * len(r["bits"])
        held[at:at + len(r["bits"])] = r["bits"]
    held = bytes(held)

    def keep(word: str) -> bool:
        c = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BITS
        return bool(held[c >> 3] >> (c & 7) & 1)
    return keep


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (p - y) + 0.5 * b * (np.arange(len(b)) < len(b) - 1))
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray] | None:
    """Lexicon and regression from the labelled rows of ``docs``; None
    without toxic ones."""
    small_batches(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where("doc_id is not null and text is not null")
    first = texts.select("_id", F.xxhash64("text").alias("h")).join(marked, "_id").groupBy("h").agg(F.min("_id").alias("_id"), F.max("toxic").alias("toxic"))
    first = materialize(first.select("_id", "toxic", fold_of(F.col("h")).alias("fold")), "toxic-ids")
    totals = np.zeros((2, FOLDS))
    for r in first.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r["toxic"], r["fold"]] = r["n"]
    if not totals[1].sum():
        return None

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    often = word_counts(texts, first.where("toxic = 1"), lambda w: True).where(total("toxic") >= LEAST).select("word", "toxic")
    often = materialize(often, "toxic-words")
    # a part of the clean texts rules out most words (the frequent ones), so that few words of all texts move
    part = F.pmod(F.xxhash64("_id"), F.lit(PARTS)) == 0
    least = word_counts(texts.where(part), first.where("toxic = 0").where(part), word_filter(often)).select("word", total("clean").alias("least"))
    often = often.join(least, "word", "left").where(total("toxic") / (total("toxic") + F.coalesce("least", F.lit(0)) + 0.5) >= PURITY)
    often = materialize(often.select("word", "toxic"), "toxic-candidates")
    clean = word_counts(texts, first.where("toxic = 0"), word_filter(often)).select("word", "clean")
    none = F.array(*[F.lit(0).cast("long")] * FOLDS)
    counts = often.join(clean, "word", "left").select("word", "toxic", F.coalesce("clean", none).alias("clean"))
    pure = total("toxic") / (total("toxic") + total("clean") + 0.5) >= PURITY
    terms: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]            # the last one: of all texts
    for r in counts.where(pure).collect():                                   # the model
        n = np.array([r["clean"], r["toxic"]], dtype=float)
        w = selected(n.sum(axis=1), totals.sum(axis=1))
        if w is not None:
            terms[-1][r["word"]] = w
            for f in range(FOLDS):
                w = selected(n.sum(axis=1) - n[:, f], totals.sum(axis=1) - totals[:, f])
                if w is not None:
                    terms[f][r["word"]] = w
    bare = Lexicon(terms[-1], set())
    # clean words within reach of a term: as many as the lexicon's neighbourhood
    near = word_counts(texts, first, lambda w: bool((m := bare.match(w)) and m[1]))
    known: list[set[str]] = [set() for _ in range(FOLDS + 1)]
    for r in near.where(total("clean") > 0).collect():
        n = np.array([r["clean"], r["toxic"]])
        for f in range(FOLDS + 1):
            c, t = n.sum(axis=1) - (n[:, f] if f < FOLDS else 0)
            if c > 0 and c >= t:
                known[f].add(r["word"])
    crossed = [Lexicon(t, k) for t, k in zip(terms, known)]
    bound = int(min(1.0, SAMPLE / totals.sum()) * 2 ** 40)
    few = first.where(F.shiftrightunsigned(F.xxhash64("_id"), 24) <= bound)

    def measure(batches):
        for pdf in batches:
            x = [features(t, crossed[f]) for t, f in zip(pdf["text"], pdf["fold"])]
            yield pd.DataFrame({"_id": pdf["_id"], "x": pd.Series(x, dtype=object)})

    dealt = bit_filter(texts, F.col("_id"), few, "_id").withColumn("fold", fold_of(F.xxhash64("text")))
    measured = dealt.mapInPandas(measure, "_id long, x array<double>")
    xy = measured.join(few, "_id").select("x", F.col("toxic").alias("y")).collect()    # bounded by SAMPLE
    xy = sorted(xy, key=lambda r: (r["y"], r["x"]))
    return crossed[-1], fit_logistic(np.array([r["x"] for r in xy]), np.array([r["y"] for r in xy], dtype=float))


def score(model, text: str = "text") -> Column:
    """Probability that a text is toxic."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        lexicon, b = model
        x = np.array([features(t, lexicon) for t in texts]).reshape(-1, FEATURES)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30))))
    return of(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; held-out rows don't train."""
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return (docs.select("doc_id", held_out().alias("held_out"), score(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
