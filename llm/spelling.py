"""Spelling variant grouping by permuterm rotations (operator 13).

Words are the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of the
texts, A-Z lower-cased; the word table holds every word of ``min_length`` code
points or more with ``min_count`` occurrences or more.

A word ``w`` is marked with a terminator, ``w$``, and rotated.  Take a rotation
``rest $ head c``: all before its last character ``c`` is a prefix that

* the rotations of every word with another character in the place of ``c``
  share (a replacement), and
* is itself a rotation of the word without ``c`` (a deletion; seen from the
  other side an insertion).

So all rotations are sorted by the prefix that skips the edited character,
whole rotations (the shorter word) among them.  A group of one prefix holds at
most one shorter word and one word for each letter of the alphabet, 93 rows at
most, whatever the table.  A scan of the group gives each member the
number of its neighbours there and the best of them (the group's best member
or, for that one itself, the second), so no pairs are written.  A replacement
is found in one group only; a deletion from a run of equal letters in one group
per letter of the run, so only the first letter of a run counts.

A word's form is its near word of largest count if that is at least twice its
own; counts double along the forms, so a chain has at most log2(largest count)
links and the root is found by pointer doubling in a few joins of narrow rows.

Defined cases: a null text has no words; a null doc_id is written as the empty
string in the hash of the planted misspellings; repeated rows count as often as
they occur; equal counts go to the smaller word in code-point order; an empty
table gives an empty result; further columns are ignored.  Texts are read whole;
those over ``LONG`` code points word by word, so memory follows the distinct
words, not the length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsurv.sources.materialize import materialize
from llm.tables import arrow_batches, text_slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = 1_000_000
HELD = 200_000
PLANT = 97
END = "$"


def misspell(doc_id: int | None, run: str) -> str:
    """The planted misspelling: in one of ``PLANT`` (document, run) pairs a
    code point chosen by the same hash is left out."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % PLANT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _text_counts(doc_id: int | None, text: str, min_length: int, plant: bool, out: Counter) -> None:
    found = RUN.findall(text) if len(text) <= LONG else (m.group() for m in RUN.finditer(text))
    lowered: Counter = Counter()
    for run, n in Counter(found).items():
        if len(run) >= min_length:
            lowered[run.translate(LOWER)] += n
    for run, n in lowered.items():
        word = misspell(doc_id, run) if plant else run
        if len(word) >= min_length:
            out[word] += n


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, plant: bool = False) -> DataFrame:
    """``word, n`` of all words of whole texts.  A task adds up the counts of
    its texts before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in text_slices(texts.to_pylist()):
                for doc_id, text in zip(ids[lo:hi], texts.slice(lo, hi - lo).to_pylist()):
                    if text:
                        _text_counts(doc_id, text, min_length, plant, held)
                    if len(held) > HELD:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """``key, kind, word, n``: for every rotation of ``word$`` the prefix that
    skips its last character (kind 1, or 2 if that character begins a run of
    equal letters) and the whole rotation (kind 0)."""
    length = F.length("word")
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.concat(F.substring("word", i + 1, length), F.lit(END), F.substring("word", F.lit(1), i)).alias("key"), F.lit(0).alias("kind")))

    def skipped(i):
        here, before = F.substring("word", i, F.lit(1)), F.substring("word", i - 1, F.lit(1))
        return F.struct(
            F.concat(F.substring("word", i + 1, length), F.lit(END), F.substring("word", F.lit(1), i - 1)).alias("key"),
            F.when((i == 1) | (here != before), 2).otherwise(1).alias("kind"))
    rows = words.select("word", "n", F.explode(F.concat(whole, F.transform(F.sequence(F.lit(1), length), skipped))).alias("r"))
    return rows.select("r.key", "r.kind", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n`` of the words that have a near word:
    how many, and the one of largest count (ties: the smallest)."""
    # range partitions: the rotations lie sorted over the cluster, a prefix range in one place
    rows = rotations(words).repartitionByRange("key")
    best = F.struct((-F.col("n")).alias("m"), "word")
    groups = rows.groupBy("key").agg(F.collect_list(F.struct(best.alias("b"), "kind")).alias("members")).where(F.size("members") > 1)
    tops = F.slice(F.array_sort(F.transform("members", lambda x: x["b"])), 1, 2)
    groups = groups.select("members", tops.alias("tops"),
                           F.size(F.filter("members", lambda x: x["kind"] > 0)).alias("longer"),
                           F.size(F.filter("members", lambda x: x["kind"] == 2)).alias("first"))
    one = groups.select(F.explode("members").alias("x"), "tops", "longer", "first", (F.size("members") > F.col("longer")).cast("int").alias("shorter"))
    n_near = (F.when(F.col("x.kind") == 0, F.col("first"))
              .otherwise(F.col("longer") - 1 + F.when(F.col("x.kind") == 2, F.col("shorter")).otherwise(0)))
    other = F.when(F.col("tops")[0] == F.col("x.b"), F.col("tops")[1]).otherwise(F.col("tops")[0])
    one = one.select(F.col("x.b.word").alias("word"), n_near.cast("long").alias("n_near"), other.alias("other"))
    return one.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("other").alias("other")).select(
        "word", "n_near", F.col("other.word").alias("near"), (-F.col("other.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` rows (a forest): pointer doubling."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, plant: bool = False) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    spark = docs.sparkSession
    with arrow_batches(spark, 512, "8m"):
        words = materialize(count_words(docs, min_length, min_count, plant), "spelling-words")
    near = materialize(neighbours(words), "spelling-near")
    rows = words.join(near, "word", "left").withColumn("has", F.col("near_n") >= ratio * F.col("n"))
    forms = rows.where("has").select("word", F.col("near").alias("form"))
    return rows.join(roots(forms), "word", "left").select(
        "word", F.when(F.col("has"), F.col("near")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), F.col("near_n")).alias("form_n"))
