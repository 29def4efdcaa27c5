"""corpus_pipeline.run and each of its stages against brute force; the scores
of operator 8 recomputed without tries and automata."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from llm import substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    texts = []
    for letters, lang in (("abcdefgh", "xx"), ("mnopqrst", "yy")):
        texts += [(words(rng, rng.randint(20, 150), letters) + ".", lang) for _ in range(60)]
        base = words(rng, 120, letters)
        texts += [(base + " " + words(rng, 1, letters), lang) for _ in range(4)]                     # near copies
        texts += [(texts[-1][0].replace(" ", "  \n"), lang), (texts[0][0], lang)]                    # exact copies
        passage = words(rng, 70, letters)
        texts += [(words(rng, 25, letters) + " " + passage + " " + words(rng, 25, letters), lang) for _ in range(3)]
    texts += [(None, None), ("", None), ("12 345 !!", None), ("\n\t ", None)]
    rng.shuffle(texts)
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    return str(path)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_stages_against_brute_force(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "minhash_near_dedup", "substring_dedup", "packing"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        before = {r["doc_id"]: r for r in docs.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        text = {i: r["text"] for i, r in before.items()}
        if name == "language_id":
            want = {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(text):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
            want = set(first.values())
        elif name == "minhash_near_dedup":
            sets, root = {i: shingles(t) for i, t in text.items()}, {i: i for i in text}
            for i, j in itertools.combinations(sorted(sets), 2):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
            want = {i for i in root if root[i] == i}
        else:
            want = set(text)
            for i in sorted(text):
                spans = []
                for j in (j for j in text if j < i):
                    w = substring_dedup.word_hashes([text[i], text[j]])
                    x, y = (substring_dedup.shingles(w.hashes[w.bounds[k]:w.bounds[k + 1]], 5) for k in (0, 1))
                    spans += [(int(w.start[p]), int(w.end[q + 3])) for p, q, _ in substring_dedup.matching_spans(x, y, 46) if q + 4 - p >= 50]
                assert after[i]["text"] == substring_dedup.cut_spans(text[i], spans), i
                assert after[i]["n_chars"] == len(after[i]["text"])
            assert any(after[i]["text"] != text[i] for i in text)
        assert set(after) == want, name
        if name != "substring_dedup":
            assert all(after[i] == before[i] for i in want)
        kept[name] = len(want)
        out.write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
    assert len(set(kept.values())) >= 3                                    # the stages that drop rows do
    packed = stages["packing"](spark, docs, folder).collect()
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        parts = sorted((p["start"], p["length"], p["ids_crc32"]) for p in packed if p["doc_id"] == r["doc_id"])
        assert sum(n for _, n, _ in parts) == len(ids)
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in parts)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, folder).select(*cols).collect()

    def ids_of(rows):
        out = {}
        for r in rows:
            out[r["doc_id"]] = out.get(r["doc_id"], 0) + r["length"]
        return out
    assert ids_of(whole) == ids_of(packed)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_toxicity_scores_recomputed(spark):
    rng = random.Random(8)
    slurs = ["gruntwort", "flobberhead", "zibzab"]
    docs, labels = [], []
    for i in range(500):
        toxic = i % 10 == 0
        text = words(rng, 30, "abcdefghij")
        if toxic:
            text += " you " + rng.choice(slurs) + " " + words(rng, 5, "abcdefghij")
        docs.append((i, text))
        labels.append((i, int(toxic)))
    docs += [(600, None), (601, ""), (602, "you grumtwort!"), (603, 'he said "gruntwort" once'), (604, docs[0][1])]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, lab).collect()}
    lexicon, b = toxicity.train(d.where(~toxicity.held_out()), lab.where(~toxicity.held_out()))

    class Plain:
        terms = lexicon.terms

        @staticmethod
        def match(word):
            if word in lexicon.terms:
                return word, 0
            if word in lexicon.known or len(word) <= 2:
                return None
            near = [(distance(word, t), t) for t in lexicon.terms]
            near = [(e, t) for e, t in near if e <= toxicity.allowed(t)]
            return min(near)[::-1] if near else None
    assert set(slurs) <= set(lexicon.terms)
    for i, text in docs:
        x = np.array(toxicity.features(text, Plain))
        score = 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))
        r = got[i]
        assert r["score"] == pytest.approx(score) and r["predicted"] == int(score >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i]["predicted"] for i, t in labels if t) and got[602]["predicted"] and not got[600]["predicted"]
    assert got[603]["score"] < got[602]["score"]
