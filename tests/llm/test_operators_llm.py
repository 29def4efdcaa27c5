"""Operators of llm/ against brute force, round trips and edge cases."""

import itertools
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm import (chat, embedding_dedup, exact_dedup, language_id, minhash, packing, sentencepiece_nbest, sharding,
                 substring_dedup, toxicity)

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _len string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = words(rng, 70)
    base = words(rng, 120)
    texts += [base + " " + words(rng, 1) for _ in range(30)]          # near copies
    texts += [texts[3], texts[3].upper(), "  ".join(texts[3].split(" "))]  # copies
    texts += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(3)]
    texts += [None, "", " \n\t", "x", "<s>[INST] a", "é▁ü  ß"]
    return [(i, t, "en" if i % 2 else None, "s0" if i % 3 else None, 1, "r", "l") for i, t in enumerate(texts)]


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [256, 8])
def test_minhash_equals_brute_force(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    monkeypatch.setattr(minhash, "BLOCK", 4 if block == 8 else 64)
    sets = [shingle_set(r[1], 4) for r in corpus]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, reach(len(sets), links)))}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_components(spark.createDataFrame(corpus, DOCS), 4).collect()}
    assert got == want


def test_minhash_keys_meet_within_the_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, 64)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.permutation(64)[:minhash.RADIUS]
        row[at] ^= 1
    assert (minhash.chunk_keys(a) == minhash.chunk_keys(b)).any(axis=1).all()


def test_exact_dedup(spark, corpus):
    df = spark.createDataFrame(corpus + [corpus[0]], DOCS)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in corpus + [corpus[0]]:
        groups.setdefault(norm(r[1]), []).append(r[0])
    got = exact_dedup.duplicate_flags(df).collect()
    assert len(got) == len(corpus) + 1
    for r in got:
        assert (r["keep_id"], r["group_size"]) == (min(groups[norm(r["text"])]), len(groups[norm(r["text"])]))
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(v) for v in groups.values())


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_dedup(df).count() == 0
    assert minhash.near_components(df).count() == 0
    assert substring_dedup.remove_passages(df).count() == 0
    assert packing.pack(df, BPE).count() == 0
    assert sharding.shard(df).count() == 0
    assert language_id.identify(df).count() == 0
    assert language_id.keep_identified(df).count() == 0
    assert toxicity.toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert sentencepiece_nbest.nbest_segmentations(df, SP).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_compact_windows_are_tree_nodes():
    rng = np.random.default_rng(3)
    x = rng.permutation(300).astype(np.uint64)
    left, centre, right = substring_dedup.compact_windows(x, 20)
    got = set(zip(left.tolist(), centre.tolist(), right.tolist()))
    want = set()
    for c in range(300):
        a, b = c, c
        while a > 0 and x[a - 1] > x[c]:
            a -= 1
        while b < 299 and x[b + 1] > x[c]:
            b += 1
        if b - a + 1 >= 20:
            want.add((a, c, b))
    assert got == want


def test_passages_are_cut_and_clean_documents_stay(spark, corpus):
    df = spark.createDataFrame([r for r in corpus if not 40 <= r[0] < 73], DOCS)
    before = {r["doc_id"]: r["text"] for r in df.collect()}
    after = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(df).collect()}
    hit = {73, 74, 75}
    assert {k for k in before if before[k] != after[k]} == hit - {73}
    assert all(len(after[k].split()) == 40 for k in hit - {73})


def test_packing_places_every_token_once(spark, corpus):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    texts = [r[1] for r in corpus] + ["a   b \n \n c <|endoftext|> d"]
    rows = [(i, x, None, f"s{i % 3}", 1, "", "") for i, x in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), BPE, length=64, window=256, quantum=16).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or s == max(by_seq)


def test_sharding_is_balanced_and_gapless(spark, corpus):
    rows = [(i, corpus[0][1] if i < 400 else f"text {i}", None, None, 1, "", "") for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 1000
    total = sum(r["size"] for r in got)
    for s in range(8):
        part = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) <= 2 * max(r["size"] for r in got)


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "~1 ~0", "<<SYS>>", None, "", "[/INST", "<s"]
    rows = [(1, i, ["user", "assistant", None, "<s>"][i % 4], t) for i, t in enumerate(hostile)]
    r = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(
        chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(x["role"], x["text"]) for x in r["t"]] == [(a or "", b or "") for _, _, a, b in rows]
    assert r["loss"] == "".join(b or "" for _, _, a, b in rows if a == "assistant")


def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 34 !", "en"), (3, "the that", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd).collect()}[2] == "und"


def test_levenshtein_trie_equals_distances():
    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]
    terms = {"idiot": 2.0, "scum": 1.0, "worthless": 3.0, "loser": 1.0}
    lex = toxicity.Lexicon(terms, {"losers"})
    rng = random.Random(2)
    tried = [w[:i] + c + w[i + k:] for w in terms for i in range(len(w)) for c in ("", "x", "ss", w[i]) for k in (0, 1, 2)]
    for w in tried + [words(rng, 1) for _ in range(200)]:
        near = [(dist(w, t), t) for t in terms if dist(w, t) <= toxicity.allowed(t)] if len(w) > 2 else []
        want = (min(near)[1], min(near)[0]) if near else None
        assert lex.match(w) == (None if w == "losers" else want), w


def test_quotation_scores_less():
    lex = toxicity.Lexicon({"idiot": 4.0}, set())
    assert toxicity.features('she said "idiot" again', lex)[0] < toxicity.features("you are an idiot again", lex)[0]


def test_nbest_segmentations(corpus):
    p = sentencepiece_nbest.pieces_of(SP)

    def all_ways(s):
        into = p.edges(s)
        ways = {0: [0.0]}
        for b in range(1, len(s) + 1):
            ways[b] = [x + sc for a, sc, _ in into[b] for x in ways.get(a, [])]
        return sorted(ways[len(s)], reverse=True)
    for s in ("▁the", "▁nation", "▁ﬀx"):
        want = all_ways(s)[:5]
        assert [x for x, _ in p.nbest(s, 5)][:len(want)] == pytest.approx(want)
    for r in corpus:
        for _, ids in sentencepiece_nbest.encode(r[1], SP):
            assert sentencepiece_nbest.decode(ids, SP) == (r[1] or "")


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 16))
    near = x[:40] + 0.02 * rng.normal(size=(40, 16))
    v = np.concatenate([x, near, x[:5]]).astype(np.float32)
    rows = [(i, [float(c) for c in r], 0) for i, r in enumerate(v)]
    rows += [(900, None, 0), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [], 1)]
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903))
    found = sum(got[i]["n_links"] for i in range(len(v)))
    assert found >= 0.9 * g.sum() and all(got[i]["n_links"] <= g[i].sum() for i in range(len(v)))


def test_embedding_recall_where_few_lists_are_probed(spark):
    """10,000 vectors, some 128 lists of which 16 are probed, links near the threshold."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(7000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=(3000, 24))
    noise -= (noise * x[:3000]).sum(axis=1)[:, None] * x[:3000]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cosine = rng.uniform(0.901, 0.95, 3000)[:, None]
    v = np.concatenate([x, cosine * x[:3000] + np.sqrt(1 - cosine ** 2) * noise]).astype(np.float32)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = np.array([(u @ row >= 0.9).sum() - 1 for row in u])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": [r.tolist() for r in v], "label": 0}))
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df).collect()}
    assert len(got) == 10_000 and embedding_dedup.PROBES <= 16 < 64
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum() and want.sum() >= 6000


def test_packing_ids_equal_the_tokenizers_ids():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    rng = random.Random(5)
    letters = [*"abcdefgh XYZ019.,!?'\n\t", "'s", "  ", "é", "中", "١", "́", "😀", "\x85", "\x1c"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" " * 100_000, "a" * 50_000, "x <|endoftext|> y", "\n" * 255 + "a", "", None, *t.get_vocab()]
    for text, ids in zip(texts, packing.encode(texts, BPE), strict=True):
        assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_compact_windows_of_texts_strung_together_cover_every_sub_sequence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        width = int(rng.integers(1, 6))
        ends = np.cumsum(rng.integers(width, 15, size=3))
        x = rng.integers(0, 6, size=ends[-1]).astype(np.uint64)
        spans = {int(c): (int(a), int(b)) for a, c, b in zip(*substring_dedup.compact_windows(x, width, ends))}
        for c, (a, b) in spans.items():
            assert b - a + 1 >= width and x[a:b + 1].min() == x[c]
        for start, end in zip([0, *ends[:-1]], ends):
            for a in range(start, end):
                for b in range(a + width, end + 1):
                    low = x[a:b].min()
                    assert any(x[c] == low and c in spans and spans[c][0] <= a and spans[c][1] >= b - 1 for c in range(a, b))


def test_passages_are_found_behind_earlier_documents_that_hold_a_part(spark):
    rng = random.Random(12)
    rows, want = [], set()
    for g in range(30):
        passage = words(rng, 60).split()
        parts = [passage[:44], passage[16:], passage[8:52]]  # under 50 words each
        for i, part in enumerate([*parts, passage, passage]):
            rows.append((10 * g + i, " ".join([words(rng, 40), *part, words(rng, 40)])))
        want.add((10 * g + 4, 10 * g + 3))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {(r["doc_id"], r["source_id"]) for r in got if r["start_word"] <= 40 and r["end_word"] >= 100}
    assert want <= whole


def test_run_hashes_tell_runs_and_their_order_apart():
    s = np.random.default_rng(4).integers(0, 1 << 60, 50).astype(np.uint64)
    for width in (1, 2, 5, 46):
        h = substring_dedup.run_hashes(np.concatenate([s, s]), width)
        assert len(h) == 101 - width and (h[:51 - width] == h[50:]).all() and len(set(h.tolist())) == 50
        assert width == 1 or not set(h.tolist()) & set(substring_dedup.run_hashes(s[::-1], width).tolist())


def test_every_tree_of_a_split_bucket_is_linked_with_its_lead():
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 1 << 16, (6, 64)).astype(np.uint16)
    sig[5], sig[2] = sig[1], sig[0]  # 1 and 5 are near but in different blocks, neither the first; 2 is near 0
    rows = pd.DataFrame({"key": 7, "block": [0, 0, 0, 1, 1, 1], "split": True, "lead": 10, "rep": np.arange(10, 16), "sig": [x.tobytes() for x in sig]})
    links = pd.concat(minhash._bucket_links(iter([rows])))
    assert len(set(reach(6, [(a - 10, b - 10) for a, b in zip(links["a"], links["b"])]))) == 1


def test_terms_of_few_toxic_texts_are_learned(spark):
    rng = random.Random(21)
    slurs = ["z" + "".join(rng.choices("ijklmnop", k=9)) for _ in range(100)]  # each in 1 % of the toxic texts
    rows, i = [], 0
    while len(rows) < 600:
        i += 1
        if zlib.crc32(str(i).encode()) % 4 != 2:
            bad = len(rows) % 2
            rows.append((i, words(rng, 20) + (" " + slurs[len(rows) // 2 % 100] if bad else ""), bad))
    lexicon, _ = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"),
                                spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert set(slurs) <= set(lexicon.terms)


def test_long_segments_are_searched_whole():
    p = sentencepiece_nbest.pieces_of(SP)

    def best_of(s, n):
        into = p.edges(s)
        ways = {0: [0.0]}
        for b in range(1, len(s) + 1):
            ways[b] = sorted((x + sc for a, sc, _ in into[b] for x in ways[a]), reverse=True)[:n]
        return ways[len(s)]
    rng = random.Random(3)
    for text in ("the" * 400, "".join(rng.choices("etaoinshr", k=3000)), "information" * 60, "a" * 2000, "one\ntwo\t" * 200):
        got = sentencepiece_nbest.encode(text, SP, 5)
        assert [x for x, _ in got] == pytest.approx(best_of("▁" + text, 5))
        assert all(sentencepiece_nbest.decode(ids, SP) == text for _, ids in got)
        assert len({ids.tobytes() for _, ids in got}) == 5


def test_every_labelled_language_is_learned(spark):
    rows = [(10 * k + i, f"{chr(0x4E00 + 3 * k) * 3} {chr(0x4E01 + 3 * k) * 4}", f"l{k:02}") for k in range(70) for i in range(4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == sorted({r[2] for r in rows}) and model["w"].shape[1] == 70


def near_passages(groups, holders=3):
    """Pairs of documents with near-equal passages of 70 words (two replaced)
    behind earlier documents that hold parts of them, all under 50 words."""
    rng = random.Random(11)
    rows, want, at = [], [], 0
    for _ in range(groups):
        passage = words(rng, 70).split()
        parts = [passage[:40], passage[15:55], passage[30:]][:holders]
        later = list(passage)
        for i in (10, 60):
            later[i] = words(rng, 1)
        for part in [*parts, passage, later]:
            rows.append((at, words(rng, 30) + " " + " ".join(part) + " " + words(rng, 30)))
            at += 1
        want.append((at - 1, at - 2))
    return rows, want


def test_near_equal_passages_are_found_behind_part_holders(spark):
    rows, want = near_passages(60)
    rng = random.Random(12)
    rows += [(len(rows) + i, words(rng, 90)) for i in range(20)]
    got = {(r["doc_id"], r["source_id"]) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want) & got) >= 54 and not got - set(want)


def test_passages_equal_brute_force_on_a_small_table(spark, corpus):
    """Every document that repeats a passage of an earlier one is reported, each
    reported span is confirmed by the texts, and no other document is."""
    near, _ = near_passages(6)
    rows = [(r[0], r[1]) for r in corpus] + [(1000 + i, t) for i, t in near]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    h = substring_dedup.word_hashes([t for _, t in rows])
    sh = {i: substring_dedup.shingles(h.hashes[h.bounds[n]:h.bounds[n + 1]], 5) for n, (i, _) in enumerate(rows)}
    spans = {}
    for i, j in itertools.permutations(sh, 2):
        if j < i and (s := [x for x in substring_dedup.matching_spans(sh[i], sh[j], 46) if x[1] + 4 - x[0] >= 50]):
            spans[i, j] = s
    assert {r["doc_id"] for r in got} == {i for i, _ in spans}
    for r in got:
        assert (r["start_word"], r["end_word"] - 4) in {(p, q) for p, q, _ in spans[r["doc_id"], r["source_id"]]}


def test_packing_fills_windows_to_the_target_shares(spark):
    rng = random.Random(13)
    rows = [(i, words(rng, 60), "ab"[i % 2] if i % 5 else "c") for i in range(400)]
    targets, window, quantum = {"a": 0.6, "b": 0.1}, 4096, 256
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(docs, BPE, length=512, window=window, quantum=quantum, targets=targets)
    pieces = spark.createDataFrame(pieces.collect(), pieces.schema)
    got = pieces.collect()
    for d in {r["doc_id"] for r in got}:                                   # every id once
        parts = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == d)
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(n for _, n in parts) == next(r["doc_tokens"] for r in got if r["doc_id"] == d)
    deficits = packing.window_deficits(pieces, targets, window).collect()
    size = {s: sum(r["length"] for r in got if r["source"] == s) for s in "abc"}
    weight = {"a": 0.6, "b": 0.1, "c": size["c"] / sum(size.values())}
    share = {s: w / sum(weight.values()) for s, w in weight.items()}
    assert all(abs(r["deficit"]) <= quantum for r in deficits)             # carried, within a quantum
    assert abs(sum(r["deficit"] for r in deficits if r["window"] == max(x["window"] for x in deficits))) < 1
    dry = min(size[s] / share[s] for s in share)                           # until a queue ends: the plain shares
    for r in deficits:
        if (r["window"] + 1) * window <= dry:
            assert r["due"] == pytest.approx(share[r["source"]] * window) and abs(r["served"] - r["due"]) <= 2 * quantum
    with pytest.raises(ValueError):
        packing.pack(docs, BPE, targets={"a": 0.0}).collect()


def test_written_tables_leave_no_shuffle_files(spark):
    from eventsurv.sources.materialize import Scratch, materialize

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return str(files.getAllFiles().mkString("\n")).count("/shuffle_")

    before, kept = spark.conf.get(name, None), shuffles()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    with Scratch(spark) as scratch:
        assert materialize(counts, "test-counts").count() == scratch.write(counts, "test-counts").count() == 7
        end = time.time() + 20
        while shuffles() > kept + 2 and time.time() < end:   # what the two counts themselves shuffle may stay
            time.sleep(0.2)
        assert shuffles() <= kept + 2 * 2 and spark.conf.get(name, None) == before


def test_lexicon_equals_counts_of_all_texts(spark, monkeypatch):
    """Words that a part of the clean texts rules out are those that all of them rule out."""
    rng = random.Random(5)
    vocabulary = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choices(vocabulary[:30] if bad else vocabulary[10 + i % 11:], k=6)), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    first = {}
    for _, t, y in rows:
        first[t] = max(first.get(t, 0), y)
    n = {w: [sum(w in t.split() for t, y in first.items() if y == c) for c in (0, 1)] for w in vocabulary}
    totals = [sum(y == c for y in first.values()) for c in (0, 1)]
    want = {w: x for w in vocabulary if (x := toxicity.selected(n[w], totals)) is not None}
    moved = []
    counts = toxicity.word_counts
    monkeypatch.setattr(toxicity, "word_counts", lambda texts, rows, keep: moved.append([w for w in vocabulary if keep(w)]) or counts(texts, rows, keep))
    lexicon, _ = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert lexicon.terms == pytest.approx(want) and want
    assert len(moved[2]) < len(moved[1])       # the words of all clean texts that are counted


def test_pairs_of_a_source_are_confirmed_in_parts(spark, monkeypatch):
    """A source of many pairs is dealt into parts; texts move by shuffles that go with their query, in no table of their own."""
    rng = random.Random(17)
    passage = words(rng, 70)
    rows = [(i, f"{words(rng, 30)} {passage} {words(rng, 30)}") for i in range(20)] + [(99, words(rng, 90)), (5, words(rng, 90))]
    monkeypatch.setattr(substring_dedup, "TOGETHER", 3)
    written = []
    write = substring_dedup.Scratch.write
    monkeypatch.setattr(substring_dedup.Scratch, "write", lambda self, df, name, *a: written.append(name) or write(self, df, name, *a))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["source_id"]) for r in found) == [(i, 0) for i in range(1, 20)]
    assert all(r["end_word"] - r["start_word"] >= 70 for r in found)
    assert "passage-texts" not in written and written.count("passage-keys") == 2
