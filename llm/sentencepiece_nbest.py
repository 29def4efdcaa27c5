"""SentencePiece encoding and decoding with N-best segmentations (operator 3).

The pieces and scores come from a given model file.  A text is the lattice of
all ways to cover it with pieces; a character without a piece is covered by
its UTF-8 byte pieces.  N-best search: the forward Viterbi pass gives the best
score from the start to every place; those scores are exact heuristics for an
A-star search backward from the end, which therefore meets the segmentations
in order of score.  No place is expanded more than N times: later ways from it
to the end can't be in the N best, so memory and work follow the length.

No way leads across a place whose two characters stand side by side in no
piece, so the lattice falls apart there (at word boundaries, since U+2581 only
begins pieces, and mostly between letters and punctuation).  The parts are
searched whole, whatever their length; those of up to ``LONG`` characters are
kept in a bounded cache of two generations, and the best segmentations of the
text are the best sums over its parts, found by the same best-first search
over the parts' losses.

Decoding joins the pieces, turns U+2581 into spaces and drops the one space
put before the text.  U+2581 itself in a text is covered by byte
pieces, so every text comes back as it was (one that holds U+10FFFE, which is
no character, gets U+2581 in its place).

Defined cases: null counts as empty; an empty text has no piece and one
segmentation with score 0; ties go to the segmentation met first (longer last
pieces first); rows repeat; further columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import small_batches, text_slices

SPACE = "▁"
NBEST = 3
CACHE = 400_000
LONG = 256
TABLE = 8192
# a U+2581 of the text itself must not become a space: it is set aside as a
# character beyond Unicode's assigned ones, which only byte pieces cover
_OWN = "\U0010fffe"
_LOADED: dict = {}


class Pieces:
    """Vocabulary of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte, self.text = [-1] * 256, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and SPACE not in p.lstrip(SPACE):
                self.id[p], self.score[p] = i, sp.get_score(i)
                self.text[i] = p.replace(SPACE, " ").encode()
        self.byte_score = min(self.score.values()) - 10.0
        # trie of the pieces; a node holds its own piece's (score, ids) under ""
        self.root: dict = {}
        for p, i in self.id.items():
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (self.score[p], (i,))
        self.raw = [self.text.get(i, b"") for i in range(sp.get_piece_size())]
        # characters numbered, and the pairs that stand side by side in some piece
        chars = sorted({ord(c) for p in self.id for c in p})
        self.number = np.zeros(0x110000, np.int64)
        self.number[chars] = np.arange(1, len(chars) + 1)
        self.size = len(chars) + 1
        pairs = {(self.number[ord(x)] * self.size + self.number[ord(y)]) for p in self.id for x, y in zip(p, p[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.inside = None
        if self.size <= TABLE:
            self.inside = np.zeros(self.size * self.size, bool)
            self.inside[self.pairs] = True
        self.young: dict[int, dict[str, tuple]] = {}
        self.old: dict[int, dict[str, tuple]] = {}

    def parts(self, body: str) -> list[str]:
        """``body`` cut at the places that no piece spans."""
        k = self.number[np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)]
        code = k[:-1] * self.size + k[1:]
        if self.inside is not None:
            joined = self.inside[code]
        else:
            joined = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
        at = (np.flatnonzero(~joined) + 1).tolist()
        return [body[i:j] for i, j in zip([0, *at], [*at, len(body)])]

    def lattice(self, s: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For every end (start, score, ids) of the pieces that end there, and
        the best score from the start to it (forward Viterbi)."""
        n, chars, root = len(s), list(s), self.root
        into: list[list] = [[] for _ in range(n + 1)]
        best = [0.0] + [float("-inf")] * n
        for a in range(n):
            here, node, known = best[a], root, False
            for b in range(a + 1, n + 1):
                node = node.get(chars[b - 1])
                if node is None:
                    break
                got = node.get("")
                if got is not None:
                    sc, ids = got
                    known |= b == a + 1
                    into[b].append((a, sc, ids))
                    if here + sc > best[b]:
                        best[b] = here + sc
            if not known:
                raw = (SPACE if chars[a] == _OWN else chars[a]).encode("utf-8", "surrogatepass")
                sc = self.byte_score * len(raw)
                into[a + 1].append((a, sc, tuple(self.byte[x] for x in raw)))
                if here + sc > best[a + 1]:
                    best[a + 1] = here + sc
        return into, best

    def edges(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        return self.lattice(s)[0]

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of ``s``, best first."""
        into, best = self.lattice(s)
        push, pop = heapq.heappush, heapq.heappop
        out, order = [], 0
        left = [n] * (len(s) + 1)
        heap = [(-best[len(s)], 0, len(s), 0.0, None)]
        while heap and len(out) < n:
            _, _, at, back, path = pop(heap)
            if not left[at]:
                continue
            left[at] -= 1
            if at == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((back, tuple(ids)))
                continue
            for a, sc, ids in into[at]:
                order += 1
                push(heap, (-(best[a] + sc + back), order, a, sc + back, (ids, path)))
        return out

    def part(self, s: str, n: int) -> tuple:
        """Scores and ids (bytes) of the ``n`` best segmentations of a part and
        the loss from the first to the second: ``(score, ids, loss, scores, all_ids)``."""
        old = self.old.get(n, {})
        got = old.get(s)
        if got is None:
            best = self.nbest(s, n)
            scores = tuple([sc for sc, _ in best])
            ids = tuple([array("I", x).tobytes() for _, x in best])
            got = (scores[0], ids[0], scores[0] - scores[1] if len(best) > 1 else float("inf"), scores, ids)
        if len(s) <= LONG:
            young = self.young.setdefault(n, {})
            if len(young) >= CACHE:      # what was not met since the last turn is forgotten
                self.old[n], self.young[n] = young, {}
                young = self.young[n]
            young[s] = got
        return got


def best_sums(found: list[tuple], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The ``n`` largest sums of one score from each part, with the (part,
    place) of the choices that aren't a part's first; best-first over the
    losses against the best choice."""
    total = sum([f[0] for f in found])
    losses = np.array([f[2] for f in found])
    order = np.argpartition(losses, n - 1)[:n] if len(losses) > n else np.arange(len(losses))
    order = order[np.lexsort((order, losses[order]))].tolist()
    lists = [i for i in order if len(found[i][3]) > 1]  # only parts with the least losses can be in the n best
    seen, out = {()}, []
    heap: list[tuple[float, tuple]] = [(0.0, ())]
    while heap and len(out) < n:
        loss, moved = heapq.heappop(heap)
        out.append((total - loss, moved))
        state = dict(moved)
        for i in lists:
            k, scores = state.get(i, 0) + 1, found[i][3]
            if k < len(scores):
                new = tuple(sorted({**state, i: k}.items()))
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (loss + scores[k - 1] - scores[k], new))
    return out


def pieces_of(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
        gc.freeze()  # the trie stays; the collector needn't walk it
    return _LOADED[path]


def _search(text: str, p: Pieces, n: int) -> tuple[list[tuple], list[tuple]]:
    body = SPACE + text.replace(SPACE, _OWN).replace(" ", SPACE)
    young, part = p.young.setdefault(n, {}), p.part
    get = young.get
    found = [get(s) or part(s, n) for s in p.parts(body)]
    return found, best_sums(found, n)


def encode(text: str | None, path: str, n: int = NBEST) -> list[tuple[float, np.ndarray]]:
    """``(score, ids)`` of the ``n`` best segmentations, best first."""
    p = pieces_of(path)
    if not text:
        return [(0.0, np.zeros(0, dtype="<u4"))]
    found, best = _search(text, p, n)
    first = [f[1] for f in found]
    out = []
    for sc, moved in best:
        ids = first
        if moved:
            ids = first.copy()
            for i, k in moved:
                ids[i] = found[i][4][k]
        out.append((sc, np.frombuffer(b"".join(ids), dtype="<u4")))
    return out


def decode(ids, path: str) -> str:
    raw = pieces_of(path).raw
    return b"".join(map(raw.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "surrogatepass")[1:]


def describe(text: str | None, path: str, n: int = NBEST) -> tuple:
    """Pieces and CRC-32 of the best segmentation, scores and sizes of the
    ``n`` best, whether all decode to the text.  The others differ from the best
    in single parts: where these decode alike, so do the texts."""
    p = pieces_of(path)
    if not text:
        return 0, zlib.crc32(b""), 0.0, [0.0], [0], True
    found, best = _search(text, p, n)
    raw, whole = p.raw, b"".join([f[1] for f in found])
    size = len(whole) // 4

    def said(ids: bytes) -> bytes:
        return b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    fine = said(whole).decode("utf-8", "surrogatepass")[1:] == text
    sizes = []
    for _, moved in best:
        sizes.append(size + sum((len(found[i][4][k]) - len(found[i][1])) // 4 for i, k in moved))
        fine = fine and all(said(found[i][4][k]) == said(found[i][1]) for i, k in moved)
    return size, zlib.crc32(whole), best[0][0], [sc for sc, _ in best], sizes, fine


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, score double, nbest_scores array<double>, nbest_pieces array<long>, round_trip boolean"


def _run(path: str, n: int):
    def run(batches):
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"]
            rows = []
            for a, b in text_slices(texts):
                rows.extend([describe(t, path, n) for t in texts[a:b]])
            out = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "score", "nbest_scores", "nbest_pieces", "round_trip"])
            out.insert(0, "doc_id", ids.astype("Int64").to_numpy())
            yield out
    return run


def nbest_segmentations(docs: DataFrame, path: str, n: int = NBEST) -> DataFrame:
    """One row a document: pieces and CRC-32 of the best segmentation, the
    scores and sizes of the ``n`` best, and whether all decode to the text."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_run(path, n), SCHEMA)
