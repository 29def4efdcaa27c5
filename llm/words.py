"""Vectorised word and shingle hashes of whole texts (NumPy, inside tasks).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; the letters
A-Z are lower-cased first.  Hashes are 64-bit, the same on every machine.
Texts are hashed slice by slice (``SLICE`` bytes, cut at white space), so
memory follows the number of words, not eight times the number of bytes.
Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLICE = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {"p": np.ones(1, _U), "i": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers derived from ``seed``."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_POW["p"]) < n:
        m = max(n, SLICE + 4096)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(m, base, dtype=_U)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["i"][:n]


@dataclass
class Words:
    """``hashes`` of all words; those of text ``i`` lie at
    ``bounds[i]:bounds[i + 1]``; ``start``/``end`` are byte positions inside
    their text (UTF-8)."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_hashes(texts: list[str | None]) -> Words:
    raw = [utf8(t) for t in texts]
    lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    doc_start = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8) if raw else np.zeros(0, np.uint8)
    hs, ss, es = [], [], []
    at, total = 0, len(data)
    while at < total:
        to = min(total, at + SLICE)
        while to < total and not _SPACE[data[to - 1]]:  # a slice ends in white space
            gap = np.flatnonzero(_SPACE[data[to:to + SLICE]])
            to = to + int(gap[0]) + 1 if len(gap) else min(total, to + SLICE)
        part = data[at:to]
        solid = ~_SPACE[part]
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            p, inv = powers(len(part))
            c = np.cumsum((_LOWER[part].astype(_U) + _U(1)) * p, dtype=_U)
            before = np.where(s > 0, c[s - 1], _U(0))
            hs.append(mix((c[e - 1] - before) * inv[s] + (e - s).astype(_U)))
            ss.append(s + at)
            es.append(e + at)
        at = to
    h = np.concatenate(hs) if hs else np.zeros(0, _U)
    s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    e = np.concatenate(es) if es else np.zeros(0, np.int64)
    bounds = np.searchsorted(s, doc_start)
    base = np.repeat(doc_start[:-1], np.diff(bounds))
    return Words(h, s - base, e - base, bounds)


_GRAM = constants(64, 11)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word shingles of one text, in order.  With fewer
    words the whole sequence is one shingle; without words there is none."""
    if len(h) == 0:
        return np.zeros(0, _U)
    if len(h) < n:
        return mix((h * constants(len(h), 11)).sum(dtype=_U, keepdims=True) + _U(len(h)))
    k = len(h) - n + 1
    acc = np.full(k, _U(n), dtype=_U)
    for i in range(n):
        acc += h[i:i + k] * _GRAM[i]
    return mix(acc)
