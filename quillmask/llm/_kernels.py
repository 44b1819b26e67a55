"""Vectorised text kernels: words, rolling hashes and shingles of a batch.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  Hashes
are the same in every process: they depend on the bytes and on constants here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), on a copy."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if not len(x):
        return x
    s = np.sort(x)
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


#: Values of the bytes, for two hashes of words.
_BYTES = [mix(np.arange(1, 257, dtype=U) * U(a)) for a in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = {"p": _powers(_BASE, 1 << 16), "i": _powers(_INV, 1 << 16)}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        size = max(n, 2 * len(_POW["p"]))
        _POW["p"], _POW["i"] = _powers(_BASE, size), _powers(_INV, size)
    return _POW["p"][:n], _POW["i"]


class Words:
    """The words of some texts: ``hash``, byte ``start`` and ``end`` in ``buf``,
    and ``first[d]:first[d + 1]``, the words of text d."""

    __slots__ = ("buf", "start", "end", "hash", "first", "origin")

    def __init__(self, texts: list[bytes], lower: bool = False, hashed: bool = True, salt: int = 0):
        raw = b" ".join(texts) + b" "
        buf = np.frombuffer(raw, dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        solid = np.empty(len(buf) + 1, dtype=bool)
        solid[0] = False
        np.logical_not(_SPACE[buf], out=solid[1:])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.origin = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.origin[1:])
        self.first = np.searchsorted(self.start, self.origin)
        self.hash = None
        if hashed:
            p, inv = _upto(len(buf))
            acc = np.zeros(len(buf) + 1, dtype=U)
            np.cumsum(_BYTES[salt][buf] * p, out=acc[1:])
            self.hash = mix((acc[self.end] - acc[self.start]) * inv[self.start] + (self.end - self.start).astype(U))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k neighbouring words, order-sensitive."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    acc = np.full(n, U(seed * 2 + 1))
    for j in range(k):
        acc *= U(0xD1342543DE82EF95)
        acc += hashes[j : j + n]
        acc ^= acc >> U(29)
    return mix(acc)


def pieces(ids: list, texts: list[str | None], limit: int = 1 << 21) -> Iterator[tuple[list, list[bytes]]]:
    """Cuts a batch into runs of whole texts of about ``limit`` bytes."""
    some: list[bytes] = []
    keys: list = []
    size = 0
    for i, t in zip(ids, texts, strict=True):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if some and size + len(b) > limit:
            yield keys, some
            some, keys, size = [], [], 0
        some.append(b)
        keys.append(i)
        size += len(b) + 1
    if some:
        yield keys, some


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text, sorted; a text of fewer words
    has its whole sequence as one, a text without words none."""
    w = Words(texts, lower=True)
    every = windows(w.hash, k)
    out = []
    for d in range(len(texts)):
        a, b = w.first[d], w.first[d + 1]
        if b - a >= k:
            out.append(distinct(every[a : b - k + 1]))
        elif b > a:
            out.append(windows(w.hash[a:b], int(b - a), seed=int(b - a)))
        else:
            out.append(np.empty(0, dtype=U))
    return out
