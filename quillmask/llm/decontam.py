"""Benchmark passages in documents, up to an edit distance (operator 5).

Chakraborty, Goldenberg and Koucky, "Streaming Algorithms for Embedding and Computing
Edit Distance in the Low Distance Regime" (2016); Zhang and Zhang, "EmbedJoin" (2017).

Texts are words, ASCII-lower-cased.  An item of n words is in a document if some run of
words there is within ``floor((1 - similarity) * n)`` word edits of it.

1. q-gram lemma: such a run shares at least n - 1 - 2 * edits word pairs with the item, so a window
   of n words and the edits must hold so many pairs of items of n words.  This loses nothing and
   passes over most text; it does not say which item a window may hold.
2. Item-sized windows that are left go through CGK random walks, which map edit distance to Hamming
   distance.  ``repeats`` times, ``bits`` places of a walk are sampled for a key; windows and items of equal
   length and key share a bucket of a locality-sensitive hash table.  At half of the places equal, one key is equal
   with probability 0.5 ** bits.  Places are sampled from the first half of the steps, which few walks end in: of ended
   walks all keys would be equal.  Keys of one walk are not independent, so recall is measured: see the tests.
3. Windows and items of one bucket are confirmed by exact edit distance.

Items are broadcast in blocks of at most ``block_octets`` of text, one pass over the documents for each block,
whose number follows from the items' size; a block's findings are written before the next block is sent.

An item of fewer than ``min_words`` words is too short to search for: any text on its subject has it.  It is found
where it is the whole text of a document.  Null and empty items are found nowhere.
Null and empty documents hold nothing.  A row per document and item: with rows that
repeat a ``doc_id`` the pair with the least distance, then the earliest start.  Items
of one text give a pair each.  Null ids of either side are left out.  Other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm import _kernels as K
from quillmask.llm._store import Workspace

U = np.uint64
PAD = U(0x13198A2E03707344)


def within(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to a prefix of ``text``, and that prefix's length, if at most ``most``."""
    n = len(item)
    big = most + 1
    row = [min(j, big) for j in range(len(text) + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(len(text), i + most)
        new = [big] * (len(text) + 1)
        if i <= most:
            new[0] = i
        c = item[i - 1]
        least = new[0]
        for j in range(lo, hi + 1):
            d = row[j - 1] + (text[j - 1] != c)
            if row[j] + 1 < d:
                d = row[j] + 1
            if new[j - 1] + 1 < d:
                d = new[j - 1] + 1
            new[j] = d
            if d < least:
                least = d
        if least > most:
            return None
        row = new
    best = min(row)
    return (best, row.index(best)) if best <= most else None


def embed(seqs: np.ndarray, walks: int) -> np.ndarray:
    """CGK walks of the rows of ``seqs`` (m, n): (walks, m, 3n) symbols, padded when a row has ended."""
    m, n = seqs.shape
    wide = np.concatenate([seqs, np.full((m, 1), PAD)], axis=1)
    out = np.empty((3 * n, walks, m), dtype=U)
    at, rows = np.zeros((walks, m), dtype=np.int64), np.arange(m)
    seeds = K.mix(np.arange(1, 3 * n * walks + 1, dtype=U) * U(0x9E3779B97F4A7C15)).reshape(3 * n, walks, 1)
    for t in range(3 * n):
        symbol = wide[rows, at]
        out[t] = symbol
        at += ((symbol ^ seeds[t]) * U(0xD6E8FEB86659FD93) >> U(63)).astype(np.int64)
        np.minimum(at, n, out=at)
    return out.transpose(1, 2, 0)


class Items:
    """Searchable items of one block."""

    def __init__(self, rows: list[tuple[int, bytes]], similarity: float, min_words: int, bits: int, repeats: int):
        self.bits, self.repeats, self.min_words = bits, repeats, min_words
        by_words: dict[tuple[int, ...], list[int]] = defaultdict(list)
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        if rows:
            w = K.Words([t for _, t in rows], lower=True)
            for (i, _), a, b in zip(rows, w.first[:-1], w.first[1:], strict=True):
                if b > a:
                    (by_words if b - a >= min_words else self.short)[tuple(w.hash[a:b].tolist())].append(i)
        self.words = list(by_words)
        self.ids = [sorted(set(v)) for v in by_words.values()]
        self.size = np.array([len(x) for x in self.words], dtype=np.int64)
        self.lengths = np.unique(self.size)
        self.edits = ((1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        self.need = np.maximum(1, self.lengths - 1 - 2 * self.edits)
        own = [K.distinct(K.windows(np.array(x, dtype=U), 2)) for x in self.words]
        values = np.concatenate(own) if own else np.empty(0, dtype=U)
        self.pairs = K.distinct(values)
        #: Which pairs the items of each length have.
        self.has = np.zeros((len(self.lengths), len(self.pairs)), dtype=bool)
        if own:
            self.has[np.searchsorted(self.lengths, np.repeat(self.size, [len(x) for x in own])), np.searchsorted(self.pairs, values)] = True
        self.bitmap = np.zeros(1 << 22, dtype=bool)
        self.bitmap[(self.pairs >> U(42)).astype(np.int64)] = True
        #: Of each length the buckets: keys in order, and the item of each.
        self.buckets: list[tuple[np.ndarray, np.ndarray]] = []
        for n in self.lengths.tolist():
            same = np.flatnonzero(self.size == n)
            keys = self.keys(np.array([self.words[k] for k in same.tolist()], dtype=U))
            order = np.argsort(keys, axis=None, kind="stable")
            self.buckets.append((keys.ravel()[order], np.repeat(same, keys.shape[1])[order]))

    def keys(self, seqs: np.ndarray, walks: int = 8) -> np.ndarray:
        """(m, repeats) keys of windows of one length."""
        m, n = seqs.shape
        rng = np.random.default_rng(n)
        out = []
        per = -(-self.repeats // walks)
        for s, e in enumerate(embed(seqs, walks)):
            for r in range(per):
                key = np.full(m, U(s * per + r + 1))
                for place in rng.integers(0, 3 * n // 2, self.bits):
                    key = K.mix(key * U(0xD1342543DE82EF95) + e[:, place])
                out.append(key)
        return np.stack(out, axis=1)

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item id, first word, words, distance)``, at most one for each text and item."""
        if not self.words and not self.short:
            return
        w = K.Words(texts, lower=True)
        if self.short:
            for d in np.flatnonzero(np.diff(w.first) < self.min_words).tolist():
                words = w.hash[w.first[d] : w.first[d + 1]]
                for i in sorted(set(self.short.get(tuple(words.tolist()), ()))):
                    yield d, i, 0, len(words), 0
        if len(w.hash) < 2 or not self.words:
            return
        pair = K.windows(w.hash, 2)
        hit = np.flatnonzero(self.bitmap[(pair >> U(42)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.pairs, pair[hit]), len(self.pairs) - 1)
        true = self.pairs[which] == pair[hit]
        text = np.searchsorted(w.first, hit, side="right") - 1
        true &= hit + 1 < w.first[text + 1]  # no pair across two texts
        hit, which, text = hit[true], which[true], text[true]
        for c, n in enumerate(self.lengths.tolist()):
            own = self.has[c][which]
            if int(own.sum()) >= self.need[c]:
                starts, owner = self._starts(hit[own], text[own], int(self.need[c]), n + int(self.edits[c]), w.first)
                if len(starts):
                    yield from self._confirm(w, c, starts, owner)

    @staticmethod
    def _starts(place: np.ndarray, text: np.ndarray, need: int, reach: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``reach`` words with ``need`` pairs may start, and their texts."""
        a, b = place[: len(place) - need + 1], place[need - 1 :]
        good = (b - a <= reach - 2) & (text[: len(a)] == text[need - 1 :])
        a, b, text = a[good], b[good], text[: len(good)][good]
        lo = np.maximum(b + 2 - reach, first[text])
        n = a - lo + 1
        starts = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        starts, at = np.unique(starts, return_index=True)
        return starts, np.repeat(text, n)[at]

    def _confirm(self, w, c: int, starts: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Windows of one length: their keys, the items of their buckets, and the distances to these."""
        n, edits = int(self.lengths[c]), int(self.edits[c])
        held, item_of = self.buckets[c]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a in range(0, len(starts), 4096):
            at, own = starts[a : a + 4096], text[a : a + 4096]
            place = at[:, None] + np.arange(n)
            seqs = np.where(place < w.first[own + 1][:, None], w.hash[np.minimum(place, len(w.hash) - 1)], PAD)
            mark = own.astype(U)
            for j in range(n):
                mark = K.mix(mark * U(0xD1342543DE82EF95) + seqs[:, j])
            fresh = np.sort(np.unique(mark, return_index=True)[1])  # of equal windows in one text, the first
            keys = self.keys(seqs[fresh])
            lo, hi = np.searchsorted(held, keys, side="left"), np.searchsorted(held, keys, side="right")
            count = (hi - lo).ravel()
            if not count.any():
                continue
            window = np.repeat(np.repeat(fresh, keys.shape[1]), count)
            item = item_of[np.repeat(lo.ravel() - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            both, votes = np.unique(np.stack([window, item]), axis=1, return_counts=True)
            for j in np.argsort(-votes, kind="stable").tolist():  # likeliest first: the others need to do better
                i, k = int(both[0, j]), int(both[1, j])
                d, s = int(own[i]), int(at[i])
                limit = best[d, k][0] - 1 if (d, k) in best else edits
                if limit < 0:
                    continue
                got = within(list(self.words[k]), w.hash[s : min(s + n + edits, int(w.first[d + 1]))].tolist(), limit)
                if got:
                    best[d, k] = (got[0], s - int(w.first[d]), got[1])
        for (d, k), (distance, start, words) in best.items():
            for i in self.ids[k]:
                yield d, i, start, words, distance


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            out = []
            for ids, texts in K.pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(ids[d], i, s, n, e) for d, i, s, n, e in items.find(texts)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start_word", "n_words", "distance"])

    return run, "doc_id long, item_id long, start_word long, n_words long, distance long"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 5, bits: int = 2, repeats: int = 32, block_octets: int = 2_000_000
) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance``: each item in each document that holds it."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_octets))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    work = Workspace(spark, "decontam")
    found = None
    for b in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        held = spark.sparkContext.broadcast(Items([(r.item_id, r.text.encode("utf-8", "surrogatepass")) for r in some], similarity, min_words, bits, repeats))
        run, schema = _searcher(held)
        part = texts.mapInArrow(run, schema)
        if blocks > 1:
            part = work.settle(part, f"block{b}")
            held.destroy()
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct("distance", "start_word", "n_words")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.start_word", "m.n_words", "m.distance")
