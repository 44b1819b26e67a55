"""Packing of token sequences by non-negative least squares (operator 6).

1. One Arrow pass makes each document's ids.  Its full windows are cut off and
   digested there; of the rest, shorter than a window, the ids are kept.
2. The histogram of the rests' lengths, at most ``window - 1`` counts, goes to the
   driver.  Shallow combinations of two or three lengths that fill a window are
   enumerated, and how often to repeat each is solved against the histogram by
   non-negative least squares (coordinate descent).
3. Documents are dealt by a hash of their id, rest and row number to shards of about ``shard_docs``, so rows
   that are alike do not share one.  A shard rounds its
   share of the repeats, bounded by the lengths it has, and fills windows so.
4. What is left packs greedily: longest first, then the longest that still fits; where
   none fits, one is cut to fill the window.  A shard's last, unfilled window is cut
   at powers of two, which need no padding.

Each id lies in exactly one piece, and no window of ``window`` ids has padding.

A null text counts as empty and has the closing id alone.  Repeated rows and null ids
are rows of their own.  Ties of length are broken by the order of ``doc_id``, tail and row number.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm._store import Workspace

_MAKERS: dict = {}


def _maker(path: str):
    if path not in _MAKERS:
        from quillmask.llm._tokens import TokenIds

        _MAKERS[path] = TokenIds(path)
    return _MAKERS[path]


def _cutter(path: str, window: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _maker(path)
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            step = 512
            for a in range(0, len(texts), step):
                n, full, rest = [], [], []
                for ids in maker.ids(texts[a : a + step]):
                    ids = np.append(ids, np.uint32(closing)).astype("<u4")
                    n.append(len(ids))
                    whole = len(ids) // window
                    full.append([zlib.crc32(ids[j * window : (j + 1) * window].tobytes()) for j in range(whole)])
                    rest.append(ids[whole * window :].astype("<u2" if ids.max() < 65536 else "<u4"))
                wide = any(r.dtype.itemsize == 4 for r in rest)
                blobs = [r.astype("<u4").tobytes() if wide else r.tobytes() for r in rest]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, k), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(blobs, pa.binary()), pa.array([4 if wide else 2] * k, pa.int32()), pa.array(range(part + row, part + row + k), pa.int64())],
                    names=["doc_id", "doc_tokens", "full", "rest", "width", "row"],
                )
                row += k

    return run, "doc_id long, doc_tokens long, full array<long>, rest binary, width int, row long"


def combinations(window: int) -> np.ndarray:
    """All pairs and triples of lengths that fill a window, shortest first; 0 for no third."""
    a, b = np.meshgrid(np.arange(0, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    good = (a <= b) & (b <= c) & (c < window)
    return np.stack([a[good], b[good], c[good]], axis=1)


def solve_repeats(counts: np.ndarray, combos: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """x >= 0 that makes ``sum(x * lengths of combos)`` close to ``counts`` by least squares.

    Coordinate descent that always moves the steepest coordinate (Gauss-Southwell),
    never below zero; it ends in a sparse x, when no move is a quarter window or a ten-thousandth of
    all rests.  Should ``steps`` end first, it warns; the greedy part packs what is left either way.
    """
    left = np.append(counts.astype(float), 0.0)  # the last place stands for "no third length"
    at = np.where(combos > 0, combos, len(counts))
    norm = np.array([sum(row.count(n) ** 2 for n in set(row) if n) for row in combos.tolist()], dtype=float)
    x = np.zeros(len(combos))
    least = max(0.25, 1e-4 * counts.sum())
    for _ in range(steps if len(combos) else 0):
        slope = left[at].sum(axis=1) / norm
        slope = np.maximum(slope, -x)
        k = int(np.argmax(np.abs(slope) * np.sqrt(norm)))
        move = slope[k]
        if abs(move) < least:
            break
        x[k] += move
        np.subtract.at(left, at[k], move)
        left[-1] = 0.0
    else:
        if len(combos):
            warnings.warn(f"the repeats of combinations have not settled after {steps} steps", stacklevel=2)
    return x


class _Shard:
    """Fills windows from rests by length; ``put`` records pieces."""

    def __init__(self, window: int, lengths: np.ndarray):
        self.window = window
        self.left: dict[int, list[int]] = {}
        for i, n in enumerate(lengths.tolist()):
            if n:
                self.left.setdefault(n, []).append(i)
        self.pieces: list[tuple[int, int, int, int, int]] = []  # row, start in rest, length, sequence, offset
        self.sequence = 0

    def take(self, n: int) -> int:
        own = self.left[n]
        i = own.pop()
        if not own:
            del self.left[n]
        return i

    def combine(self, combos: np.ndarray, repeats: np.ndarray) -> None:
        for c, x in zip(combos.tolist(), repeats.tolist(), strict=True):
            for _ in range(x):
                need = {n: c.count(n) for n in c if n}
                if any(len(self.left.get(n, ())) < k for n, k in need.items()):
                    break
                at = 0
                for n in c:
                    if n:
                        self.pieces.append((self.take(n), 0, n, self.sequence, at))
                        at += n
                self.sequence += 1

    def greedy(self) -> None:
        lengths = sorted(self.left)
        at, open_ = 0, []
        cut: tuple[int, int, int] | None = None  # row, start, length: what is left of a cut rest
        while lengths or cut:
            room = self.window - at
            if cut:
                row, start, n = cut
                cut = None
            else:
                k = bisect.bisect_right(lengths, room)
                k = k - 1 if k else 0
                n = lengths[k]
                row, start = self.take(n), 0
                if n not in self.left:
                    del lengths[k]
            part = min(n, room)
            open_.append((row, start, part, at))
            at += part
            if part < n:
                cut = (row, start + part, n - part)
            if at == self.window:
                self.pieces += [(r, s, k, self.sequence, o) for r, s, k, o in open_]
                self.sequence += 1
                at, open_ = 0, []
        left = [(r, s, k) for r, s, k, _ in open_]
        size = 1 << 62
        while left:  # the last window: its length as a sum of powers of two
            total = sum(k for _, _, k in left)
            size = 1 << (total.bit_length() - 1)
            at, rest = 0, []
            for r, s, k in left:
                part = min(k, size - at)
                if part:
                    self.pieces.append((r, s, part, self.sequence, at))
                    at += part
                if part < k:
                    rest.append((r, s + part, k - part))
            self.sequence += 1
            left = rest


def _packer(window: int, combos: np.ndarray, share: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("rest", "ascending"), ("row", "ascending")])
        shard = table.column("shard")[0].as_py()
        ids, tokens = table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist()
        full, rest, width = (table.column(c).to_pylist() for c in ("full", "rest", "width"))
        size = np.array(tokens, dtype=np.int64) % window
        box = _Shard(window, size)
        repeats = np.floor(share * len(ids) + 0.5).astype(np.int64)
        some = repeats > 0
        box.combine(combos[some], repeats[some])
        box.greedy()
        out = []
        for row, start, n, seq, at in box.pieces:
            w = width[row]
            part = np.frombuffer(rest[row], dtype="<u2" if w == 2 else "<u4")[start : start + n].astype("<u4")
            out.append((ids[row], tokens[row] - int(size[row]) + start, n, zlib.crc32(part.tobytes()), tokens[row], (shard << 40) + seq, at))
        seq = box.sequence
        for row, crcs in enumerate(full):
            for j, crc in enumerate(crcs):
                out.append((ids[row], j * window, window, crc, tokens[row], (shard << 40) + seq, 0))
                seq += 1
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, closing: int = 0, shard_docs: int = 16384) -> DataFrame:
    """One row per piece of every document of ``docs``."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut, schema = _cutter(tokenizer, window, closing)
    cutted = work.settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema), "cut")
    counts = np.zeros(window, dtype=np.int64)
    for r in cutted.groupBy((F.col("doc_tokens") % window).cast("int").alias("n")).count().collect():
        counts[r["n"]] = r["count"]
    total = int(counts.sum())
    counts[0] = 0
    combos = combinations(window)
    x = solve_repeats(counts, combos)
    order = np.argsort(-x, kind="stable")
    order = order[: int((x > 0).sum())]
    shards = max(1, -(-total // shard_docs))
    run, schema = _packer(window, combos[order], x[order] / max(1, total))
    dealt = cutted.withColumn("shard", F.pmod(F.xxhash64("doc_id", "rest", "row"), F.lit(shards)))
    return dealt.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(run, schema)
