"""Removal of word windows that an earlier document has (operator 8).

Method: a count-min prefilter, of any size, whose slices stay with their owner tasks.

0. Documents are dealt in place into units of about ``unit_octets`` of text and written once, in
   buckets of the unit, so that no later step has to deal texts again.
1. A unit's partition sketch is, for each of ``depth`` rows, the cells of its documents' distinct windows of
   ``width`` words, gap-coded and cut into slices.  A slice's owner task merges the sketches of all units to counts that say
   "none, one, or more", and answers each unit which of its cells were counted twice or more.  Estimates can be too high,
   never too low.  A row has more cells than the corpus can have windows four times over (see ``sketch_bits``), so the share
   of unique windows that pass as repeated does not grow with the input: see ``expected_passing``.
2. Each unit meets its answers.  Windows that are estimated repeated, and no others, go to the
   tasks that group them exactly by a 96-bit hash of two independent word hashes, losing none.  A unit sends at most one document
   per window (the one of the least ``doc_id``); its others are decided where they are, so
   a passage that a third of all documents share costs its group one entry a unit.
3. Each unit meets its removed windows.  Texts that lose no words are read in place like the others; none is dealt.

The driver sees the sum of text lengths and nothing else; nothing is broadcast.  A task holds a slice of
counts, a unit, or a part of the windows (about ``part_octets`` of text).  Units of 6 MB and slices of 8 MB grow with the
input, to 128 MB each at 100 TB, so that a unit and a slice share some 30 windows at least: see ``sizes``.

A word is covered if a window over it also starts in a document with a smaller
``doc_id``; covered words are removed, judged on the input.  Null and empty texts
have no words.  Rows that repeat a ``doc_id`` are judged against smaller ids only,
each by its own text; rows that repeat id and text are alike.  Rows with a null ``doc_id`` are
returned whole and do not count for others.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm import _kernels as K
from quillmask.llm._store import Workspace

U = np.uint64


def sketch_bits(octets: int, least: int = 16) -> int:
    """Cells of a row, as a power of two: 2/3 of the text's bytes or more.

    Words and blanks take two bytes at least, so there are half as many windows as bytes at most, and about a
    seventh in prose: a load of 0.75 at worst and of 0.1 to 0.2 in prose, at every size.
    """
    return max(least, math.ceil(math.log2(max(2, octets * 2 / 3))))


def sizes(bits: int) -> tuple[int, int]:
    """Cells of a slice, as a power of two, and bytes of a unit: a unit and a slice share 32 windows or more, up to 2 ** 19 slices."""
    slice_bits = min(27, max(23, bits - 18))
    return slice_bits, min(128_000_000, max(6_000_000, int(32 * 7.6) << max(0, bits - slice_bits)))


def expected_passing(windows: float, bits: int, depth: int = 2) -> float:
    """The share of unique windows that is estimated repeated, with ``windows`` distinct ones in the corpus."""
    return (1 - math.exp(-windows / 2.0**bits)) ** depth


def gap_code(cells: np.ndarray) -> bytes:
    """Sorted distinct cells as gaps, in bytes of seven bits; the eighth says that more follow."""
    if not len(cells):
        return b""
    gaps = np.diff(cells.astype(np.int64), prepend=-1)
    n = np.ones(len(gaps), dtype=np.int64)
    for k in range(1, 9):
        n += gaps >= 1 << 7 * k
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), dtype=np.uint8)
    for k in range(int(n.max())):
        at = n > k
        out[first[at] + k] = (gaps[at] >> 7 * k & 127) | (n[at] > k + 1) * 128
    return out.tobytes()


def gap_decode(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.int64)
    last = b < 128
    first = np.flatnonzero(np.concatenate(([True], last[:-1])))
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.cumsum(np.add.reduceat((b & 127).astype(np.int64) << 7 * place, first)) - 1


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (K.mix(h ^ U(0x2545F4914F6CDD1D * (row + 1) & (1 << 64) - 1)) if row else h) >> U(64 - bits)


def _unit_maker(unit_octets: int):
    """Adds the unit: of each task's rows, in order, runs of about so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = seen + np.cumsum(size)
            seen = int(upto[-1]) if len(upto) else seen
            unit = part + (upto - size) // unit_octets
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit, pa.int64())], names=[*batch.schema.names, "unit"])

    return run, "doc_id long, text string, row_key long, unit long"


def _windows_of(w: K.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts: hashes, start words, and which text."""
    every = K.windows(w.hash, width)
    starts = np.arange(len(every))
    doc = np.searchsorted(w.first, starts, side="right") - 1
    inside = starts + width <= w.first[doc + 1]
    return every[inside], starts[inside], doc[inside]


def _sketcher(width: int, depth: int, bits: int, slice_bits: int):
    """Units to ``row, slice, unit, once, twice``: cells of one document or more, and of several."""

    def emit(unit: int, held: list[np.ndarray]):
        h = np.concatenate(held)
        rows, slices, once, twice = [], [], [], []
        step = min(slice_bits, bits)
        for r in range(depth):
            c = np.sort(_cells(h, r, bits))
            at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            n = np.diff(np.append(at, len(c)))
            c = c[at]
            own = (c >> U(step)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                cells = c[a:b] - U(int(own[a]) << step)
                rows.append(r)
                slices.append(int(own[a]))
                once.append(gap_code(cells))
                twice.append(gap_code(cells[n[a:b] > 1]))
        columns = [pa.array(rows, pa.int32()), pa.array(slices, pa.int64()), pa.array([unit] * len(rows), pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["row", "slice", "unit", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = [], None
        for batch in batches:
            units = batch.column(2).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True]))) if len(units) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if units[a] != unit and held:
                    yield emit(unit, held)
                    held = []
                unit = int(units[a])
                for _, texts in K.pieces(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()):
                    h, _, doc = _windows_of(K.Words(texts), width)
                    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))) if len(doc) else []
                    held += [K.distinct(h[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        if held:
            yield emit(unit, held)

    return run, "row int, slice long, unit long, once binary, twice binary"


def _merger(bits: int, slice_bits: int):
    """Sorted by slice, all units' cells of it are counted; each unit gets those of its own that count twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def answers():
            count = np.zeros(1 << min(slice_bits, bits), dtype=np.uint8)
            for _, once, twice in held:
                for blob in (once, twice):
                    c = gap_decode(blob)
                    count[c] = np.minimum(count[c] + 1, 2)
            out = []
            for unit, once, _ in held:
                c = gap_decode(once)
                c = c[count[c] > 1]
                if len(c):
                    out.append((unit, gap_code(c)))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([at[0]] * len(out), pa.int32()), pa.array([at[1]] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["unit", "row", "slice", "cells"])

        for batch in batches:
            for r, s, *own in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if (r, s) != at:
                    if held:
                        yield answers()
                    held, at = [], (r, s)
                held.append(own)
        if held:
            yield answers()

    return run, "unit long, row int, slice long, cells binary"


class Answers:
    """Of one unit the cells that were counted twice or more."""

    def __init__(self, table: pa.Table, depth: int, bits: int, slice_bits: int):
        self.bits = bits
        step = min(slice_bits, bits)
        own: list[list[np.ndarray]] = [[] for _ in range(depth)]
        table = table.sort_by([("row", "ascending"), ("slice", "ascending")])
        for r, s, blob in zip(*[table.column(c).to_pylist() for c in ("row", "slice", "cells")], strict=True):
            own[r].append(gap_decode(blob).astype(U) + U(s << step))
        # a unit that was read in two parts has two answers for a slice
        self.cells = [np.unique(np.concatenate(x)) if x else np.empty(0, dtype=U) for x in own]

    def estimated_repeated(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for r, cells in enumerate(self.cells):
            at = np.flatnonzero(out)
            if not len(cells):
                return np.zeros(len(h), dtype=bool)
            c = _cells(h[at], r, self.bits)
            out[at] = cells[np.minimum(np.searchsorted(cells, c), len(cells) - 1)] == c
        return out


#: A run of windows of one part and unit: documents by their place in ``doc_id``; without hashes, removed windows.
_ENTRY = "part int, unit long, doc_id binary, row_key binary, n binary, hash binary, check binary, pos binary"


def _group_bounds(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by (hash, check), and where each group begins."""
    order = np.argsort(h, kind="stable")
    hs, cs = h[order], c[order]
    same = hs[1:] == hs[:-1]
    if np.any(same & (cs[1:] != cs[:-1])):
        order = np.lexsort((c, h))
        hs, cs = h[order], c[order]
        same = hs[1:] == hs[:-1]
    same &= cs[1:] == cs[:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~same)))


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return first, np.diff(np.append(first, len(doc)))


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(doc)))


def _check_hash(texts: list[bytes], width: int, starts: np.ndarray) -> np.ndarray:
    """32 bits of windows whose word hashes do not follow from the other ones."""
    return (K.windows(K.Words(texts, salt=1).hash, width, seed=77)[starts] >> U(32)).astype(np.uint32)


def _sender(width: int, depth: int, bits: int, slice_bits: int, parts: int):
    """A unit and its answers to entries of the windows that are estimated repeated."""

    def run(unit: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("unit", pa.int64()), *[(c, pa.binary()) for c in ("doc_id", "row_key", "n", "hash", "check", "pos")]])
        if not unit.num_rows or not answers.num_rows:
            return schema.empty_table()
        sketch = Answers(answers, depth, bits, slice_bits)
        unit = unit.filter(pc.is_valid(unit.column("doc_id")))
        name = answers.column("unit")[0].as_py()
        ids, keys = (unit.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "row_key"))
        docs, hs, cs, ps = [], [], [], []
        for rows, texts in K.pieces(list(range(len(ids))), unit.column("text").to_pylist()):
            w = K.Words(texts)
            h, starts, doc = _windows_of(w, width)
            good = sketch.estimated_repeated(h) if len(h) else np.empty(0, dtype=bool)
            if good.any():
                h, starts, doc = h[good], starts[good], doc[good]
                docs.append((doc + rows[0]).astype(np.int32))
                hs.append(h)
                cs.append(_check_hash(texts, width, starts))
                ps.append((starts - w.first[doc]).astype(np.int32))
        if not docs:
            return schema.empty_table()
        doc, h, c, pos = (np.concatenate(x) for x in (docs, hs, cs, ps))
        order, first = _group_bounds(h, c)
        least = np.minimum.reduceat(ids[doc[order]], first)
        later = np.empty(len(h), dtype=bool)
        later[order] = ids[doc[order]] > np.repeat(least, np.diff(np.append(first, len(h))))
        out = []
        d, p = doc[later], pos[later]
        one, n = _runs(d)
        if len(one):
            out.append((name % parts, name, ids[d[one]].tobytes(), keys[d[one]].tobytes(), n.astype(np.int32).tobytes(), b"", b"", p.tobytes()))
        doc, h, c, pos = doc[~later], h[~later], c[~later], pos[~later]
        part = (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first, count = _runs(part[order])
        for a, k in zip(first.tolist(), count.tolist(), strict=True):
            at = order[a : a + k]
            one, n = _runs(doc[at])
            d = doc[at][one]
            out.append((int(part[at[0]]), name, ids[d].tobytes(), keys[d].tobytes(), n.astype(np.int32).tobytes(), h[at].tobytes(), c[at].tobytes(), pos[at].tobytes()))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run, _ENTRY


def _grouper():
    """Sorted by part, windows are grouped exactly; gives ``unit, doc_id, row_key, n, pos`` of removed ones, a row a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["unit", "doc_id", "row_key", "n", "pos"]

        def result(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=names)

        def group(held):
            unit = np.repeat([x[0] for x in held], [len(x[1]) // 8 for x in held]).astype(np.int64)
            id_, key, n, h, c, p = (np.concatenate([np.frombuffer(x[i + 1], dtype=t) for x in held]) for i, t in enumerate((np.int64, np.int64, np.int32, U, np.uint32, np.int32)))
            doc = np.repeat(np.arange(len(id_)), n)
            order, first = _group_bounds(h, c)
            own = id_[doc[order]]
            least = np.minimum.reduceat(own, first)
            gone = np.sort(order[own > np.repeat(least, np.diff(np.append(first, len(h))))])
            one, count = _runs(doc[gone])
            d = doc[gone[one]]
            edge, some = _runs(unit[d])
            ahead = np.append(0, np.cumsum(count))
            rows = []
            for a, k in zip(edge.tolist(), some.tolist(), strict=True):
                own = d[a : a + k]
                rows.append((int(unit[own[0]]), id_[own].tobytes(), key[own].tobytes(), count[a : a + k].astype(np.int32).tobytes(), p[gone[ahead[a] : ahead[a + k]]].tobytes()))
            return result(rows)

        held, at = [], None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            done = [i for i in range(batch.num_rows) if not cols[5][i]]
            if done:
                yield result([(cols[1][i], cols[2][i], cols[3][i], cols[4][i], cols[7][i]) for i in done])
            for i in range(batch.num_rows):
                if cols[5][i]:
                    if cols[0][i] != at and held:
                        yield group(held)
                        held = []
                    at = cols[0][i]
                    held.append([cols[k][i] for k in range(1, 8)])
        if held:
            yield group(held)

    return run, "unit long, doc_id binary, row_key binary, n binary, pos binary"


def kept_words(text: bytes, width: int, gone: list[bytes] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were; ``gone``: starts of removed windows."""
    words = text.split()
    if not gone:
        return words, len(words)
    start = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in gone])
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + width, -1)
    stay = np.cumsum(depth)[:-1] == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s], len(words)


def _finisher(width: int, with_text: bool):
    """A unit and its removed windows to the rows of the result."""

    def run(unit: pa.Table, removed: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list[bytes]] = {}
        for ids, keys, n, pos in zip(*[removed.column(c).to_pylist() for c in ("doc_id", "row_key", "n", "pos")], strict=True):
            ends = np.cumsum(np.frombuffer(n, dtype=np.int32)) * 4
            for i, k, a, b in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(keys, np.int64).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                gone.setdefault((i, k), []).append(pos[a:b])
        out = []
        for i, k, t in zip(*[unit.column(c).to_pylist() for c in ("doc_id", "row_key", "text")], strict=True):
            words, n = kept_words((t or "").encode("utf-8", "surrogatepass"), width, gone.get((i, k)))
            kept = b" ".join(words)
            out.append((i, n, n - len(words), hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "surrogatepass"),) if with_text else ()))
        fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text
        cols = list(zip(*out, strict=True)) if out else [[]] * len(fields)
        return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")


def remove_repeated_windows(
    docs: DataFrame, width: int = 13, depth: int = 2, bits: int | None = None, slice_bits: int | None = None, unit_octets: int | None = None, part_octets: int = 12_000_000, with_text: bool = False
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) for every row of ``docs``.

    ``bits``, ``slice_bits`` and ``unit_octets`` follow from the input; tests set them.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))
    octets = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits or sketch_bits(octets)
    slice_bits, unit_octets = slice_bits or sizes(bits)[0], unit_octets or sizes(bits)[1]
    tasks = min(50_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), octets // unit_octets))
    make, schema = _unit_maker(unit_octets)
    units = work.settle_bucketed(text.mapInArrow(make, schema), "units", "unit", tasks)

    make, schema = _sketcher(width, depth, bits, slice_bits)
    sketches = units.filter("doc_id is not null").select("doc_id", "text", "unit").mapInArrow(make, schema)
    slices = min(50_000, depth << max(0, bits - slice_bits))
    merge, schema = _merger(bits, slice_bits)
    answers = sketches.repartition(slices, "row", "slice").sortWithinPartitions("row", "slice").mapInArrow(merge, schema)
    answers = work.settle(answers, "answers")
    work.release()

    parts = max(32, octets // part_octets)
    send, schema = _sender(width, depth, bits, slice_bits, parts)
    group, grouped = _grouper()
    entries = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(send, schema)
    gone = entries.repartition(min(parts, 50_000), "part").sortWithinPartitions("part").mapInArrow(group, grouped)
    gone = work.settle(gone, "gone")
    work.discard(answers)
    work.release()
    finish, schema = _finisher(width, with_text)
    return units.groupBy("unit").cogroup(gone.groupBy("unit")).applyInArrow(finish, schema)


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
), h AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS seq FROM win
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS least FROM h) WHERE least < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM dup) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
