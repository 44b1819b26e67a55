"""Document quality: a byte-level convolutional network in numpy (operator 2).

A document's UTF-8 bytes, all of them, are cut into overlapping chunks.  Learned filters
over ``span`` bytes respond at every byte, a chunk gives each filter's greatest
response (rectified), and a document the mean and the greatest of its chunks.  One
logistic unit combines these into the probability of label 1.

Filters are tables: the response at a byte is the sum of one entry for each of the next
``span`` bytes.  For scoring, entries of two neighbouring bytes are summed beforehand.

The network is trained on the driver by Adagrad on a bounded sample of labelled rows:
``sample`` labels of the least hash of their id, each with the text of that id of the least hash
among those up to ``sample_octets`` (so the driver gets ``sample * sample_octets`` bytes at most); rows
that are held out (crc32 of the id as text, mod 4, is 2) are never read for it.  Labels,
language, source and id are no inputs of a score.  Without labels of both kinds the
score is the share of label 1, or 0.5.

Null texts count as empty and are scored as such.  Repeated rows and null ids are rows
of their own (a null id is not held out).  A ``doc_id`` with several labels trains on each.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Network:
    filters: np.ndarray  # span, 256, n
    bias: np.ndarray
    mean_w: np.ndarray
    max_w: np.ndarray
    offset: float
    chunk: int = 512
    overlap: int = 64

    def tables(self) -> list[np.ndarray]:
        f = self.filters
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in range(0, len(f), 2)]


def lay_out(texts: list[bytes], span: int, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, bounds of the chunks, and each text's first chunk."""
    gap = b"\0" * (span + 1)
    buf = np.frombuffer(gap.join(texts) + gap, dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    origin = np.cumsum(size + len(gap)) - size - len(gap)
    step = chunk - overlap
    n = np.maximum(1, -(-(size - overlap) // step))
    first = np.append(0, np.cumsum(n))
    k = np.arange(first[-1]) - np.repeat(first[:-1], n)
    start = np.repeat(origin, n) + k * step
    end = np.minimum(start + chunk, np.repeat(origin + np.maximum(size, 1), n))
    return buf, start, end, first


def responses(buf: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    two = buf[:-1].astype(np.int64) << 8 | buf[1:]
    n = len(buf) - 2 * len(tables)
    out = tables[0][two[:n]]
    for j in range(1, len(tables)):
        out += tables[j][two[2 * j : 2 * j + n]]
    return out


def pooled(net: Network, tables: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Mean and greatest chunk response of every text, side by side."""
    buf, start, end, first = lay_out(texts, len(net.filters), net.chunk, net.overlap)
    top = np.empty((len(start), net.filters.shape[2]), dtype=np.float32)
    block, i = 1 << 18, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + block)))
        r = responses(buf[start[i] : end[j - 1] + 2 * len(tables)], tables)
        bounds = np.stack([start[i:j], end[i:j]], axis=1).ravel() - start[i]
        top[i:j] = np.maximum.reduceat(r, np.minimum(bounds, len(r) - 1), axis=0)[::2]
        last = slice(start[j - 1] - start[i], end[j - 1] - start[i])
        top[j - 1] = r[last].max(axis=0)
        i = j
    top = np.maximum(top + net.bias, 0)
    n = np.diff(first)[:, None]
    return np.concatenate([np.add.reduceat(top, first[:-1], axis=0) / n, np.maximum.reduceat(top, first[:-1], axis=0)], axis=1)


def probability(net: Network, features: np.ndarray) -> np.ndarray:
    x = features @ np.concatenate([net.mean_w, net.max_w]) + net.offset
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, filters: int = 12, span: int = 6, steps: int = 1500, batch: int = 16, rate: float = 0.08, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.15, (span, 256, filters)), np.zeros(filters), rng.normal(0, 0.3, filters), rng.normal(0, 0.3, filters), 0.0)
    share = float(labels.mean()) if len(labels) else 0.5
    net.offset = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if len(set(labels.tolist())) < 2:
        net.mean_w[:] = net.max_w[:] = 0
        return net
    seen = {k: np.full_like(getattr(net, k), 1e-3) for k in ("filters", "bias", "mean_w", "max_w")}
    seen_offset = 1e-3
    kinds = [np.flatnonzero(labels == y) for y in (0, 1)]
    for step in range(steps):
        # half of a batch of each label; weights bring the shares back, so scores stay probabilities
        pick = np.concatenate([rng.choice(own, batch // 2) for own in kinds])
        y = labels[pick].astype(float)
        weight = np.where(y == 1, share, 1 - share) * 2 / batch
        weight = (weight + 1 / batch) / 2
        buf, start, end, first = lay_out([texts[i] for i in pick], span, net.chunk, net.overlap)
        r = responses(buf, net.tables()) + net.bias
        at = np.stack([a + np.argmax(r[a:b], axis=0) for a, b in zip(start, end, strict=True)])
        top = np.take_along_axis(r, at, axis=0)
        act = np.maximum(top, 0)
        owner = np.repeat(np.arange(len(pick)), np.diff(first))
        n = np.diff(first)[:, None]
        mean = np.add.reduceat(act, first[:-1], axis=0) / n
        most = np.maximum.reduceat(act, first[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(mean @ net.mean_w + most @ net.max_w + net.offset, -30, 30)))
        d = weight * (p - y)
        is_most = act == most[owner]
        back = d[owner][:, None] * (net.mean_w / n[owner] + net.max_w * is_most) * (top > 0)
        grads = {"mean_w": mean.T @ d, "max_w": most.T @ d, "bias": back.sum(axis=0)}
        g = np.zeros_like(net.filters)
        f = np.broadcast_to(np.arange(filters), at.shape)
        for j in range(span):
            np.add.at(g[j], (buf[at + j], f), back)
        grads["filters"] = g
        for k, v in grads.items():
            seen[k] += v * v
            setattr(net, k, getattr(net, k) - rate * v / np.sqrt(seen[k]))
        seen_offset += d.sum() ** 2
        net.offset -= rate * d.sum() / np.sqrt(seen_offset)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_octets: int = 40_000, **options) -> Network:
    """Trains on at most ``sample`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= sample_octets)
    pick = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")  # one text of an id that is repeated
    rows = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(pick).select("doc_id", "t.text", "quality").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.quality))
    return train([r.text.encode("utf-8", "surrogatepass") for r in rows], np.array([r.quality for r in rows], dtype=np.int64), **options)


def _scorer(shared, text: str, inside: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch in batches:
            column = batch.column(batch.schema.names.index(inside or text))
            texts = column.field(text) if inside else column
            out, some, size = [], [], 0
            for a in range(0, len(texts), 512):
                for t in texts.slice(a, 512).to_pylist():
                    some.append(t.encode("utf-8", "surrogatepass") if t else b"")
                    size += len(some[-1])
                    if size >= 1 << 20:
                        out.append(probability(net, pooled(net, tables, some)))
                        some, size = [], 0
            if some:
                out.append(probability(net, pooled(net, tables, some)))
            score = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
            kept = [i for i, n in enumerate(batch.schema.names) if inside or n != text]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [score], names=[batch.schema.names[i] for i in kept] + ["score"])

    return run


def score(docs: DataFrame, net: Network, text: str = "text", inside: str | None = None) -> DataFrame:
    """``docs`` without its text, with a ``score`` for every row.

    Where the text is a field of the struct column ``inside``, that column stays whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some hundred kB, whatever the input
    schema = T.StructType([f for f in docs.schema if inside or f.name != text] + [T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_scorer(shared, text, inside), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    net = fit(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
