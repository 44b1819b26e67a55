"""MinHash near-duplicate groups (operator 4).

Method: one-permutation hashing with optimal densification (Shrivastava, "Optimal
Densification for Fast and Accurate Minwise Hashing", 2017), banded buckets and
star-shaped candidate edges.

1. One Arrow pass makes each document's set of distinct word shingles, a 128-bit
   key of the set, and the band keys of its one-permutation signature.
2. Documents of the same set collapse into their least ``doc_id`` by a grouped
   minimum, so exact copies, however many, cost one row each from here on.
3. Stars: in every bucket each member gets one edge to a head, which gives as many candidate
   edges as members.  They are confirmed on the full sets, and components of the confirmed
   links are formed.  While more than ``few`` buckets hold members of two components, this is done again in these, up to
   ``stars`` times, with other heads and only between two components.
4. Stars alone could lose a link between two members that both differ from each head.  So members of
   different components that still share a bucket are compared in full: components that such
   buckets join make a family, a family is cut into blocks of one large component or of several small
   ones, and each pair of blocks that can hold a link between components is a task of its own, which returns
   a spanning forest of its links, never the pairs.  Two members of one component are never compared.
5. Components of all confirmed links give the groups.

So a family of many near copies that some head is close to costs a row a member and band; full comparison
is left for members whose components differ, in blocks of ``block_docs``.

Candidate recall: two documents of similarity s share no bucket with probability
about (1 - s**rows)**bands: with the defaults 9e-7 at s = 0.85 and 2.1e-4 at 0.8, which
40 bands bring to 8.2e-5.

Nulls and empty texts have no shingles and are linked with nothing.  Rows with a
null ``doc_id`` cannot be named in a result and are left out.  Rows that repeat a
``doc_id`` are one document; the union of links of its texts holds for it.  Ties
do not arise: the least id is unique.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm import _kernels as K
from quillmask.llm._graph import connected_components
from quillmask.llm._store import Workspace

U = np.uint64


def _probe_table(bins: int, rounds: int) -> np.ndarray:
    """The bin that bin i looks at in round t, 2-universal over (i, t)."""
    at = np.arange(rounds * bins, dtype=U).reshape(rounds, bins)
    return ((K.mix(at + U(0x5851F42D4C957F2D)) >> U(32)) * U(bins) >> U(32)).astype(np.int64)


def one_permutation(values: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """The densified signature of a non-empty set of 64-bit values."""
    y = K.mix(values)
    y = np.sort((((y >> U(32)) * U(bins)) >> U(32) << U(32)) | (y & U(0xFFFFFFFF)))
    b = (y >> U(32)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    sig = np.zeros(bins, dtype=U)
    full = np.zeros(bins, dtype=bool)
    sig[b[new]] = y[new] & U(0xFFFFFFFF)
    full[b[new]] = True
    empty = np.flatnonzero(~full)
    t, step = 0, 64
    while len(empty):
        look = probes[t : t + step][:, empty]
        if not len(look):  # beyond the table: the nearest full bin to the right, as in densification by rotation
            held = b[new]
            sig[empty] = sig[held[np.searchsorted(held, empty) % len(held)]]
            break
        hit = full[look]
        got = hit.any(axis=0)
        first = hit.argmax(axis=0)[got]
        sig[empty[got]] = sig[look[first, np.flatnonzero(got)]]
        empty = empty[~got]
        t += step
    return sig


def _signer(k: int, bands: int, rows: int):
    bins = bands * rows
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probe_table(bins, 4096)
        tag = np.arange(bands, dtype=U) * U(0x9FB21C651E98DF25)
        for batch in batches:
            for ids, texts in K.pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, k1, k2, keys = [], [], [], []
                for s in K.shingle_sets(texts, k):
                    n.append(len(s))
                    if not len(s):
                        k1.append(0)
                        k2.append(0)
                        keys.append(None)
                        continue
                    k1.append(int(K.mix(s + U(11)).sum().view(np.int64)))
                    k2.append(int((K.mix(s ^ U(0xA0761D6478BD642F)) + U(len(s))).sum().view(np.int64)))
                    sig = one_permutation(s, bins, probes).reshape(bands, rows)
                    acc = tag.copy()
                    for r in range(rows):
                        acc = K.mix(acc + sig[:, r])
                    keys.append(acc.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"


def _set_maker(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            for rows, texts in K.pieces(list(range(len(at))), batch.column(1).to_pylist()):
                sets = [s.tobytes() for s in K.shingle_sets(texts, k)]
                yield pa.RecordBatch.from_arrays([pa.array([at[i] for i in rows], pa.int64()), pa.array(sets, pa.binary())], names=["node", "items"])

    return run, "node long, items binary"


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links_within(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links ``den * |a & b| >= num * |a | b|``.

    Pairs of the two sides are compared, or all pairs if there is one side; pairs of one ``group`` are not.
    Intersections are counted for all pairs at once, a slice of columns at a time.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    group = np.arange(n) if group is None else group
    parent = list(range(n))
    out: list[tuple[int, int]] = []

    def link(pairs) -> None:
        for a, b in pairs:
            x, y = _find(parent, int(a)), _find(parent, int(b))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[a]), int(ids[b])))

    one = len(np.unique(side)) == 1
    if n <= 4:
        for a in range(n):
            for b in range(a + 1, n):
                if (one or side[a] != side[b]) and group[a] != group[b] and linked(sets[a], sets[b], num, den):
                    link([(a, b)])
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    count = np.bincount(column)
    keep = count[column] > 1
    column, owner = column[keep], owner[keep]
    _, column = np.unique(column, return_inverse=True)
    inter = np.zeros((n, n), dtype=np.float32)
    width = 8192
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for c in range(len(edges) - 1):
        x = np.zeros((n, width), dtype=np.float32)
        x[owner[edges[c] : edges[c + 1]], column[edges[c] : edges[c + 1]] - c * width] = 1
        inter += x @ x.T
    both = inter.astype(np.int64)
    good = np.triu(den * both >= num * (size[:, None] + size[None, :] - both), 1)
    if not one:
        good &= side[:, None] != side[None, :]
    good &= group[:, None] != group[None, :]
    link(np.argwhere(good))
    return out


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _pair_checker(num: int, den: int):
    """Rows ``u, v, items, head`` to the linked ``u, v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=U) for c in (2, 3))
                good.append(linked(a, b, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run, "u long, v long"


def _confirmer(num: int, den: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("node").drop_duplicates(["node", "items"])
        sets = [np.frombuffer(x, dtype=U) for x in table["items"]]
        found = links_within(table["node"].to_numpy(), table["block"].to_numpy(), sets, num, den, table["component"].to_numpy())
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def _check_pairs(pairs: DataFrame, items: DataFrame, num: int, den: int, part_rows: int = 256) -> DataFrame:
    """The links among ``pairs(u, v)``; a head ``v`` of many pairs has its set in several parts."""
    sizes = pairs.groupBy("v").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    heads = sizes.join(items.select(F.col("node").alias("v"), F.col("items").alias("head")), "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = pairs.join(sizes, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")).select("u", "v", "part")
    own = own.join(items.select(F.col("node").alias("u"), "items"), "u")
    run, schema = _pair_checker(num, den)
    return own.join(heads.select("v", "part", "head"), ["v", "part"]).select("u", "v", "items", "head").mapInArrow(run, schema)


def _compare_blocks(members: DataFrame, items: DataFrame, num: int, den: int, block_docs: int, block_items: int, work: Workspace) -> DataFrame:
    """Links between different components of each family of ``members(node, component, family)``."""
    sized = work.settle(members.join(items.groupBy("node").agg(F.sum(F.length("items") / 8).alias("n")), "node"), "sized")
    blocks = F.greatest(F.ceil(F.sum("docs") / block_docs), F.ceil(F.sum("n") / block_items)).cast("int")
    parts = sized.groupBy("family", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    parts = parts.withColumn("large", (2 * F.col("docs") >= block_docs) | (2 * F.col("n") >= block_items))
    pool = parts.filter("not large").groupBy("family").agg(blocks.alias("pool"))
    large = parts.filter("large").groupBy("family", "component").agg(blocks.alias("own"))
    before = Window.partitionBy("family").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = large.join(pool, "family", "left").withColumn("first", F.coalesce("pool", F.lit(0)) + F.coalesce(F.sum("own").over(before), F.lit(0)))
    total = parts.select("family").distinct().join(pool, "family", "left").join(large.groupBy("family").agg(F.sum("own").alias("own")), "family", "left")
    total = work.settle(total.select("family", F.coalesce("pool", F.lit(0)).alias("pool"), (F.coalesce("pool", F.lit(0)) + F.coalesce("own", F.lit(0))).cast("int").alias("blocks")), "blocks")
    at = sized.join(total, "family").join(large.select("family", "component", "own", F.col("first").cast("int").alias("first")), ["family", "component"], "left")
    spread = F.pmod(F.xxhash64("node"), F.coalesce("own", "pool")).cast("int")
    at = at.select("node", "component", "family", "blocks", "first", "own", (F.coalesce("first", F.lit(0)) + spread).alias("block"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.when(F.col("own").isNull(), every).otherwise(F.filter(every, lambda b: (b < F.col("first")) | (b >= F.col("first") + F.col("own"))))
    tasks = at.join(items, "node").withColumn("other", F.explode(others))
    tasks = tasks.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "component", "node", "items")
    return tasks.groupBy("family", "lo", "hi").applyInPandas(_confirmer(num, den), "u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 36, rows: int = 7, stars: int = 4, few: int = 50_000, block_docs: int = 128, block_items: int = 1_000_000, hot_rows: int = 256
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document of ``docs``.

    Documents are linked when ``den * |A & B| >= num * |A | B|`` over the sets of
    distinct ``shingle``-word shingles of their ASCII-lower-cased texts.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    run, schema = _signer(shingle, bands, rows)
    signed = work.settle(text.mapInArrow(run, schema), "signed")
    full = signed.filter("n_shingles > 0")

    least = work.settle(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "least")
    reps = full.join(least.select("key1", "key2", "rep"), [full.doc_id == F.col("rep"), full.key1 == least.key1, full.key2 == least.key2], "left_semi")
    buckets = work.settle(reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct(), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    shared = work.settle(buckets.join(shared, "bucket", "left_semi"), "shared")
    work.discard(buckets)
    nodes = shared.select(F.col("node").alias("doc_id")).distinct()
    make, schema = _set_maker(shingle)
    items = work.settle(text.join(nodes, "doc_id", "left_semi").mapInArrow(make, schema), "items")

    # texts of one repeated id are one document
    several = full.groupBy("doc_id").agg(F.min("key1").alias("lo"), F.max("key1").alias("hi")).filter("lo <> hi").select("doc_id")
    several = full.join(several, "doc_id", "left_semi").join(least, ["key1", "key2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    several = work.settle(several.distinct(), "several")
    links, groups = (several, connected_components(several, work)) if several.take(1) else (None, None)
    for turn in range(stars + 1):
        if groups is None:
            placed = shared.withColumn("component", F.col("node"))
        else:
            placed = work.settle(shared.join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed")
        first = F.min(F.struct((F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("order"), "node", "component")).alias("head")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), first).filter("lo <> hi")
        mixed = work.settle(mixed.select("bucket", "lo", F.col("head.node").alias("head"), F.col("head.component").alias("other")), "mixed")
        left = mixed.count()
        if not left:
            break
        last = turn == stars or turn > 0 and left <= few
        if not last:
            pairs = placed.join(mixed, "bucket").filter("component <> other").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
            found = _check_pairs(work.settle(pairs, "pairs"), items, num, den)
        else:
            near = placed.join(mixed.select("bucket", "lo"), "bucket")
            family = connected_components(near.filter("component <> lo").select(F.col("component").alias("u"), F.col("lo").alias("v")), work)
            members = near.select("node", "component").distinct().join(family.select(F.col("node").alias("component"), F.col("component").alias("family")), "component")
            found = _compare_blocks(members, items, num, den, block_docs, block_items, work)
        found = work.settle(found, "links")
        links = found if links is None else links.unionByName(found)
        groups = connected_components(links, work)
        if last:
            break

    named = least.select("key1", "key2", "rows", F.col("rep").alias("component_id"))
    if groups is not None:
        named = named.join(groups, F.col("component_id") == F.col("node"), "left").select("key1", "key2", "rows", F.coalesce("component", "component_id").alias("component_id"))
    named = work.settle(named, "named")
    # sets of very many rows are fewer than 100,000 and broadcast, so that no task gets all rows of one
    limit = max(hot_rows, (named.agg(F.sum("rows")).first()[0] or 0) // 100_000)
    hot = named.filter(F.col("rows") > limit).drop("rows")
    full = full.drop("bands")
    found = full.join(F.broadcast(hot.select("key1", "key2")), ["key1", "key2"], "left_anti").join(named.filter(F.col("rows") <= limit).drop("rows"), ["key1", "key2"])
    found = found.unionByName(full.join(F.broadcast(hot), ["key1", "key2"])).unionByName(signed.drop("bands").filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id") == F.col("component_id"))
