"""Exact duplicates through an extendible-hash index on shared files (operator 10).

Native DataFrame operations only.

1. Keys: one scan writes ``(doc_id, hash)`` of each normalised text to the shared folder;
   the rows of each hash are counted, combined before they are dealt.
2. Directory: a bucket is the texts whose hashes share their ``depth`` leading bits.
   Buckets start at ``start_depth``; one with more than ``capacity`` rows of two hashes or
   more is split and the directory doubles, until none is overfull or the hash has no more
   bits.  Rows are counted once per cell (``bits`` leading bits), so a doubling regroups
   cells; only where one cell is overfull are hashes counted again, in finer cells.
3. Owners: each text goes to the task that owns its bucket.  There it is compared byte for
   byte, and the distinct texts of one hash form a chain: each takes a slot, with its
   row count and greatest ``doc_id``.  The slots are written to the shared folder.
4. Lookup: a row finds its slot by its hash; in a chain of two slots or more, by its bytes.

A hash of more than a 100,000th of all rows (and of ``hot_rows``) is hot; there are fewer than 100,000,
whatever the input, so their list is broadcast.  Texts of hot hashes are counted in each task before
they are dealt: their owners get one row a task and text.  Their rows find their slots in a broadcast.
The capacity grows with the input so that the directory has some 200,000 buckets at most, and is
broadcast; should uneven hashes give more than ``broadcast_cells``, it is joined without.

Texts are equal when identical after lower-casing ``A-Z`` only; a null text counts
as empty.  Of equal texts the row with the largest ``doc_id`` stays.  Rows that
repeat a ``doc_id`` are rows of their own: each is returned and counted; of equal
ones all carry the same ``keep_id`` and are marked kept.  A null ``doc_id`` never
wins over another, and its row is returned.  Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm._store import Workspace


def ascii_lower(text: Column) -> Column:
    """Lower-cases ``A-Z`` only; ``lower`` is that where every byte is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _lead(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits)


def directory(counted: DataFrame, capacity: int, start_depth: int, cell_bits: int, max_depth: int, work: Workspace) -> DataFrame:
    """``cell, bits, bucket, depth``: the bucket of each cell of ``counted(hash, rows)``."""
    bits, depth, open_, leaves = max(cell_bits, start_depth), start_depth, counted, None
    total = [F.sum("hashes").alias("hashes"), F.sum("rows").alias("rows")]
    while True:
        left = open_.select(_lead(bits).alias("cell"), F.lit(1).alias("hashes"), "rows").groupBy("cell").agg(*total)
        left = work.settle(left, f"cells{bits}")
        while depth <= bits:  # one doubling a turn
            held = left.withColumn("bucket", F.shiftrightunsigned("cell", bits - depth))
            sizes = work.settle(held.groupBy("bucket").agg(*total), f"depth{depth}")
            over = sizes.filter((F.col("rows") > capacity) & (F.col("hashes") > 1)).select("bucket")
            last = depth >= max_depth or not over.take(1)
            done = held if last else held.join(over, "bucket", "left_anti")
            done = done.select("cell", F.lit(bits).alias("bits"), "bucket", F.lit(depth).alias("depth"))
            leaves = done if leaves is None else leaves.unionByName(done)
            if last:
                return work.settle(leaves, "directory")
            left = work.settle(held.join(over, "bucket", "left_semi").drop("bucket"), f"left{depth}")
            depth += 1
        open_ = open_.join(left.select(F.col("cell").alias("c")), _lead(bits) == F.col("c"), "left_semi")
        bits = min(bits + 8, max_depth)


def _placed(rows: DataFrame, leaves: DataFrame, broadcast: bool) -> DataFrame:
    """``rows(hash, ...)`` with the ``bucket`` that the directory gives them."""
    out = None
    for b in sorted(r.bits for r in leaves.select("bits").distinct().collect()):
        at = leaves.filter(F.col("bits") == b).select("cell", "bucket", "depth")
        own = rows.withColumn("cell", _lead(b)).join(F.broadcast(at) if broadcast else at, "cell").drop("cell")
        out = own if out is None else out.unionByName(own)
    return out


def _chained(texts: DataFrame) -> DataFrame:
    """Slots of the chains: the bytes stay only where a hash has several."""
    chain = Window.partitionBy("bucket", "depth", "hash").orderBy("norm")
    several = F.lag("hash").over(chain).isNotNull() | F.lead("hash").over(chain).isNotNull()
    slots = texts.select("*", F.row_number().over(chain).alias("slot"), several.alias("several"))
    return slots.select(
        "bucket", "depth", "hash", "slot", "several", F.when(F.col("several"), F.col("norm")).alias("norm"), F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size"
    )


def exact_duplicates(
    docs: DataFrame, capacity: int = 4096, start_depth: int = 4, max_depth: int = 62, hash_bits: int = 64, hot_rows: int = 256, broadcast_cells: int = 4_000_000
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``hash_bits`` shortens the hash, for tests of long chains.
    """
    work = Workspace(docs.sparkSession, "exact")
    normed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    hashed = F.xxhash64("norm").bitwiseAND(F.lit(-1 << (64 - hash_bits)).cast("long"))
    text = normed.select("doc_id", hashed.alias("hash"), "norm")
    keys = work.settle(text.select("doc_id", "hash"), "keys")
    counted = work.settle(keys.groupBy("hash").agg(F.count("*").alias("rows")), "counted")
    total = counted.agg(F.sum("rows")).first()[0] or 0
    capacity, limit = max(capacity, total // 100_000), max(hot_rows, total // 100_000)
    hot = work.settle(counted.filter(F.col("rows") > limit).select("hash"), "hot")

    loads = counted.select("hash", F.when(F.col("rows") > limit, 1).otherwise(F.col("rows")).alias("rows"))  # hot ones come combined
    leaves = directory(loads, capacity, start_depth, min(max_depth, start_depth + (total // capacity).bit_length()), max_depth, work)
    small = leaves.count() <= broadcast_cells
    texts = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    cold = _placed(text.join(F.broadcast(hot), "hash", "left_anti"), leaves, small)
    if cold is None:
        cold = text.limit(0).withColumns({"bucket": F.lit(0).cast("long"), "depth": F.lit(0)})
    cold = cold.repartition("bucket").groupBy("bucket", "depth", "hash", "norm").agg(*texts)
    slots = _chained(cold)
    some_hot = bool(hot.take(1))
    if some_hot:
        crowd = text.join(F.broadcast(hot), "hash", "left_semi").groupBy("hash", "norm").agg(*texts)
        slots = slots.unionByName(_chained(_placed(crowd, leaves, small).select(*cold.columns)))
    slots = work.settle(slots, "slots")

    alone = slots.filter("not several").select("hash", "digest", "keep_id", "group_size")
    found = keys
    if some_hot:
        own = keys.join(F.broadcast(alone.join(F.broadcast(hot), "hash", "left_semi")), "hash")
        found = keys.join(F.broadcast(hot), "hash", "left_anti").join(alone, "hash").unionByName(own)
    else:
        found = keys.join(alone, "hash")
    chains = slots.filter("several")
    if chains.take(1):  # different bytes of one hash: their rows are looked up by the bytes
        chains = chains.select("hash", "norm", "digest", "keep_id", "group_size")
        found = found.unionByName(text.join(chains, ["hash", "norm"]).drop("norm"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
