"""Corpus preparation: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept;
all but the last return the columns of ``docs``.  A row goes only if a stage says so of its id (and, for
exact copies, its text): rows without an id lose exact copies and low quality, and pass the other stages.
Rows of one id with different texts are judged each by its own text among exact copies, else together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm import decontam, exact_dedup, near_dedup, packing, quality
from quillmask.llm._store import Workspace, read_table
from quillmask.llm.queries import tokenizer_path

#: A document is rejected below this probability of label 1.
QUALITY = 0.5

#: Bands of seven rows: a pair of similarity 0.8 is missed with a probability of 8.2e-5.
NEAR_BANDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    net = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(F.struct("*").alias("row")), net, inside="row")
    return scored.filter(F.col("score") >= QUALITY).select("row.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: of rows of one id and text, one stays."""
    kept = exact_dedup.exact_duplicates(docs).filter("kept").groupBy(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_text")).agg(F.count("*").alias("k_rows"))
    kept = Workspace(spark, "exact-kept").settle(kept, "kept")
    digest = F.sha2(exact_dedup.ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d_id"), digest.alias("d_text"))
    same = F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_text") == F.col("k_text"))
    found = rows.join(kept.filter("k_rows = 1"), same, "left_semi")
    if kept.filter("k_rows > 1").take(1):
        found = found.unionByName(rows.join(kept.filter("k_rows > 1"), same, "left_semi").dropDuplicates(["d_id", "d_text"]))
    return found.select("row.*")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    gone = near_dedup.near_duplicates(docs, bands=NEAR_BANDS).filter("not kept").select(F.col("doc_id").alias("g_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["g_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = decontam.contaminated(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("g_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["g_id"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path(spark))


STAGES = [
    ("quality", keep_quality),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn, hash and tokenise; no SQL gives the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
