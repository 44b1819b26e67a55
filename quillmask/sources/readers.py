"""Documents from files, and review results to files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def is_supported(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(?:md|markdown|txt|docx|pdf)\z")


def index_docs(docs: DataFrame) -> DataFrame:
    """``doc_id, name, text_sha256`` by the order of path and id, with line ends made one.

    The order is a range partitioning and a count per partition, so no task numbers all rows.
    """
    from quillmask.functions.ordinal import with_ordinal

    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    rows = docs.select("doc_id", "path", F.sha2(text, 256).alias("text_sha256"))
    return with_ordinal(rows, ["path", "doc_id"], "n").select("doc_id", F.format_string("doc-%03d", "n").alias("name"), "text_sha256")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown and text files, each a row ``path, text``."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.filter(F.lower("path").rlike(r"\.(?:md|markdown|txt)\z"))


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processing document, headings marked, images named as removed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{_W}p"):
        text = "".join("\t" if n.tag == f"{_W}tab" else "[IMAGE_REMOVED]" if n.tag == f"{_W}drawing" else n.text or "" for n in p.iter() if n.tag in (f"{_W}t", f"{_W}tab", f"{_W}drawing"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = (style.get(f"{_W}val") or "")[-1:] if style is not None and "eading" in (style.get(f"{_W}val") or "") else ""
        out.append(f"{'#' * int(level)} {text}" if level.isdigit() and text else text)
    return "\n\n".join(t for t in out if t.strip())


def read_docx_files(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [docx_text(c) for c in b["content"]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def strip_images(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"!\[[^\]]*\]\(data:[^)]*\)", "[IMAGE_REMOVED]")


def reconstruct_pdf(items: DataFrame) -> DataFrame:
    """Text of positioned runs: a new line where the baseline moves, a blank where a gap opens."""
    over = Window.partitionBy("doc_id", "page").orderBy("item_ord")
    rows = items.withColumn("px", F.lag(F.col("x") + F.col("width")).over(over)).withColumn("py", F.lag("y").over(over)).withColumn("ph", F.lag("height").over(over))
    lower = F.least("height", "ph")
    mark = (
        F.when(F.col("py").isNull(), "")
        .when(F.abs(F.col("y") - F.col("py")) > F.greatest(F.lit(1.5), 0.25 * lower), "\n")
        .when(F.col("x") - F.col("px") > F.greatest(F.lit(0.35), 0.04 * lower), " ")
        .otherwise("")
    )
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("item_ord", mark.alias("m"), F.col("str").alias("s")))).alias("runs"))
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["m"], r["s"])), "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), " ?\n ?", "\n")
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", text.alias("t")))).alias("pages"))
    return docs.select("doc_id", F.array_join(F.transform("pages", lambda p: F.concat(F.lit("## Page "), p["page"], F.lit("\n\n"), p["t"])), "\n\n").alias("text"))


def write_markdown(markdown: DataFrame, path: str) -> None:
    """One folder a pack, each with its redacted text."""
    markdown.select("pack_id", F.col("markdown").alias("value")).write.partitionBy("pack_id").text(path)


def write_restore_json(key: DataFrame, path: str, level: str = "balanced") -> None:
    entry = F.struct("replacement", "value", "kind", "reason", "sources", "count", "safe", "ambiguous")
    packs = key.groupBy("pack_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    packs.select("pack_id", F.lit("restore-key").alias("kind"), F.lit(1).alias("version"), F.lit(level).alias("level"), "entries").write.partitionBy("pack_id").json(path)
