"""The registered query of each training-data operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmask.llm._store import read_table
from quillmask.llm import decontam, exact_dedup, html_text, licenses, packing, pii, quality, substring_dedup, url_filters
from quillmask.llm.near_dedup import near_duplicates


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file: of the folder in ``spark.quillmask.tokenizers``, or else of the installed set."""
    folder = spark.conf.get("spark.quillmask.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(read_table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(read_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filters.listed(url_filters.sample_captures(pages), url_filters.sample_entries(pages))


def op10_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_minhash": op4_minhash,
    "op5_decontamination": op5_decontamination,
    "op6_nnls_packing": op6_nnls_packing,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_extendible_dedup": op10_extendible_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op7_pii": pii.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_url_filters": url_filters.SQL,
    "op10_extendible_dedup": exact_dedup.SQL,
}
