"""The corpus pipeline on a small corpus: each stage's decisions take effect."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quillmask.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    item = text(30)
    rows = []
    for i in range(80):
        t = text(80)
        rows.append((i, t if i % 4 else " | ".join(t.split()), "en"))
    clean = [r for r in rows if r[0] % 4]
    rows += [(100, clean[0][1].upper(), "en"), (101, clean[1][1] + " one more", "en"), (102, f"{text(50)} {item} {text(50)}", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{tmp_path}/{name.replace(' ', '')}"
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        got.write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = {r[0] for r in clean}
    assert len(good - kept[0]) <= 2 and not {i for i in kept[0] if i < 80} - good
    assert kept[0] - kept[1] == ({clean[0][0]} if {100, clean[0][0]} <= kept[0] else set())
    assert kept[1] - kept[2] == ({101} if {101, clean[1][0]} <= kept[1] else set())
    assert kept[2] - kept[3] == {102} & kept[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept[3]
    assert len(corpus_pipeline.STAGES) == 5 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_pairs_are_seldom_missed(monkeypatch):
    class Called(Exception):
        pass

    def near(docs, shingle=5, num=80, den=100, bands=36, rows=7):
        raise Called((1 - (num / den) ** rows) ** bands)

    monkeypatch.setattr(corpus_pipeline.near_dedup, "near_duplicates", near)
    with pytest.raises(Called) as missed:
        corpus_pipeline.drop_near(None, None, "")
    assert missed.value.args[0] < 1e-4
