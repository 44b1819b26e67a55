"""Null ids and texts, repeated rows, very long texts and clashing columns, through every operator and stage."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quillmask.llm import decontam, exact_dedup, licenses, near_dedup, packing, pii, quality, queries, substring_dedup

SCHEMA = "doc_id long, text string, row string, g_id string, score string, k_rows string, hash string, component string, unit string, found string, item_id string, shard string"
CLASH = ("x",) * 10


def words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    a, b = words(rng, 80), words(rng, 80)
    long_text = words(rng, 40_000) + " mail a@b.example, released under the MIT License."
    texts = [(1, a), (1, a), (1, b), (2, None), (2, ""), (None, a), (None, None), (None, a.upper()), (3, long_text), (4, b), (5, " \n\t"), (6, "x" * 100_000), (7, words(rng, 60)), (8, "\ud800".encode("utf-8", "replace").decode())]
    return [(i, t, *CLASH) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect())


def test_one_row_for_each_row(spark, odd, rows):
    every = sorted(r[0] if r[0] is not None else -1 for r in rows)
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    for out in (
        exact_dedup.exact_duplicates(odd), substring_dedup.remove_repeated_windows(odd), pii.digest(pii.personal_data(odd)), licenses.digest(licenses.scan(odd)), quality.quality_scores(odd, labels),
    ):
        assert ids(out) == every
    assert ids(near_dedup.near_duplicates(odd)) == [i for i in every if i >= 0]
    pieces = packing.pack(odd, queries.tokenizer_path(spark))
    assert set(ids(pieces)) == set(every)
    assert pieces.agg({"length": "sum"}).first()[0] == pieces.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0]


def test_results_of_odd_rows(spark, odd):
    spans = {(r.doc_id, r.n_spans) for r in pii.digest(pii.personal_data(odd)).collect()}
    assert (3, 1) in spans and (1, 0) in spans
    assert {r.families for r in licenses.digest(licenses.scan(odd)).collect() if r.doc_id == 3} == {"MIT"}
    items = spark.createDataFrame([(1, odd.filter("doc_id = 4").first().text), (1, "again another item of words"), (None, "w1 w2"), (2, None), (3, " ")], "item_id long, text string")
    found = decontam.contaminated(odd, items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == [(1, 1, 0), (4, 1, 0)]


def test_stages_on_odd_rows(spark, odd, rows, tmp_path):
    item = rows[-2][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, odd, str(tmp_path)).count() in (0, len(rows))  # no labels: one score for all
    out = stages["exact dedup"](spark, odd, str(tmp_path))
    assert out.columns == odd.columns
    kept = sorted((r.doc_id or 0, len(r.text or "")) for r in out.collect())
    size = {i: len(t) for i, t, *_ in rows if i in (3, 4, 6, 7, 8) and t}
    assert kept == sorted([(1, len(rows[0][1])), (2, 0), (3, size[3]), (4, size[4]), (5, 3), (6, size[6]), (7, size[7]), (8, size[8])])
    near = stages["near dedup"](spark, odd, str(tmp_path))
    assert near.columns == odd.columns and ids(near) == [-1, -1, -1, 1, 1, 1, 2, 2, 3, 5, 6, 7, 8]
    clean = stages["decontamination"](spark, odd, str(tmp_path))
    assert clean.columns == odd.columns and 7 not in ids(clean) and clean.count() == len(rows) - 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
