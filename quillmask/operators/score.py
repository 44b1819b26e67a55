"""Predicted spans against gold annotations: coverage, suites, gates, history, consensus.

Spans are ``[start, end)`` in code points.  Overlaps are equi-joins on the document with
a range condition; the covered length of a gold span is the union of its overlaps,
found with a running maximum of ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 1 where there is nothing to count."""
    return F.when(b == 0, 1.0).otherwise(a.cast("double") / b)


def predicted_spans(reviewed: DataFrame) -> DataFrame:
    """Replaced segments at their places in the original text."""
    rows = reviewed.select("doc_id", F.posexplode("segments").alias("ord", "s"))
    size = F.length(F.coalesce("s.value", "s.text"))
    end = F.sum(size).over(Window.partitionBy("doc_id").orderBy("ord"))
    return rows.withColumn("end", end).withColumn("size", size).filter("s.entry_id is not null").select(
        "doc_id", (F.col("end") - F.col("size")).alias("start"), "end", F.col("s.kind").alias("kind"), F.col("s.value").alias("text")
    )


def reconstruct(reviewed: DataFrame) -> DataFrame:
    """The text that was redacted, from its segments."""
    return reviewed.select("doc_id", F.array_join(F.transform("segments", lambda s: F.coalesce(s["value"], s["text"])), "").alias("text"))


def covered_chars(targets: DataFrame, spans: DataFrame) -> DataFrame:
    """``targets`` (doc_id, id, start, end, …) with ``covered``: how much of each the union of spans covers."""
    other = spans.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = (F.col("s") < F.col("end")) & (F.col("start") < F.col("e"))
    cut = targets.select("doc_id", "id", "start", "end").join(other, "doc_id").filter(hit).select("doc_id", "id", F.greatest("s", "start").alias("s"), F.least("e", "end").alias("e"))
    before = F.max("e").over(Window.partitionBy("doc_id", "id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("e") - F.greatest("s", F.coalesce("before", "s")), F.lit(0))
    sums = cut.withColumn("before", before).groupBy("doc_id", "id").agg(F.sum(new).cast("long").alias("covered"))
    return targets.join(sums, ["doc_id", "id"], "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))


def score_spans(gold: DataFrame, predicted: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Gold spans with ``covered`` characters and a ``status``."""
    scored = covered_chars(gold, predicted)
    size = F.col("end") - F.col("start")
    status = F.when(F.col("covered") >= threshold * size, "covered").when(F.col("covered") > 0, "partial").otherwise("missed")
    return scored.withColumn("size", size.cast("long")).withColumn("status", status)


def score_document(gold: DataFrame, predicted: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: counts of spans and characters."""
    spans = score_spans(gold, predicted, threshold)
    redact, keep = F.col("action") == "redact", F.col("action") == "keep"

    def count(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    by_gold = spans.groupBy("doc_id").agg(
        count(redact).alias("spans"), count(redact & (F.col("status") == "covered")).alias("covered"), count(redact & (F.col("status") == "partial")).alias("partial"),
        count(redact & (F.col("status") == "missed")).alias("missed"), F.sum(F.when(redact, F.col("size")).otherwise(0)).cast("long").alias("chars"),
        F.sum(F.when(redact, F.col("covered")).otherwise(0)).cast("long").alias("covered_chars"), count(keep).alias("keeps"), count(keep & (F.col("covered") > 0)).alias("keep_violations"),
    )
    numbered = predicted.select("doc_id", F.concat_ws(":", "start", "end").alias("id"), "start", "end").distinct()
    inside = covered_chars(numbered, gold.filter(redact))
    near = covered_chars(numbered, gold).select("doc_id", "id", F.col("covered").alias("touched"))
    by_predicted = inside.join(near, ["doc_id", "id"]).groupBy("doc_id").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("predicted_chars"), F.sum("covered").cast("long").alias("right_chars"), F.count("*").alias("predicted"), count(F.col("touched") == 0).alias("unsupported")
    )
    both = by_gold.join(by_predicted, "doc_id", "full_outer")
    return both.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in both.columns if c != "doc_id"])


def summarize(scores: DataFrame, *by: str) -> DataFrame:
    """Sums over documents, then ratios (micro average)."""
    names = ["spans", "covered", "partial", "missed", "chars", "covered_chars", "keeps", "keep_violations", "predicted_chars", "right_chars", "predicted", "unsupported"]
    sums = scores.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names if n in scores.columns])
    recall, precision = ratio(F.col("covered_chars"), F.col("chars")), ratio(F.col("right_chars"), F.col("predicted_chars"))
    return sums.select(
        "*", ratio(F.col("covered"), F.col("spans")).alias("span_recall"), recall.alias("char_recall"), ratio(F.col("keeps") - F.col("keep_violations"), F.col("keeps")).alias("keep_clean"),
        precision.alias("precision"), F.when(recall + precision == 0, 0.0).otherwise(2 * recall * precision / (recall + precision)).alias("char_f1"),
    )


def buckets(spans: DataFrame) -> DataFrame:
    """``scope, key, spans, covered, recall`` overall, by label and by severity, in one pass of grouping sets."""
    gold = spans.filter("action = 'redact'")
    sets = gold.sparkSession.sql(
        "select case when grouping(label) = 0 then 'label' when grouping(severity) = 0 then 'severity' else 'all' end as scope, coalesce(label, severity, 'all') as key,"
        " count(*) as spans, sum(case when status = 'covered' then 1 else 0 end) as covered from {t} group by grouping sets ((label), (severity), ())",
        t=gold,
    )
    return sets.select("scope", "key", "spans", F.col("covered").cast("long").alias("covered"), ratio(F.col("covered"), F.col("spans")).alias("recall"))


def gate(baseline: DataFrame, candidate: DataFrame, most_loss: int = 0) -> DataFrame:
    """Buckets of two reports side by side with a verdict each: FAIL where more spans than ``most_loss`` are lost."""
    a = baseline.select("scope", "key", F.col("spans").alias("base_spans"), F.col("covered").alias("base_covered"))
    b = candidate.select("scope", "key", F.col("spans").alias("new_spans"), F.col("covered").alias("new_covered"))
    both = a.join(b, ["scope", "key"], "full_outer").na.fill(0, ["base_spans", "base_covered", "new_spans", "new_covered"])
    loss = F.col("base_covered") - F.col("new_covered")
    verdict = F.when(F.col("base_spans") != F.col("new_spans"), "WARN").when(loss > most_loss, "FAIL").otherwise("PASS")
    return both.withColumn("loss", loss).withColumn("verdict", verdict)


def history_upsert(history: DataFrame, runs: DataFrame) -> DataFrame:
    """History with the rows of ``runs`` in place of those of the same run."""
    return history.join(runs.select("run_id"), "run_id", "left_anti").unionByName(runs)


def iou_pairs(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of annotations of one document and action with an overlap of at least ``least`` of their union."""
    x = a.select("doc_id", "action", F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    y = b.select("doc_id", "action", F.col("id").alias("b_id"), F.col("label").alias("b_label"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    both = x.join(y, ["doc_id", "action"]).filter("a_start < b_end and b_start < a_end")
    inter = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    union = F.greatest("a_end", "b_end") - F.least("a_start", "b_start")
    return both.withColumn("iou", inter / union).filter(F.col("iou") >= least).withColumn("compatible", F.col("a_label") == F.col("b_label"))


def consensus(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy one-to-one pairs of two annotators, compatible first, then by overlap; with their intersection."""
    schema = "doc_id string, action string, a_id string, b_id string, compatible boolean, iou double, start long, end long"

    def choose(rows):
        rows = rows.sort_values(["compatible", "iou", "a_id", "b_id"], ascending=[False, False, True, True])
        left, right, keep = set(), set(), []
        for i, r in zip(rows.index, rows.itertuples(), strict=True):
            if r.a_id not in left and r.b_id not in right:
                left.add(r.a_id)
                right.add(r.b_id)
                keep.append(i)
        out = rows.loc[keep]
        out = out.assign(start=out[["a_start", "b_start"]].max(axis=1), end=out[["a_end", "b_end"]].min(axis=1), doc_id=out["doc_id"].astype(str), a_id=out["a_id"].astype(str), b_id=out["b_id"].astype(str))
        return out[["doc_id", "action", "a_id", "b_id", "compatible", "iou", "start", "end"]]

    return iou_pairs(a, b, least).groupBy("doc_id", "action").applyInPandas(choose, schema)


def gold_dedupe(gold: DataFrame) -> DataFrame:
    """Of annotations of one span, the first by id."""
    over = Window.partitionBy("doc_id", "start", "end").orderBy("id")
    return gold.withColumn("_n", F.row_number().over(over)).filter("_n = 1").drop("_n")


def gold_validate(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Annotations that break a rule, with the rule: offsets, text, or severity of a keep."""
    joined = gold.join(docs.select("doc_id", F.col("text").alias("source")), "doc_id", "left")
    problem = (
        F.when(F.col("source").isNull(), "no document")
        .when(~(F.col("end") > F.col("start")) | (F.col("start") < 0) | (F.col("end") > F.length("source")), "offsets")
        .when(F.substring("source", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"), "text")
        .when((F.col("action") == "keep") != (F.col("severity") == "none"), "severity")
    )
    return joined.withColumn("problem", problem).filter("problem is not null").drop("source")


def _sums(digest: str) -> list[Column]:
    """Two sums of 60 bits each of a column of digests: the same in any order, and combined before they meet."""
    return [F.sum(F.conv(F.substring(digest, a, 15), 16, 10).cast("decimal(38,0)")).alias(n) for a, n in ((1, "x"), (16, "y"))]


def suite_fingerprint(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """A digest of a suite's documents and annotations, whatever their order."""
    own = gold.select("doc_id", F.sha2(F.concat_ws("|", "id", "action", "label", "start", "end"), 256).alias("d")).groupBy("doc_id").agg(*_sums("d"))
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t")).join(own, "doc_id", "left")
    zero = F.lit(0).cast("decimal(38,0)")
    line = F.concat_ws("|", F.col("doc_id").cast("string"), "t", F.coalesce("x", zero).cast("string"), F.coalesce("y", zero).cast("string"))
    total = rows.select(F.sha2(line, 256).alias("d")).agg(F.count("*").alias("n"), *_sums("d"))
    return total.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.coalesce("x", zero).cast("string"), F.coalesce("y", zero).cast("string")), 256).alias("fingerprint"))


def category_buckets(documents: DataFrame, categories: DataFrame) -> DataFrame:
    """``scope, key, spans, covered, recall`` by a document's category, of scored documents and ``categories(doc_id, category)``."""
    rows = documents.join(categories.select("doc_id", "category"), "doc_id", "left").groupBy(F.coalesce("category", F.lit("uncategorized")).alias("key"))
    sums = rows.agg(F.sum("spans").alias("spans"), F.sum("covered").alias("covered"))
    return sums.select(F.lit("category").alias("scope"), "key", "spans", "covered", ratio(F.col("covered"), F.col("spans")).alias("recall"))


def gate_totals(baseline: DataFrame, candidate: DataFrame, most_keep_gain: int = 0, most_precision_drop: float = 0.0) -> DataFrame:
    """Of two one-row summaries: FAIL where keep violations rise or precision drops by more than allowed; WARN where the targets differ."""
    a, b = (x.select(*[F.col(c).alias(n + c) for c in ("spans", "keeps", "keep_violations", "precision")]) for x, n in ((baseline, "a_"), (candidate, "b_")))
    both = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")
    same = (F.col("a_spans") == F.col("b_spans")) & (F.col("a_keeps") == F.col("b_keeps"))

    def row(key: str, base: Column, new: Column, worse: Column) -> Column:
        verdict = F.when(~same, "WARN").when(worse, "FAIL").otherwise("PASS")
        return F.struct(F.lit(key).alias("key"), base.cast("double").alias("base"), new.cast("double").alias("new"), verdict.alias("verdict"))

    keeps = row("keep_violations", F.col("a_keep_violations"), F.col("b_keep_violations"), F.col("b_keep_violations") - F.col("a_keep_violations") > most_keep_gain)
    precision = row("precision", F.col("a_precision"), F.col("b_precision"), F.col("a_precision") - F.col("b_precision") > most_precision_drop)
    return both.select(F.explode(F.array(keeps, precision)).alias("r")).select("r.*")


# Severities of annotations.
SEVERITIES = ("critical", "high", "medium", "low", "none")


def batch_validate(batch: DataFrame, docs: DataFrame) -> DataFrame:
    """Problems of annotation batches, a row each: ``batch(doc_id, source_text_sha256, id, action, label, severity,
    confidence, reason, start, end, text)`` against ``docs(doc_id, text)``."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("source")).withColumn("digest", F.sha2("source", 256))
    rows = batch.join(text, "doc_id", "left")
    repeated = F.count("*").over(Window.partitionBy("doc_id", "id")) > 1
    span = F.substring("source", F.col("start") + 1, F.col("end") - F.col("start"))

    def when(bad: Column, problem: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), problem)

    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = F.array(
        when(F.col("digest") != F.col("source_text_sha256"), "digest"), when(blank("id"), "id"), when(~blank("id") & F.col("repeated"), "id repeated"), when(~F.col("action").isin("redact", "keep"), "action"),
        when(blank("label"), "label"), when(F.col("start") < 0, "start"), when(F.col("end") <= F.col("start"), "end"), when(blank("text"), "no text"), when(~F.col("severity").isin(*SEVERITIES), "severity"),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence"), when(blank("reason"), "reason"), when((F.col("action") == "keep") != (F.col("severity") == "none"), "severity of action"),
        when(span != F.col("text"), "text"),
    )
    found = F.when(F.col("digest").isNull(), F.array(F.lit("not in index"))).otherwise(F.filter(checks, lambda p: p.isNotNull()))
    return rows.withColumn("repeated", repeated).select("doc_id", "id", F.explode(found).alias("problem"))
