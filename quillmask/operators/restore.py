"""Restore keys: which tokens stand for what, and drafts turned back into originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_[0-9]{3,}(?![A-Za-z0-9_])"
ENTRY_SCHEMA = "replacement string, value string, kind string, reason string, sources array<string>, count bigint, safe boolean, ambiguous boolean"
KEY_SCHEMA = f"kind string, version int, app_version string, engine_version string, created_at string, level string, entries array<struct<{ENTRY_SCHEMA}>>"


def safe_token(replacement: Column) -> Column:
    """Whether a replacement has the form of a token with a number above zero."""
    return replacement.rlike(r"\A[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_[0-9]{3,}\z") & ~replacement.rlike(r"_0+\z")


def restore_key(counted: DataFrame) -> DataFrame:
    """Entries that occur, with whether their token is safe and stands for one value only."""
    over = Window.partitionBy("pack_id", "replacement")
    return counted.filter("match_count > 0").select(
        "pack_id", "replacement", "value", "kind", "reason", "sources", F.col("match_count").alias("count"), safe_token(F.col("replacement")).alias("safe"),
        (F.count("*").over(over) > 1).alias("ambiguous"),
    )


def restore_parse(keys: DataFrame, column: str = "json") -> DataFrame:
    """Entries of restore keys in JSON; a key of another shape fails. A missing count is 1."""
    parsed = keys.withColumn("k", F.from_json(column, KEY_SCHEMA, {"mode": "FAILFAST"}))
    checked = parsed.withColumn("k", F.when(F.col("k.entries").isNotNull() & F.col("k.version").isNotNull(), F.col("k")).otherwise(F.raise_error(F.lit("not a restore key"))))
    rows = checked.select("pack_id", F.posexplode("k.entries").alias("ord", "e")).select("pack_id", "ord", "e.*")
    last = F.max(F.struct("ord", "value", "kind", "reason", "sources", F.coalesce("count", F.lit(1).cast("long")).alias("count"), "safe", "ambiguous")).alias("m")
    return rows.groupBy("pack_id", "replacement").agg(last).select(
        "pack_id", "replacement", "m.value", "m.kind", "m.reason", "m.sources", "m.count", F.coalesce("m.safe", safe_token(F.col("replacement"))).alias("safe"),
        F.coalesce("m.ambiguous", F.lit(False)).alias("ambiguous"),
    )


def restore_scan(drafts: DataFrame, key: DataFrame) -> DataFrame:
    """``pack_id, draft_id, token, count, status`` of the tokens in drafts."""
    found = drafts.select("pack_id", "draft_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))).alias("token"))
    counted = found.groupBy("pack_id", "draft_id", "token").agg(F.count("*").alias("count"))
    known = key.groupBy("pack_id", F.col("replacement").alias("token")).agg(F.max("ambiguous").alias("ambiguous"), F.min("safe").alias("safe"))
    status = F.when(F.col("safe").isNull(), "unknown").when(F.col("ambiguous"), "ambiguous").when(~F.col("safe"), "unsafe").otherwise("restorable")
    return counted.join(known, ["pack_id", "token"], "left").select("pack_id", "draft_id", "token", "count", status.alias("status"))


def restore_text(drafts: DataFrame, key: DataFrame) -> DataFrame:
    """``restored`` drafts, with ``occurrences`` of restored values at their new places."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    parts = drafts.select("pack_id", "draft_id", F.posexplode(F.arrays_zip(F.split(text, TOKEN, -1).alias("gap"), tokens.alias("token"))).alias("ord", "p"))
    usable = key.filter("safe and not ambiguous").select("pack_id", F.col("replacement").alias("token"), "value", "kind").dropDuplicates(["pack_id", "token"])
    joined = parts.select("pack_id", "draft_id", "ord", F.coalesce("p.gap", F.lit("")).alias("gap"), F.col("p.token").alias("token")).join(usable, ["pack_id", "token"], "left")
    shown = F.coalesce("value", "token", F.lit(""))
    over = Window.partitionBy("pack_id", "draft_id").orderBy("ord")
    placed = joined.withColumn("shown", shown).withColumn("end", F.sum(F.length("gap") + F.length("shown")).over(over))
    occurrence = F.when(F.col("value").isNotNull(), F.struct("ord", "token", "value", "kind", (F.col("end") - F.length("shown")).alias("start"), "end"))
    return placed.groupBy("pack_id", "draft_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "gap", "shown"))), lambda p: F.concat(p["gap"], p["shown"])), "").alias("restored"),
        F.transform(F.array_sort(F.collect_list(occurrence)), lambda o: o.dropFields("ord")).alias("occurrences"),
    )


def restore_remaining(restored: DataFrame, key: DataFrame) -> DataFrame:
    """Known tokens that a restored draft still holds outside of its restored values."""
    text = F.col("restored")
    parts = restored.select("pack_id", "draft_id", "occurrences", F.posexplode(F.arrays_zip(F.split(text, TOKEN, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("token"))).alias("ord", "p"))
    over = Window.partitionBy("pack_id", "draft_id").orderBy("ord")
    placed = parts.select("pack_id", "draft_id", "occurrences", "ord", "p.gap", "p.token").withColumn("end", F.sum(F.length("gap") + F.coalesce(F.length("token"), F.lit(0))).over(over))
    placed = placed.filter("token is not null").withColumn("start", F.col("end") - F.length("token"))
    free = placed.filter(~F.exists("occurrences", lambda o: (o["start"] < F.col("end")) & (F.col("start") < o["end"])))
    return free.join(key.select("pack_id", F.col("replacement").alias("token")).distinct(), ["pack_id", "token"], "left_semi").select("pack_id", "draft_id", "token", "start", "end")


def restore_status(drafts: DataFrame, key: DataFrame) -> DataFrame:
    """``n unknown`` or ``n left`` (distinct tokens), else ``Draft``, or ``Empty`` for blank text, for each draft."""
    found = restore_scan(drafts, key).groupBy("pack_id", "draft_id").agg(F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_if(F.col("status") == "restorable").alias("left"))
    rows = drafts.select("pack_id", "draft_id", "text").join(found, ["pack_id", "draft_id"], "left")
    empty = F.coalesce("text", F.lit("")).rlike(r"\A\s*\z")
    text = F.when(F.col("unknown") > 0, F.concat("unknown", F.lit(" unknown"))).when(F.col("left") > 0, F.concat("left", F.lit(" left"))).when(empty, "Empty").otherwise("Draft")
    return rows.select("pack_id", "draft_id", text.alias("status"))
