"""From candidates to numbered entries of a pack: merge, aliases, conflicts, tokens.

Everything is keyed by ``pack_id``: grouped aggregates and windows of (pack, value) or
(pack, kind); no step holds a pack in one task but the numbering of one kind.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.lexicons import AMBIGUOUS_NAMES, KINDS, TITLES
from quillmask.functions.ordinal import with_ordinal
from quillmask.functions.text import dedupe_norm, entry_id


def priority(kind: Column) -> Column:
    """A kind's rank among kinds of the same text; lower wins."""
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int") - 1


def settled(rows: DataFrame) -> DataFrame:
    """Rows that several later steps read: kept, and where a checkpoint folder is set without the plan behind them,
    which each reader would hold again, many times over after a few such steps."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    return kept.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else kept


def merge(candidates: DataFrame) -> DataFrame:
    """One row per (pack, kind, value): least level and position, all sources, the first reason."""
    return candidates.groupBy("pack_id", "kind", "value").agg(
        F.min("level").alias("level"),
        F.min("pos").alias("pos"),
        F.min_by("reason", "seq").alias("reason"),
        F.min("seq").alias("seq"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def resolve_exact_kind(merged: DataFrame) -> DataFrame:
    """Of one value under several kinds, the least level, then the first kind by priority."""
    over = Window.partitionBy("pack_id", "value").orderBy("level", priority(F.col("kind")))
    return merged.withColumn("rank", F.row_number().over(over)).filter("rank = 1").drop("rank")


def suppress_weaker(merged: DataFrame) -> DataFrame:
    """Drops proper nouns that are anything else, and persons that are anything stronger."""
    over = Window.partitionBy("pack_id", dedupe_norm(F.col("value")))
    other = F.max((F.col("kind") != "PROPER_NOUN").cast("int")).over(over)
    strong = F.max((~F.col("kind").isin("PERSON", "PROPER_NOUN")).cast("int")).over(over)
    kept = merged.withColumn("_o", other).withColumn("_s", strong)
    return kept.filter(~((F.col("kind") == "PROPER_NOUN") & (F.col("_o") == 1)) & ~((F.col("kind") == "PERSON") & (F.col("_s") == 1))).drop("_o", "_s")


# Contexts of aliases, with the part of a name they stand for and the reason.
_TITLED = r"\b(?:" + "|".join(TITLES) + r")\.?\s+([A-Z][A-Za-z'’-]+)"
_VERB = "testified|stated|said|confirmed|explained|denied|claimed|alleged|gave|recalled|noted|argued|wrote|admitted|replied|agreed|asked|told|signed|received"
ALIASES = (
    (_TITLED, 0, "surname", "title plus surname alias"),
    (rf"\b([A-Z][A-Za-z'’-]+?)(?:['’]s)?\s+(?:also\s+|further\s+)?(?:{_VERB})\b", 1, "surname", "bare surname in witness sentence"),
    (r"\b(?:Dear|Hi|Hello)\s+([A-Z][A-Za-z'’-]+)", 1, "surname", "surname in salutation"),
    (r"\b([A-Z][A-Za-z'’-]+\s+[A-Z][A-Za-z'’-]+)\b", 1, "ends", "first and last name alias"),
    (r"\b(?:to|from|with|by|copying)\s+([A-Z][A-Za-z'’-]+)\b", 1, "given", "given alias in communication context"),
    (r"\b([A-Z][A-Za-z-]+)['’]s\s+[Rr]esponse\b", 1, "given", "given alias in response heading"),
    (rf"\b([A-Z][A-Za-z'’-]+)\s+(?:{_VERB})\b", 1, "given", "given alias before witness verb"),
)


def person_aliases(merged: DataFrame, docs: DataFrame) -> DataFrame:
    """Parts of a pack's full names that stand in a telling context in any of its documents.

    Each context is cut out of a text once; what it holds joins the parts of the pack's
    names: surnames, first and last names of longer ones, and given names that only one has.
    """
    titles = rf"(?i)\A(?:{'|'.join(TITLES)})\.?\s+"
    names = merged.filter("kind = 'PERSON'").select("pack_id", "level", "seq", F.regexp_replace(F.regexp_replace("value", titles, ""), r"['’]s\z", "").alias("full"))
    names = names.filter(F.col("full").rlike(r"\A[A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+)+\z")).withColumn("w", F.split("full", r"\s+"))
    first, last = F.element_at("w", 1), F.element_at("w", -1)
    ends = F.when(F.size("w") > 2, F.concat_ws(" ", first, last))
    parts = names.select("pack_id", "level", "seq", "full", F.explode(F.array(
        F.struct(F.lit("surname").alias("part"), last.alias("alias")), F.struct(F.lit("ends").alias("part"), ends.alias("alias")), F.struct(F.lit("given").alias("part"), first.alias("alias")),
    )).alias("p")).select("pack_id", "level", "seq", "full", "p.*")
    parts = parts.filter((F.length("alias") > 2) | F.col("alias").isin("Li", "Xu", "Mu")).groupBy("pack_id", "part", "alias").agg(F.min_by("level", "seq").alias("level"), F.countDistinct("full").alias("n"))
    parts = parts.filter((F.col("part") != "given") | ((F.col("n") == 1) & ~F.col("alias").isin(*AMBIGUOUS_NAMES))).drop("n")
    text = F.coalesce("text", F.lit(""))

    def hits(i: int) -> Column:
        pattern, group, part, reason = ALIASES[i]
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"))
        return F.transform(both, lambda m: F.struct(m["v"].alias("value"), m["a"].alias("alias"), F.lit(part).alias("part"), F.lit(reason).alias("reason"), F.lit(i).alias("rule")))

    found = docs.select("pack_id", "doc_ord", "name", text.alias("t"), F.explode(F.array_distinct(F.flatten(F.array(*[hits(i) for i in range(len(ALIASES))])))).alias("m"))
    found = found.select("pack_id", "doc_ord", "name", "m.*", (F.instr("t", F.col("m.value")) - 1).cast("int").alias("pos"))
    return found.join(parts, ["pack_id", "part", "alias"]).select(
        "pack_id", "doc_ord", F.lit("PERSON").alias("kind"), "value", "level", "reason", "pos", F.col("name").alias("source"),
        F.struct("doc_ord", F.lit(90).alias("detector"), "rule", "pos").alias("seq"),
    )


def org_aliases(merged: DataFrame) -> DataFrame:
    """The bare name of an organisation that is known with a bracketed part."""
    bare = F.trim(F.regexp_extract("value", r"\A([^(（]{3,})[(（]", 1))
    return merged.filter("kind = 'ORG'").withColumn("bare", bare).filter("length(bare) > 2").select(
        "pack_id", F.col("seq.doc_ord").alias("doc_ord"), "kind", F.col("bare").alias("value"), "level", F.lit("organization bracket alias").alias("reason"), "pos",
        F.element_at("sources", 1).alias("source"), F.struct(F.col("seq.doc_ord").alias("doc_ord"), F.lit(91).alias("detector"), F.lit(0).alias("rule"), F.col("pos").alias("pos")).alias("seq"),
    )


def address_aliases(merged: DataFrame) -> DataFrame:
    """Prefixes of Han addresses that end like an address and hold a digit."""
    cuts = F.transform(F.sequence(F.lit(6), F.greatest(F.length("value") - 1, F.lit(6))), lambda n: F.substring("value", F.lit(1), n))
    good = F.filter(cuts, lambda v: v.rlike("[0-9]") & v.rlike("(?:号|室|楼|层|栋|幢|座|单元|弄|村|路|街)\\z"))
    rows = merged.filter((F.col("kind") == "ADDRESS") & F.col("value").rlike("[㐀-鿿]") & (F.length("value") > 6)).withColumn("v", F.explode(good))
    return rows.select(
        "pack_id", F.col("seq.doc_ord").alias("doc_ord"), "kind", F.col("v").alias("value"), "level", F.lit("Chinese address prefix alias").alias("reason"), "pos",
        F.element_at("sources", 1).alias("source"), F.struct(F.col("seq.doc_ord").alias("doc_ord"), F.lit(92).alias("detector"), F.lit(0).alias("rule"), F.col("pos").alias("pos")).alias("seq"),
    )


def norm_index(entries: DataFrame) -> DataFrame:
    """``pack_id, norm, kinds, n``: which kinds and how many values count as the same."""
    return entries.groupBy("pack_id", dedupe_norm(F.col("value")).alias("norm")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("value").alias("n"))


def sort_candidates(candidates: DataFrame) -> DataFrame:
    """``ord``, 1 to n over all packs by position, level and kind (then pack, value and document), without a task that sees them all."""
    return with_ordinal(candidates, ["pos", "level", "kind", "pack_id", "value", "doc_ord"], "ord")


def canonical_person(resolved: DataFrame) -> DataFrame:
    """``canonical``: the full name for titled forms and for surnames that only one full name of the pack has."""
    bare = F.regexp_replace("value", rf"(?i)\A(?:{'|'.join(TITLES)})\.?\s+", "")
    people = resolved.filter("kind = 'PERSON'").select("pack_id", "value", bare.alias("bare")).withColumn("surname", F.element_at(F.split("bare", r"\s+"), -1))
    full = people.filter("bare = value and bare like '% %'").groupBy("pack_id", "surname").agg(F.countDistinct("value").alias("n"), F.min("value").alias("full")).filter("n = 1")
    known = people.filter("bare = value and bare like '% %'").select("pack_id", F.col("value").alias("bare"), F.col("value").alias("known"))
    mapped = (
        people.join(full.drop("n"), ["pack_id", "surname"], "left")
        .join(known, ["pack_id", "bare"], "left")
        .select("pack_id", "value", F.coalesce("known", F.when(~F.col("bare").contains(" "), F.col("full")), F.col("value")).alias("canonical"))
    )
    return (
        resolved.join(mapped.withColumn("kind", F.lit("PERSON")), ["pack_id", "kind", "value"], "left")
        .withColumn("canonical", F.coalesce("canonical", "value"))
    )


def assign_tokens(canonical: DataFrame) -> DataFrame:
    """``replacement``: the kind and a number, by the first place of each canonical value."""
    groups = canonical.groupBy("pack_id", "kind", "canonical").agg(F.min(F.struct("pos", "level", "seq")).alias("first"))
    number = F.row_number().over(Window.partitionBy("pack_id", "kind").orderBy("first", "canonical"))
    tokens = groups.select("pack_id", "kind", "canonical", token(F.col("kind"), number).alias("replacement"))
    return canonical.join(tokens, ["pack_id", "kind", "canonical"])


def token(kind: Column, number: Column) -> Column:
    """``KIND_001``; numbers above 999 keep all their digits."""
    digits = number.cast("string")
    return F.concat(kind, F.lit("_"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def entries(candidates: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Numbered entries of each pack from gated candidates; aliases need the documents."""
    # what several later steps read is kept, or each of them would repeat all before it
    merged = merge(candidates).persist(StorageLevel.MEMORY_AND_DISK)
    if docs is not None:
        more = person_aliases(merged, docs).unionByName(org_aliases(merged)).unionByName(address_aliases(merged))
        merged = merge(candidates.unionByName(more))
    resolved = settled(suppress_weaker(resolve_exact_kind(merged)))
    numbered = assign_tokens(canonical_person(resolved).persist(StorageLevel.MEMORY_AND_DISK))
    return numbered.select(
        "pack_id", entry_id(F.col("kind"), F.col("value")).alias("id"), "value", "replacement", "kind", "level", "reason", "sources", F.lit(False).alias("manual"),
        F.lit(False).alias("match_case"), "pos",
    )


def custom_entries(terms: DataFrame) -> DataFrame:
    """Manual entries of ``terms(pack_id, ord, term)``, one per normalised term, in order."""
    from quillmask.functions.text import clean_value

    rows = terms.select("pack_id", "ord", clean_value(F.col("term")).alias("value")).filter("value <> ''").withColumn("norm", dedupe_norm(F.col("value")))
    first = rows.groupBy("pack_id", "norm").agg(F.min(F.struct("ord", "value")).alias("f")).select("pack_id", "f.ord", "f.value")
    number = F.row_number().over(Window.partitionBy("pack_id").orderBy("ord", "value"))
    return first.select(
        "pack_id", entry_id(F.lit("CUSTOM"), F.col("value")).alias("id"), "value", token(F.lit("CUSTOM"), number).alias("replacement"), F.lit("CUSTOM").alias("kind"),
        F.lit(1).alias("level"), F.lit("user custom term").alias("reason"), F.array(F.lit("manual")).alias("sources"), F.lit(True).alias("manual"),
        F.lit(False).alias("match_case"), F.lit(None).cast("int").alias("pos"),
    )


def merge_entries(detected: DataFrame, user: DataFrame, removed: DataFrame) -> DataFrame:
    """Detected entries under a user's edits: replacements by id, removals, and manual entries first."""
    edits = user.select("pack_id", "id", F.col("replacement").alias("new_replacement"), F.col("match_case").alias("new_case"))
    manual = user.filter("manual").select("pack_id", dedupe_norm(F.col("value")).alias("norm")).distinct()
    kept = detected.join(removed.select("pack_id", "id"), ["pack_id", "id"], "left_anti").join(edits, ["pack_id", "id"], "left")
    kept = kept.withColumn("norm", dedupe_norm(F.col("value")))
    overridden = kept.filter("new_replacement is null").join(manual, ["pack_id", "norm"], "left_anti").unionByName(kept.filter("new_replacement is not null"))
    overridden = overridden.withColumn("replacement", F.coalesce("new_replacement", "replacement")).withColumn("match_case", F.coalesce("new_case", "match_case"))
    own = user.join(detected.select("pack_id", "id"), ["pack_id", "id"], "left_anti").join(removed.select("pack_id", "id"), ["pack_id", "id"], "left_anti")
    return overridden.select(*detected.columns).unionByName(own.select(*detected.columns))
