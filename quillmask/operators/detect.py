"""Candidates by pattern and by label, with native column functions.

Documents are rows ``pack_id, doc_ord, doc_id, name, text``; a null text counts as empty.
A candidate is a row ``pack_id, doc_ord, kind, value, level, reason, pos, source, seq`` with
``pos`` in code points from the document's start and ``seq`` the order of detection, which is
derived from the data and so the same however rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions import checks
from quillmask.functions.dialect import java
from quillmask.functions.text import clean_value, meaningful
from quillmask.operators import rules as R

MATCH = "array<struct<pos:int,value:string>>"
RAW = "array<struct<kind:string,level:int,reason:string,value:string,pos:int,rule:int,detector:int>>"
COLUMNS = ["pack_id", "doc_ord", "kind", "value", "level", "reason", "pos", "source", "seq"]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<pos, value>>`` of the matches of a Java pattern; ``pos`` is the whole match's."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.zip_with(F.zip_with(whole, gaps, lambda w, g: F.struct(w.alias("w"), g.alias("g"))), values, lambda x, v: F.struct(x["w"].alias("w"), x["g"].alias("g"), v.alias("v")))

    def placed(rows: Column) -> Column:
        starts = starts_of(F.transform(rows, lambda x: F.length(x["g"]) + F.length(x["w"])))
        return F.zip_with(rows, starts, lambda x, s: F.struct((s + F.length(x["g"])).alias("pos"), x["v"].alias("value")))

    return F.when(text.rlike(pattern), bound(rows, placed)).otherwise(F.array().cast(MATCH))


def bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def starts_of(widths: Column, block: int = 256) -> Column:
    """Sums of all widths before each, within blocks and then of blocks: one long array would be copied for each place."""
    empty = F.array().cast("array<int>")

    def step(a: Column, w: Column) -> Column:
        return F.struct((a["at"] + w).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def joined(blocks: Column) -> Column:
        firsts = F.aggregate(F.transform(blocks, lambda b: b["at"]), zero, step, lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, firsts, lambda b, s: F.transform(b["out"], lambda x: x + s)))

    def summed(w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(block)), lambda i: F.aggregate(F.slice(w, i, block), zero, step))
        return F.when(F.size(w) > 0, bound(blocks, joined)).otherwise(empty)

    return bound(widths, summed)


def lines(text: Column) -> Column:
    """``array<struct<line_no, pos, line>>``."""
    breaks = F.regexp_extract_all(text, F.lit("\r?\n"), F.lit(0))
    parts = F.split(text, "\r?\n", -1)

    widths = F.transform(breaks, F.length)
    rows = F.zip_with(parts, widths, lambda p, n: F.struct(p.alias("l"), n.alias("n")))

    def placed(rows: Column) -> Column:
        starts = starts_of(F.transform(rows, lambda x: F.length(x["l"]) + F.coalesce(x["n"], F.lit(0))))
        numbered = F.zip_with(rows, starts, lambda x, s: F.struct(s.alias("pos"), x["l"].alias("line")))
        return F.transform(numbered, lambda x, i: F.struct(i.alias("line_no"), x["pos"].alias("pos"), x["line"].alias("line")))

    return bound(rows, placed)


def _before(text: Column, pos: Column, n: int) -> Column:
    return F.substring(text, F.greatest(pos - n, F.lit(0)) + 1, F.least(pos, F.lit(n)))


_NUMBER_LABEL = java(r"\b(?:File|Docket|Matter|Case|Charge|Claim|Reference)\s+Nos?\b\.?\s*[:#]?\s*\z", True)
_ZH_NUMBER_LABEL = "(?:发票代码|发票号码|发票号|校验码|流水号|凭证号|订单号|运单号|保单号|住院号|门诊号|病案号|病历号|出生证编号|员工编号|员工号|工号|人员编号)\\s*[：:#]\\s*\\z"
_CLINICAL = "(?:狭窄|阻塞|梗阻|钙化|闭塞|狭窄度|阻塞度|射血分数|阻塞比例)\\z"


def _kept(text: Column, rule: R.Rule, found: Column) -> Column:
    """Without the matches that a rule's own veto rejects."""
    if rule.kind == "PHONE":
        split = java(r"\A\d{1,4}[\s-]\d{1,4}\z")
        return F.filter(
            found,
            lambda m: ~(m["value"].rlike(split) & _before(text, m["pos"], 30).rlike(_NUMBER_LABEL)) & ~_before(text, m["pos"], 24).rlike(_ZH_NUMBER_LABEL),
        )
    if rule.reason == "IBAN":
        return F.filter(found, lambda m: checks.is_valid_iban(m["value"]))
    if rule.reason == "percentage":
        return F.filter(found, lambda m: ~_before(text, m["pos"], 12).rlike(_CLINICAL))
    return found


def rule_candidates(text: Column, rules: list[R.Rule], detector: int) -> Column:
    """All matches of ``rules`` in one array, in the order of rules and places."""

    def rows(i: int, rule: R.Rule) -> Column:
        found = _kept(text, rule, matches(text, rule.java, 1 if rule.grouped else 0))
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(rule.kind).alias("kind"), F.lit(rule.level).alias("level"), F.lit(rule.reason).alias("reason"), m["value"].alias("value"), m["pos"].alias("pos"),
                F.lit(i).alias("rule"), F.lit(detector).alias("detector"),
            ),
        )

    return F.flatten(F.array(*[rows(i, r) for i, r in enumerate(rules)])).cast(RAW)


def spread(docs: DataFrame) -> DataFrame:
    """A small input, as a file of one row group, over all cores; a large one has more splits than these and stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < 4 * cores else docs


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _exploded(docs: DataFrame, found: Column) -> DataFrame:
    return docs.select("pack_id", "doc_ord", "name", F.explode(found).alias("m")).select("pack_id", "doc_ord", "name", "m.*")


def detect_rules(docs: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """Raw candidates of a few direct rules, natively.

    All rules at once make a plan that takes the optimiser longer than the scan; ``scan.detect`` runs
    the whole table in one Arrow pass, with the same results.
    """
    return _exploded(docs, rule_candidates(text_of(docs), rules, 0))


def detect_bare_ids(docs: DataFrame) -> DataFrame:
    """Credit codes and identity numbers that stand by themselves, by checksum."""
    text = text_of(docs)
    found = matches(text, r"(?<![0-9A-Za-z])[0-9A-Z]{17}[0-9A-Zx](?![0-9A-Za-z])")
    id_ok = F.filter(found, lambda m: checks.is_valid_prc_id(m["value"]))
    code_ok = F.filter(found, lambda m: checks.is_valid_uscc(m["value"]) & m["value"].rlike("[A-Z]") & ~m["value"].rlike(r"(.)\1{8}"))

    def rows(f: Column, kind: str, reason: str, rule: int) -> Column:
        return F.transform(f, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("level"), F.lit(reason).alias("reason"), m["value"].alias("value"), m["pos"].alias("pos"), F.lit(rule).alias("rule"), F.lit(1).alias("detector")))

    return _exploded(
        docs,
        F.concat(
            rows(code_ok, "BUSINESS_ID", "bare Unified Social Credit Code (checksum)", 100), rows(id_ok, "NATIONAL_ID", "bare PRC resident identity number (checksum + date)", 101)
        ).cast(RAW),
    )


# Kind, reason and detector number of a caller's terms by their type.
CONFIGURED = {"organization": ("ORG", "configured organization", 6), "matter": ("PROJECT_OR_ISSUE", "configured matter term", 7), "location": ("LOCATION", "configured location", 7)}
_EXCHANGE = r"(?i)Exchanges and Clearing|Stock Exchange of Hong Kong|London Stock Exchange|Singapore Exchange"


def detect_configured(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Raw candidates of a caller's ``lexicon(pack_id, term_type, ord, term)``: its organisations as whole
    words, its matter terms and locations anywhere, whatever their case; no location inside an exchange's name."""
    terms = lexicon.select("pack_id", "term_type", "ord", clean_value(F.col("term")).alias("term")).filter(F.col("term_type").isin(*CONFIGURED) & meaningful(F.col("term")))
    terms = terms.groupBy("pack_id", "term_type", "term").agg(F.min("ord").alias("ord"))
    terms = terms.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("term_type", "ord", "term"))).alias("terms"))
    text = text_of(docs)

    def hits(t: Column) -> Column:
        found = literal_positions(text, t["term"], True)
        size = F.length(t["term"])
        whole = F.filter(found, lambda p: ~((p > 0) & F.substring(text, p, F.lit(1)).rlike(r"\A[A-Za-z0-9]")) & ~F.substring(text, p + size + 1, F.lit(1)).rlike(r"\A[A-Za-z0-9]"))
        free = F.filter(found, lambda p: ~F.regexp_replace(F.substring(text, F.greatest(p - 24, F.lit(0)) + 1, F.least(p, F.lit(24)) + size + 32), r"\s+", " ").rlike(_EXCHANGE))
        kept = F.when(t["term_type"] == "organization", whole).when(t["term_type"] == "location", free).otherwise(found)
        return F.transform(kept, lambda p: F.struct(t["term_type"].alias("type"), t["ord"].alias("rule"), F.substring(text, p + 1, size).alias("value"), p.alias("pos")))

    rows = docs.join(terms, "pack_id").select("pack_id", "doc_ord", "name", F.explode(F.flatten(F.transform("terms", hits))).alias("m"))

    def of(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in CONFIGURED.items() for x in (k, v[i])])
        return table[F.col("m.type")]

    return rows.select(
        "pack_id", "doc_ord", "name", of(0).alias("kind"), F.lit(2).alias("level"), of(1).alias("reason"), F.col("m.value").alias("value"), F.col("m.pos").alias("pos"),
        (F.col("m.rule") + 1000).cast("int").alias("rule"), of(2).alias("detector"),
    )


def literal_positions(text: Column, needle: Column, any_case: bool = False) -> Column:
    """Code-point offsets of a literal in a text, left to right without overlap."""
    quoted = F.concat(F.lit("(?iu)\\Q" if any_case else "\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(text, quoted, -1)

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p)
        return F.struct((start + F.length(needle)).alias("at"), F.concat(a["out"], F.array(start)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), zero, step, lambda a: a["out"])


def add_candidates(raw: DataFrame) -> DataFrame:
    """The gate that every raw candidate passes: cleaned, meaningful, and valid for its kind."""
    cleaned = clean_value(F.col("value"))
    value = F.when(F.col("kind") == "PHONE", checks.fix_paren_phone(cleaned, F.col("value"))).otherwise(cleaned)
    good = (
        meaningful(cleaned)
        & ((F.col("reason") != "ISIN securities identifier") | checks.is_valid_isin(cleaned))
        & ((F.col("kind") != "PHONE") | checks.gate_phone(cleaned, F.col("reason")))
        & ((F.col("kind") != "PERSON") | checks.gate_person(cleaned))
    )
    seq = F.struct("doc_ord", "detector", "rule", "pos")
    return raw.filter(good).select("pack_id", "doc_ord", "kind", value.alias("value"), "level", "reason", "pos", F.col("name").alias("source"), seq.alias("seq"))


def as_pack(docs: DataFrame, pack: str = "doc_id") -> DataFrame:
    """Documents of the ``documents`` table as packs by one of its columns, ordered by id."""
    return docs.select(
        F.col(pack).cast("string").alias("pack_id"), F.col("doc_id").cast("long").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_id"),
        F.format_string("doc-%05d.md", F.col("doc_id").cast("long")).alias("name"), "text",
    )


def sample_pack(spark: SparkSession, texts: list[str], pack: str = "p1") -> DataFrame:
    rows = [(pack, i, f"d{i}", f"doc-{i}.md", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pack_id string, doc_ord long, doc_id string, name string, text string")
