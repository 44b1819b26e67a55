"""Personal data: proposed by pattern, confirmed by checksum, scored by context (operator 7).

Native DataFrame operations only; every text is read whole and nothing is shuffled.

Base kinds are ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19 digits that
pass Luhn) and ``phone`` (9 to 15 digits).  Their matches are leftmost and do not
overlap within a kind; a match that fails its check is dropped and not retried.
The patterns below are the plain ones made linear: possessive repeats where no
shorter repeat could match, and starts only where a run of the kind's characters
begins, or where the match before has ended.  ``card`` proposes only those runs
that have 13 to 19 digits, as shorter and longer ones fail anyway.

Added kinds: ``iban`` (mod-97 equal to 1), ``ssn`` (3-2-4 digits) and ``secret`` (32 to 64
hexadecimal digits).  A span's score is its kind's base score, raised by 0.2 if a context word of
the kind stands in the 40 characters before it, and lowered by 0.3 if a word there says that it
is made up.  Spans of added kinds stay from 0.5 on: ``ssn`` and ``secret`` need a context word, ``iban`` must not be
a mere sample.  Base spans stay whatever their score.  The digest has all scores.

A null text counts as empty; offsets are code points, the end exclusive.  Rows that
repeat a ``doc_id`` and null ids keep a row each.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
_NAME = "[A-Za-z0-9-]"
SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn_ok(v: Column) -> Column:
    """Whether the digits of ``v`` pass the Luhn check."""
    back = F.reverse(_digits(v))

    def term(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + term(i))
    return F.when(F.length(back) > 0, total % 10 == 0).otherwise(F.lit(False))


def mod97_ok(v: Column) -> Column:
    """Whether ``v`` without blanks is an account number with remainder 1 modulo 97."""
    s = F.regexp_replace(v, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(a: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, (a * 10 + n - 48) % 97).otherwise((a * 100 + n - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _between(v: Column, low: int, high: int) -> Column:
    return F.length(_digits(v)).between(low, high)


def _whole(pattern: str) -> str:
    """``pattern`` between two edges of ASCII words."""
    return rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Kind:
    name: str
    guard: str  # a text without it has no match
    pattern: str
    valid: object
    score: float
    context: str
    base: bool = True
    least: float = 0.0


KINDS = (
    Kind("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++", None, 0.8, "mail|contact|write to"),
    Kind(
        "ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        0.6, "(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server",
    ),
    Kind("card", r"[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", luhn_ok, 0.7, "card|visa|master|credit|payment"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", lambda v: _between(v, 9, 15), 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", _whole("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"), mod97_ok, 0.7, "iban|account|bank", False, 0.5),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-", _whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), None, 0.4, "ssn|social security", False, 0.5),
    Kind("secret", r"[0-9a-f]{32}", _whole("[0-9a-f]{32,64}"), None, 0.4, "token|secret|key|password|passwd|credential|auth|bearer", False, 0.5),
)
#: Words that say that a span is made up.
DOUBT = "sample|dummy|fake|placeholder"


def matches(text: Column, pattern: str, block: int = 256) -> Column:
    """``array<struct<start, end, value>>`` of all matches, from the texts between them.

    Places are summed up within blocks of matches, and then blocks: one long array would be copied for each match.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def moved(b: Column, by: Column) -> Column:
        return F.transform(b["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value")))

    def joined(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(blocks, first, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, starts, moved))

    def placed(pairs: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(block))
        blocks = F.transform(starts, lambda i: F.aggregate(F.slice(pairs, i, block), first, step))
        return F.when(F.size(pairs) > 0, F.element_at(F.transform(F.array(blocks), joined), 1)).otherwise(empty)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.element_at(F.transform(F.array(pairs), placed), 1)  # an array of one element binds its value


def kind_spans(text: Column, kind: Kind) -> Column:
    def scored(m: Column) -> Column:
        start = m["start"]
        before = F.lower(F.substring(text, F.greatest(start - 40, F.lit(0)) + 1, F.least(start, F.lit(40))))
        score = F.round(F.lit(kind.score) + F.when(before.rlike(kind.context), 0.2).otherwise(0.0) - F.when(before.rlike(DOUBT), 0.3).otherwise(0.0), 1)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), m["end"].alias("end"), m["value"].alias("value"), score.alias("score"))

    found = matches(text, kind.pattern)
    if kind.valid:
        found = F.filter(found, lambda m: kind.valid(m["value"]))
    spans = F.transform(found, scored)
    if kind.least:
        spans = F.filter(spans, lambda s: s["score"] >= kind.least)
    return F.when(text.rlike(kind.guard), spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``doc_id`` and one array of spans per kind, named after it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[kind_spans(text, k).alias(k.name) for k in kinds])


def digest(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text, with their number and scores."""

    def line(some: list[str]) -> Column:
        return F.array_join(F.transform(F.concat(*[F.col(n) for n in some]), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [k.name for k in kinds if k.base]
    every = F.concat(*[F.col(k.name) for k in kinds])
    return found.select(
        "doc_id",
        *[F.size(n).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(line(base), 256).alias("base_sha256"),
        line([k.name for k in kinds]).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
        F.array_join(F.transform(every, lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )


SQL = r"""
WITH kinds(kind, ord, pat, base, context) AS (VALUES
  ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0.8, 'mail|contact|write to'),
  ('ip', 2, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', 0.6, '(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server'),
  ('card', 3, '[0-9](?:[\x20-]?[0-9])+', 0.7, 'card|visa|master|credit|payment'),
  ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]', 0.7, 'phone|tel|call|mobile|fax'),
  ('iban', 5, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b', 0.7, 'iban|account|bank'),
  ('ssn', 6, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', 0.4, 'ssn|social security'),
  ('secret', 7, '\b[0-9a-f]{32,64}\b', 0.4, 'token|secret|key|password|passwd|credential|auth|bearer')
), m AS (
  SELECT doc_id, coalesce(text, '') AS text, kind, ord, base, context, regexp_extract_all(coalesce(text, ''), pat) AS ms, string_split_regex(coalesce(text, ''), pat) AS gaps
  FROM documents, kinds
), u AS (
  SELECT doc_id, text, kind, ord, base, context, unnest(ms) AS v, unnest(gaps[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0
), q AS (
  SELECT doc_id, text, kind, ord, base, context, v, regexp_replace(v, '[^0-9]', '', 'g') AS digits, replace(v, ' ', '') AS packed,
         CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS BIGINT) AS e
  FROM u
), b AS (
  SELECT *, lower(substr(text, greatest(e - length(v) - 40, 0) + 1, least(e - length(v), 40))) AS before FROM q
), p AS (
  SELECT *, round(CAST(base AS DOUBLE) + CASE WHEN regexp_matches(before, context) THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(before, 'sample|dummy|fake|placeholder') THEN 0.3 ELSE 0 END, 1) AS score FROM b
), ok AS (
  SELECT doc_id, kind, ord, e - length(v) AS s, e, score FROM p
  WHERE (ord <= 4 OR score >= 0.5) AND CASE kind
    WHEN 'ip' THEN list_bool_and([length(ltrim(x, '0')) <= 3 AND CAST('0' || right(ltrim(x, '0'), 3) AS INTEGER) <= 255 FOR x IN string_split(v, '.')])
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum([
        CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) - 9
          ELSE 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) END ELSE CAST(substr(reverse(digits), i, 1) AS INTEGER) END
        FOR i IN range(1, length(digits) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN CAST(list_aggregate([CASE WHEN ascii(x) < 58 THEN x ELSE CAST(ascii(x) - 55 AS VARCHAR) END
        FOR x IN string_split(substr(packed, 5) || substr(packed, 1, 4), '')], 'string_agg', '') AS HUGEINT) % 97 = 1
    ELSE true END
), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
         count(*) FILTER (kind = 'phone') AS n_phone, count(*) AS n_spans,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord <= 4) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans, string_agg(printf('%.1f', score), ',' ORDER BY ord, s) AS scores
  FROM ok GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN a USING (doc_id)
"""
