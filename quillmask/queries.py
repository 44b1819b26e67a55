"""Registered queries of the redaction engine, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions import checks
from quillmask.functions import text as T
from quillmask.functions import lexicons as L
from quillmask.functions.lexicons import IBAN_COUNTRIES, KINDS, PRC_ID_CHECKS, PRC_ID_WEIGHTS, ROLE_INBOXES, USCC_ALPHABET, USCC_WEIGHTS
from quillmask.operators import detect, notes, resolve, restore, review, rewrite, rules, scan, score
from quillmask.plans import redact as plan
from quillmask.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packs(spark: SparkSession, sf_dir: str, pack: str = "doc_id") -> DataFrame:
    return detect.as_pack(_table(spark, sf_dir, "documents"), pack)


def _rule(reason: str) -> rules.Rule:
    return next(r for r in rules.DIRECT if r.reason == reason)


def _values(rows: list[tuple], columns: str) -> str:
    """Fixture rows as SQL that both engines read."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS f({columns})"


def _fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- whole redactions ---------------------------------------------------------


@query("redact")
def _redact(spark, sf_dir):
    review = plan.redact(_packs(spark, sf_dir))
    return review.documents.select("doc_id", "original_length", F.size("segments").alias("n_segments"), "sanitized")


@query("engine_runner")
def _engine_runner(spark, sf_dir):
    counted = plan.redact(_packs(spark, sf_dir), level=1).counted()
    return counted.filter("match_count > 0").select(F.col("pack_id").alias("doc_id"), "id", "replacement", "kind", "level", "match_count")


@query("kind_counts")
def _kind_counts(spark, sf_dir):
    return rewrite.kind_counts(plan.redact(_packs(spark, sf_dir, "source")).counted())


@query("combine_markdown")
def _combine(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    docs = talks.select(
        F.col("conv_id").cast("string").alias("pack_id"), F.col("turn").cast("long").alias("doc_ord"), F.concat_ws("-", "conv_id", "turn").alias("doc_id"),
        F.concat(F.lit("turn-"), F.col("turn")).alias("name"), "text",
    )
    return plan.redact(docs, level=3).markdown()


@query("scan_candidates")
def _scan(spark, sf_dir):
    found = detect.add_candidates(scan.detect(_packs(spark, sf_dir)))
    return found.select(F.col("doc_ord").alias("doc_id"), "kind", "value", "level", "reason", "pos")




# --- rules with native matches ------------------------------------------------

_EMAIL_RE2 = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def _matches_sql(pattern: str, source: str = "documents", key: str = "doc_id") -> str:
    return rf"""
SELECT {key}, v AS value, CAST(e - length(v) AS BIGINT) AS pos FROM (
  SELECT {key}, v, sum(length(g) + length(v)) OVER (PARTITION BY {key} ORDER BY i) AS e FROM (
    SELECT {key}, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
      SELECT {key}, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM {source}) WHERE len(ms) > 0))"""


def _matched(docs: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    rows = docs.select(key, F.explode(detect.matches(F.coalesce("text", F.lit("")), pattern)).alias("m"))
    return rows.select(key, F.col("m.value").alias("value"), F.col("m.pos").cast("long").alias("pos"))


@query("detect_direct_email", _matches_sql(_EMAIL_RE2))
def _email(spark, sf_dir):
    return _matched(_table(spark, sf_dir, "documents"), _rule("email address").java)


_TEXTS = [
    (1, "Meeting on 12 March 2024, then 2024-04-01 and 03/05/2024. Q3 2023 and FY 2022; fiscal year 2021. 7-8-2020."),
    (2, "SSN 123-45-6789; EIN 12-3456789; ZIP 02110-1234; file 0001234567-21-000123; NCT01234567."),
    (3, "Exhibits C-12, R-7 and CL-3; bundle A/12/345; Day 3, pp. 12-14; H/2020/15."),
    (4, "Postcodes SW1A 2AA and K1A 0B1; docket 1:21-cv-01234 and 3:19-CR-4321."),
    (5, "HKIAC/A20123, HKIAC Arbitration No. A20123; (NY 123456); [2021] UKSC 5 and [2019] EWHC 123 (Comm)."),
    (6, "Paid 12 million and 3.5 billion, 1,200 shares, 500 ordinary shares; born in 1950 in Little Town."),
    (7, "See https://example.org/a?b=1) and www.example.com; [x](files/a.pdf); P.O. Box 123; Telegram: @abc_d; WeChat: wx_123."),
    (8, "Card ending in 1234, Visa ending in 9876, Account ending in 555; ABN: 12 345 678 901; ACN 123 456 789; SRA ID 12345."),
    (9, None),
    (10, ""),
]
_FIXED = [
    "written date", "ISO date", "slash-separated date", "quarter and year", "financial year reference", "dash-separated date", "US Social Security number",
    "US Employer Identification number", "US ZIP+4 code", "SEC EDGAR accession number", "ClinicalTrials.gov registry identifier", "exhibit reference",
    "legal authority reference", "bundle reference", "transcript reference", "UK postcode", "Canadian postcode", "US federal docket number", "case shorthand",
    "arbitration number", "attorney bar-roll initials", "UK neutral citation", "large amount", "share count", "birth year and birthplace", "URL", "post office box",
    "messaging handle label", "numeric date", "month-year date", "date range", "bare www. website URL (no scheme)", "internal matter tag", "SEC civil action number",
]


def _fixed_rules() -> list[rules.Rule]:
    return [r for r in rules.DIRECT if r.reason in _FIXED]


def _fixed_sql() -> str:
    pats = _values([(i, r.kind, r.level, r.reason, ("(?i)" if r.ignore_case else "") + r.pattern) for i, r in enumerate(_fixed_rules())], "rule, kind, level, reason, pat")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {_values(_TEXTS, 'doc_id, text')}), r AS (SELECT * FROM {pats}),
m AS (SELECT doc_id, rule, kind, level, reason, regexp_extract_all(text, pat) AS ms, string_split_regex(text, pat) AS gs FROM t, r),
u AS (SELECT doc_id, rule, kind, level, reason, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0)
SELECT doc_id, kind, level, reason, v AS value, CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id, rule ORDER BY i) - length(v) AS BIGINT) AS pos FROM u"""


@query("detect_direct_rules", _fixed_sql())
def _direct_rules(spark, sf_dir):
    docs = _fixture(spark, _TEXTS, "doc_id int, text string").select("doc_id", "text", F.lit("p").alias("pack_id"), F.col("doc_id").cast("long").alias("doc_ord"), F.lit("n").alias("name"))
    found = detect.detect_rules(docs, _fixed_rules())
    return found.select(F.col("doc_ord").alias("doc_id"), "kind", "level", "reason", "value", F.col("pos").cast("long").alias("pos"))


# --- text functions -----------------------------------------------------------

_LINES_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l)
SELECT doc_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM u"""


def _doc_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.explode(detect.lines(F.coalesce("text", F.lit("")))).alias("l"))
    return rows.select("doc_id", F.col("l.line_no").cast("long").alias("line_no"), F.col("l.line").alias("line"), F.col("l.pos").cast("long").alias("pos"))


@query("line_split", _LINES_SQL)
def _line_split(spark, sf_dir):
    return _doc_lines(spark, sf_dir)


_EDGE_RE2 = r"[\s,.;:()\[\]{}<>\"''“”‘’]+"


def _clean_sql(value: str) -> str:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        value = f"replace({value}, '{entity}', '{char}')"
    return rf"regexp_replace(regexp_replace(regexp_replace({value}, '^{_EDGE_RE2}', ''), '{_EDGE_RE2}$', ''), '\s+', ' ', 'g')"


@query("clean_value", f"SELECT doc_id, line_no, {_clean_sql('line')} AS value FROM ({_LINES_SQL})")
def _clean(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("doc_id", "line_no", T.clean_value(F.col("line")).alias("value"))


@query(
    "meaningful_filter",
    f"SELECT DISTINCT v AS value FROM (SELECT {_clean_sql('w')} AS v FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents)) WHERE length(v) >= 2 AND v NOT IN ('the', 'and', 'or', 'of', 'to', 'in', 'for', 'with')",
)
def _meaningful(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]+")).alias("w")).select(T.clean_value(F.col("w")).alias("value"))
    return words.filter(T.meaningful(F.col("value"))).distinct()


_NAMES = [(1, "Dr. Mara Quill"), (2, "mr  mara   quill's"), (3, "Mara Quill"), (4, "“Acme & Co.”"), (5, "Acme &amp; Co"), (6, "Lady Ann"), (7, "the"), (8, "Sir"), (9, "O’Brien’s"), (10, None)]


def _norm_sql(value: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({_clean_sql(value)}, '^(?i:Mr|Ms|Mrs|Miss|Dr|Professor|Prof|Sir|Dame|Lord|Lady)\.?\s+', ''), '(?i)[''’]s$', ''))"


@query("dedupe_norm", f"SELECT id, {_norm_sql('v')} AS norm FROM {_values(_NAMES, 'id, v')}")
def _norm(spark, sf_dir):
    return _fixture(spark, _NAMES, "id int, v string").select("id", T.dedupe_norm(F.col("v")).alias("norm"))


@query("lexicon_normalize", f"SELECT n AS term, min(id) AS ord FROM (SELECT id, {_clean_sql('v')} AS n FROM {_values(_NAMES, 'id, v')}) WHERE length(n) >= 2 AND n NOT IN ('the', 'and', 'or', 'of', 'to', 'in', 'for', 'with') GROUP BY n")
def _lexicon(spark, sf_dir):
    rows = _fixture(spark, _NAMES, "id int, v string").select("id", T.clean_value(F.col("v")).alias("term"))
    return rows.filter(T.meaningful(F.col("term"))).groupBy("term").agg(F.min("id").alias("ord"))


_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[*_`]', '', 'g'), '\\[ \t]*$', '')"


@query("visible_line", f"SELECT page_id, {_clean_sql(_VISIBLE)} AS value FROM pages")
def _visible(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.visible_line(F.col("html")).alias("value"))


_IDS = [("EMAIL", "a.b@example.org"), ("PERSON", "Mara Quill"), ("ORG", "Acme (UK) & Co!"), ("DATE", "1/2/2020"), ("ADDRESS", "5~6 Way's *")]


@query(
    "entry_id",
    f"SELECT kind, value, kind || ':' || replace(replace(replace(replace(replace(replace(url_encode(value), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~') AS id FROM {_values(_IDS, 'kind, value')}",
)
def _entry_id(spark, sf_dir):
    return _fixture(spark, _IDS, "kind string, value string").select("kind", "value", T.entry_id(F.col("kind"), F.col("value")).alias("id"))


_MAILS = [(1, "Accounts <accounts@x.example>"), (2, "info+eu@x.example; sales@x.example"), (3, "Ann <ann@x.example>"), (4, "no address"), (5, "help-support@x.example")]


@query(
    "role_inbox",
    rf"""SELECT id, len(ms) > 0 AND len(list_filter(ms, lambda m: NOT list_contains([{', '.join(repr(w) for w in ROLE_INBOXES)}], regexp_replace(split_part(split_part(lower(m), '@', 1), '+', 1), '[^a-z0-9]+', '', 'g'))
 AND NOT len(list_filter(string_split_regex(split_part(split_part(lower(m), '@', 1), '+', 1), '[^a-z0-9]+'), lambda w: NOT list_contains([{', '.join(repr(w) for w in ROLE_INBOXES)}], w))) = 0)) = 0 AS generic
 FROM (SELECT id, regexp_extract_all(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AS ms FROM {_values(_MAILS, 'id, v')})""",
)
def _role(spark, sf_dir):
    return _fixture(spark, _MAILS, "id int, v string").select("id", T.role_inbox(F.col("v")).alias("generic"))


# --- checksums and gates ------------------------------------------------------

_IBANS = [("GB82 WEST 1234 5698 7654 32",), ("GB82WEST12345698765433",), ("DE89370400440532013000",), ("XX89370400440532013000",), ("FR1420041010050500013M02606",), ("GB82",)]
_COUNTRIES = ", ".join(f"'{c}'" for c in IBAN_COUNTRIES)


@query(
    "is_valid_iban",
    f"""SELECT v AS value, CASE WHEN regexp_full_match(s, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}') AND substr(s, 1, 2) IN ({_COUNTRIES}) THEN
 list_reduce(list_prepend(0, [CAST(CASE WHEN ascii(x) < 58 THEN x ELSE CAST(ascii(x) - 55 AS VARCHAR) END AS BIGINT) FOR x IN string_split(substr(s, 5) || substr(s, 1, 4), '')]),
 lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1 ELSE false END AS valid FROM (SELECT v, upper(replace(v, ' ', '')) AS s FROM {_values(_IBANS, 'v')})""",
)
def _iban(spark, sf_dir):
    return _fixture(spark, _IBANS, "value string").select("value", checks.is_valid_iban(F.col("value")).alias("valid"))


_CODES = [("US0378331005",), ("US0378331006",), ("GB0002634946",), ("91350100M000100Y43",), ("91350100M000100Y44。签署日期 2020年3月5日，电话：13800138000，案号：（2021）京01民终123号",), ("11010519491231002X",), ("110105194912310021",), ("",)]


_USCC_TERMS = " + ".join(f"(instr('{USCC_ALPHABET}', substr({{v}}, {i + 1}, 1)) - 1) * {w}" for i, w in enumerate(USCC_WEIGHTS))
_PRC_TERMS = " + ".join(f"(ascii(substr({{v}}, {i + 1}, 1)) - 48) * {w}" for i, w in enumerate(PRC_ID_WEIGHTS))


def _isin_sql(v: str) -> str:
    codes = f"array_to_string([CASE WHEN ascii(x) < 58 THEN x ELSE CAST(ascii(x) - 55 AS VARCHAR) END FOR x IN string_split({v}, '')], '')"
    digit = f"CAST(substr(reverse({codes}), i, 1) AS INTEGER)"
    total = f"list_sum([CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END FOR i IN range(1, length({codes}) + 1)])"
    return f"CASE WHEN regexp_full_match({v}, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') THEN {total} % 10 = 0 ELSE false END"


def _uscc_sql(v: str) -> str:
    return f"CASE WHEN regexp_full_match({v}, '[{USCC_ALPHABET}]{{18}}') THEN (31 - ({_USCC_TERMS.format(v=v)}) % 31) % 31 = instr('{USCC_ALPHABET}', substr({v}, 18, 1)) - 1 ELSE false END"


def _prc_sql(v: str) -> str:
    u = f"upper({v})"
    born = f"TRY_CAST(substr({u}, 7, 4) || '-' || substr({u}, 11, 2) || '-' || substr({u}, 13, 2) AS DATE)"
    check = f"substr('{PRC_ID_CHECKS}', CAST(({_PRC_TERMS.format(v=u)}) % 11 + 1 AS INTEGER), 1) = substr({u}, 18, 1)"
    return f"CASE WHEN regexp_full_match({u}, '[1-9][0-9]{{16}}[0-9X]') THEN coalesce(year({born}) BETWEEN 1900 AND 2099 AND {check}, false) ELSE false END"


@query("checksums", f"SELECT value, {_isin_sql('value')} AS isin, {_uscc_sql('value')} AS uscc, {_prc_sql('value')} AS prc_id FROM {_values(_CODES, 'value')}")
def _codes(spark, sf_dir):
    v = F.col("value")
    return _fixture(spark, _CODES, "value string").select("value", checks.is_valid_isin(v).alias("isin"), checks.is_valid_uscc(v).alias("uscc"), checks.is_valid_prc_id(v).alias("prc_id"))


_PHONES = [("(415) 555-0134", "x"), ("2024.03.12", "x"), ("2024-03-12", "x"), ("1-2-2024", "x"), ("02110-1234", "x"), ("12-345678", "x"), ("20240312", "x"), ("123", "phone extension label"), ("123", "x"), ("1234567890123456", "x"), ("@abc", "messaging handle label")]


@query(
    "gate_phone",
    rf"""SELECT v AS value, reason, (length(d) >= 7 OR reason IN ('phone extension label', 'messaging handle label', 'skype live: handle label')) AND length(d) <= 15
 AND NOT regexp_full_match(v, '[0-9]{{4}}\.[0-9]{{2}}\.[0-9]{{2}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2,4}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{5}}-[0-9]{{4}}|[0-9]{{1,3}}-[0-9]{{5,6}}')
 AND NOT regexp_full_match(d, '(19|20)[0-9]{{6}}') AS good FROM (SELECT v, reason, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM {_values(_PHONES, 'v, reason')})""",
)
def _gate(spark, sf_dir):
    return _fixture(spark, _PHONES, "value string, reason string").select("value", "reason", checks.gate_phone(F.col("value"), F.col("reason")).alias("good"))


# --- candidates, entries, tokens ---------------------------------------------

_CANDS = [
    ("p", "PERSON", "Mara Quill", 2, 5), ("p", "ORG", "Mara Quill", 2, 9), ("p", "PROPER_NOUN", "Mara Quill", 3, 1), ("p", "PHONE", "2024-001", 1, 4), ("p", "BUSINESS_ID", "2024-001", 1, 7),
    ("p", "PERSON", "Ann Lee", 1, 3), ("p", "PROPER_NOUN", "Ann Lee's", 3, 2), ("q", "PERSON", "Mara Quill", 1, 0), ("q", "DATE", "1 May 2020", 2, 8), ("q", "DATE", "2 May 2020", 2, 6),
]
_CANDS_SQL = _values(_CANDS, "pack_id, kind, value, level, pos")
_PRIORITY = "list_position([" + ", ".join(f"'{k}'" for k in KINDS) + "], kind)"


@query("resolve_exact_kind", f"SELECT pack_id, kind, value, level, pos FROM {_CANDS_SQL} QUALIFY row_number() OVER (PARTITION BY pack_id, value ORDER BY level, {_PRIORITY}) = 1")
def _exact(spark, sf_dir):
    return resolve.resolve_exact_kind(_fixture(spark, _CANDS, "pack_id string, kind string, value string, level int, pos int"))


@query(
    "suppress_weaker",
    f"""SELECT pack_id, kind, value, level, pos FROM (SELECT *, max(CAST(kind <> 'PROPER_NOUN' AS INT)) OVER w AS o, max(CAST(kind NOT IN ('PERSON', 'PROPER_NOUN') AS INT)) OVER w AS s
 FROM (SELECT *, {_norm_sql('value')} AS n FROM {_CANDS_SQL}) WINDOW w AS (PARTITION BY pack_id, n)) WHERE NOT (kind = 'PROPER_NOUN' AND o = 1) AND NOT (kind = 'PERSON' AND s = 1)""",
)
def _suppress(spark, sf_dir):
    return resolve.suppress_weaker(_fixture(spark, _CANDS, "pack_id string, kind string, value string, level int, pos int"))


def _email_candidates(spark, sf_dir) -> DataFrame:
    return detect.add_candidates(detect.detect_rules(_packs(spark, sf_dir, "source"), [_rule("email address")]))


_EMAILS_SQL = f"SELECT d.source AS pack_id, CAST(m.doc_id AS BIGINT) AS doc_ord, m.value, m.pos FROM ({_matches_sql(_EMAIL_RE2)}) m JOIN documents d USING (doc_id)"


@query("candidate_add", f"SELECT pack_id, value, min(pos) AS pos, count(DISTINCT doc_ord) AS n_sources FROM ({_EMAILS_SQL}) GROUP BY pack_id, value")
def _add(spark, sf_dir):
    merged = resolve.merge(_email_candidates(spark, sf_dir))
    return merged.select("pack_id", "value", F.col("pos").cast("long").alias("pos"), F.size("sources").cast("long").alias("n_sources"))


@query(
    "token_assign",
    f"""SELECT pack_id, value, 'EMAIL_' || lpad(CAST(row_number() OVER (PARTITION BY pack_id ORDER BY pos, doc_ord, first) AS VARCHAR), 3, '0') AS replacement
 FROM (SELECT pack_id, value, min(pos) AS pos, min(doc_ord) AS doc_ord, arg_min(pos, doc_ord * 100000000 + pos) AS first FROM ({_EMAILS_SQL}) GROUP BY pack_id, value)""",
)
def _tokens(spark, sf_dir):
    return resolve.entries(_email_candidates(spark, sf_dir)).select("pack_id", "value", "replacement")


@query("exact_index", f"SELECT pack_id, value, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM {_CANDS_SQL} GROUP BY pack_id, value")
def _index(spark, sf_dir):
    rows = _fixture(spark, _CANDS, "pack_id string, kind string, value string, level int, pos int")
    return rows.groupBy("pack_id", "value").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("norm_index", f"SELECT pack_id, {_norm_sql('value')} AS norm, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(DISTINCT value) AS n FROM {_CANDS_SQL} GROUP BY 1, 2")
def _norms(spark, sf_dir):
    return resolve.norm_index(_fixture(spark, _CANDS, "pack_id string, kind string, value string, level int, pos int"))


@query(
    "sort_candidates",
    f"SELECT pack_id, doc_ord, value, row_number() OVER (ORDER BY pos, pack_id, value, doc_ord) AS ord FROM (SELECT DISTINCT pack_id, doc_ord, value, pos FROM ({_EMAILS_SQL}))",
)
def _sorted(spark, sf_dir):
    found = _email_candidates(spark, sf_dir).select("pack_id", "doc_ord", "value", "pos", "level", "kind").distinct()
    return resolve.sort_candidates(found).select("pack_id", F.col("doc_ord").cast("long").alias("doc_ord"), "value", F.col("ord").cast("long").alias("ord"))


_TERMS = [("p", 1, "Falcon"), ("p", 2, " falcon. "), ("p", 3, "Blue Sky"), ("q", 1, "Falcon"), ("q", 2, "")]


@query(
    "custom_entries",
    f"""SELECT pack_id, value, 'CUSTOM_' || lpad(CAST(row_number() OVER (PARTITION BY pack_id ORDER BY ord) AS VARCHAR), 3, '0') AS replacement FROM (
 SELECT pack_id, {_clean_sql('term')} AS value, ord FROM {_values(_TERMS, 'pack_id, ord, term')} WHERE {_clean_sql('term')} <> '' QUALIFY row_number() OVER (PARTITION BY pack_id, lower({_clean_sql('term')}) ORDER BY ord) = 1)""",
)
def _custom(spark, sf_dir):
    return resolve.custom_entries(_fixture(spark, _TERMS, "pack_id string, ord int, term string")).select("pack_id", "value", "replacement")


# --- scoring ------------------------------------------------------------------
# Gold: the mail addresses of documents, some shifted; predicted: their matches.

_SPANS_SQL = f"SELECT doc_id, pos AS start, pos + length(value) AS \"end\", value AS text FROM ({_matches_sql(_EMAIL_RE2)})"
_GOLD_SQL = f"""SELECT doc_id, CAST(start AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN 'keep' ELSE 'redact' END AS action, CASE WHEN doc_id % 2 = 0 THEN 'EMAIL' ELSE 'CONTACT' END AS label,
 CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS severity, start + (doc_id % 4) * 3 AS start, "end" + (doc_id % 4) * 3 AS "end" FROM ({_SPANS_SQL})"""


def _spans(spark, sf_dir) -> DataFrame:
    found = _matched(_table(spark, sf_dir, "documents"), _rule("email address").java)
    return found.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + F.length("value")).alias("end"), F.col("value").alias("text"))


def _gold(spark, sf_dir) -> DataFrame:
    shift = (F.col("doc_id") % 4) * 3
    return _spans(spark, sf_dir).select(
        "doc_id", F.col("start").cast("string").alias("id"), F.when(F.col("doc_id") % 5 == 0, "keep").otherwise("redact").alias("action"),
        F.when(F.col("doc_id") % 2 == 0, "EMAIL").otherwise("CONTACT").alias("label"), F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low").alias("severity"),
        (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"),
    )


_OVERLAPPING_SQL = f"""SELECT doc_id, start, "end" FROM ({_SPANS_SQL}) UNION ALL SELECT doc_id, start + 2, "end" + 2 FROM ({_SPANS_SQL})"""
_UNION_SQL = f"""SELECT g.doc_id, g.id, g.action, g.label, g.severity, g.start, g."end", count(DISTINCT c) AS covered FROM ({_GOLD_SQL}) g
 LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(start, "end")) AS c FROM ({_OVERLAPPING_SQL})) p ON p.doc_id = g.doc_id AND c >= g.start AND c < g."end" GROUP BY ALL"""
_COVERED_SQL = f"""SELECT g.doc_id, g.id, g.action, g.label, g.severity, g.start, g."end", coalesce(CAST(sum(greatest(0, least(g."end", p."end") - greatest(g.start, p.start))) AS BIGINT), 0) AS covered
 FROM ({_GOLD_SQL}) g LEFT JOIN ({_SPANS_SQL}) p ON p.doc_id = g.doc_id AND p.start < g."end" AND g.start < p."end" GROUP BY ALL"""
_STATUS_SQL = f"""SELECT *, "end" - start AS size, CASE WHEN covered >= 0.8 * ("end" - start) THEN 'covered' WHEN covered > 0 THEN 'partial' ELSE 'missed' END AS status FROM ({_COVERED_SQL})"""
_DOC_SQL = f"""
WITH s AS ({_STATUS_SQL}), p AS (SELECT DISTINCT doc_id, start, "end" FROM ({_SPANS_SQL})), g AS ({_GOLD_SQL}),
a AS (SELECT doc_id, count(*) FILTER (action = 'redact') AS spans, count(*) FILTER (action = 'redact' AND status = 'covered') AS covered, count(*) FILTER (action = 'redact' AND status = 'partial') AS partial,
 count(*) FILTER (action = 'redact' AND status = 'missed') AS missed, coalesce(CAST(sum(size) FILTER (action = 'redact') AS BIGINT), 0) AS chars, coalesce(CAST(sum(covered) FILTER (action = 'redact') AS BIGINT), 0) AS covered_chars,
 count(*) FILTER (action = 'keep') AS keeps, count(*) FILTER (action = 'keep' AND covered > 0) AS keep_violations FROM s GROUP BY doc_id),
b AS (SELECT p.doc_id, CAST(sum("end" - start) AS BIGINT) AS predicted_chars,
 CAST(sum((SELECT coalesce(sum(least(p."end", g."end") - greatest(p.start, g.start)), 0) FROM g WHERE g.action = 'redact' AND g.doc_id = p.doc_id AND g.start < p."end" AND p.start < g."end")) AS BIGINT) AS right_chars,
 count(*) AS predicted, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.start < p."end" AND p.start < g."end")) AS unsupported FROM p GROUP BY p.doc_id)
SELECT a.doc_id, spans, covered, partial, missed, chars, covered_chars, keeps, keep_violations, predicted_chars, right_chars, predicted, unsupported FROM a JOIN b USING (doc_id)"""


@query("covered_chars", _UNION_SQL)
def _covered(spark, sf_dir):
    spans = _spans(spark, sf_dir).select("doc_id", "start", "end")
    return score.covered_chars(_gold(spark, sf_dir), spans.unionByName(spans.select("doc_id", (F.col("start") + 2).alias("start"), (F.col("end") + 2).alias("end"))))


@query("score_document", _DOC_SQL)
def _score_document(spark, sf_dir):
    return score.score_document(_gold(spark, sf_dir), _spans(spark, sf_dir))


@query(
    "score_suite",
    f"""SELECT *, CASE WHEN spans = 0 THEN 1.0 ELSE covered / spans END AS span_recall, r AS char_recall, CASE WHEN keeps = 0 THEN 1.0 ELSE (keeps - keep_violations) / keeps END AS keep_clean, q AS precision,
 CASE WHEN r + q = 0 THEN 0.0 ELSE 2 * r * q / (r + q) END AS char_f1 FROM (SELECT *, CASE WHEN chars = 0 THEN 1.0 ELSE covered_chars / chars END AS r, CASE WHEN predicted_chars = 0 THEN 1.0 ELSE right_chars / predicted_chars END AS q FROM (
 SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in 'spans covered partial missed chars covered_chars keeps keep_violations predicted_chars right_chars predicted unsupported'.split())} FROM ({_DOC_SQL})))""".replace("SELECT *, CASE WHEN spans", "SELECT * EXCLUDE (r, q), CASE WHEN spans"),
)
def _score_suite(spark, sf_dir):
    return score.summarize(_score_document(spark, sf_dir))


_BUCKETS_SQL = f"""SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'all' END AS scope, coalesce(label, severity, 'all') AS key, count(*) AS spans,
 count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'covered') / count(*) AS recall FROM ({_STATUS_SQL}) WHERE action = 'redact' GROUP BY GROUPING SETS ((label), (severity), ())"""


@query("score_buckets", _BUCKETS_SQL)
def _buckets(spark, sf_dir):
    return score.buckets(score.score_spans(_gold(spark, sf_dir), _spans(spark, sf_dir)))


@query(
    "gate",
    f"""WITH a AS ({_BUCKETS_SQL}), b AS ({_BUCKETS_SQL.replace('0.8 *', '0.3 *')}) SELECT coalesce(a.scope, b.scope) AS scope, coalesce(a.key, b.key) AS key, coalesce(b.spans, 0) AS base_spans, coalesce(b.covered, 0) AS base_covered,
 coalesce(a.spans, 0) AS new_spans, coalesce(a.covered, 0) AS new_covered, coalesce(b.covered, 0) - coalesce(a.covered, 0) AS loss,
 CASE WHEN coalesce(b.spans, 0) <> coalesce(a.spans, 0) THEN 'WARN' WHEN coalesce(b.covered, 0) - coalesce(a.covered, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM a FULL JOIN b ON a.scope = b.scope AND a.key = b.key""",
)
def _gate_reports(spark, sf_dir):
    gold, spans = _gold(spark, sf_dir), _spans(spark, sf_dir)
    return score.gate(score.buckets(score.score_spans(gold, spans, 0.3)), score.buckets(score.score_spans(gold, spans)))


_SUITE_SQL = ORACLE_SQL["score_suite"]


@query(
    "gate_totals",
    f"""WITH a AS ({_SUITE_SQL.replace('0.8 *', '0.3 *')}), b AS ({_SUITE_SQL}), r AS (SELECT 'keep_violations' AS key, CAST(a.keep_violations AS DOUBLE) AS base, CAST(b.keep_violations AS DOUBLE) AS new, b.keep_violations > a.keep_violations AS worse,
 a.spans = b.spans AND a.keeps = b.keeps AS same FROM a, b UNION ALL SELECT 'precision', a.precision, b.precision, a.precision > b.precision, a.spans = b.spans AND a.keeps = b.keeps FROM a, b)
 SELECT key, base, new, CASE WHEN NOT same THEN 'WARN' WHEN worse THEN 'FAIL' ELSE 'PASS' END AS verdict FROM r""",
)
def _gate_totals(spark, sf_dir):
    gold, spans = _gold(spark, sf_dir), _spans(spark, sf_dir)
    return score.gate_totals(score.summarize(score.score_document(gold, spans, 0.3)), score.summarize(score.score_document(gold, spans)))


@query(
    "category_buckets",
    f"""SELECT 'category' AS scope, coalesce(d.source, 'uncategorized') AS key, CAST(sum(spans) AS BIGINT) AS spans, CAST(sum(covered) AS BIGINT) AS covered, CASE WHEN sum(spans) = 0 THEN 1.0 ELSE sum(covered) / sum(spans) END AS recall
 FROM ({_DOC_SQL}) s LEFT JOIN documents d USING (doc_id) GROUP BY 2""",
)
def _categories(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"))
    return score.category_buckets(_score_document(spark, sf_dir), docs)


_BATCH_SQL = f"""SELECT g.doc_id, g.id, g.action, g.label, g.severity, g.start, g."end", CASE WHEN g.doc_id % 7 = 0 THEN '' ELSE 'r' END AS reason, CASE WHEN g.doc_id % 6 = 0 THEN 1.5 END AS confidence,
 sha256(coalesce(d.text, '')) AS digest, substr(d.text, CAST(g.start AS BIGINT) + 1, CAST(g."end" - g.start AS BIGINT)) AS text, d.text AS source FROM ({_GOLD_SQL}) g JOIN documents d USING (doc_id)"""


@query(
    "batch_validate",
    f"""WITH b AS ({_BATCH_SQL}), c AS (SELECT doc_id, id, [CASE WHEN action NOT IN ('redact', 'keep') THEN 'action' END, CASE WHEN coalesce(text, '') = '' THEN 'no text' END,
  CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END, CASE WHEN reason = '' THEN 'reason' END, CASE WHEN (action = 'keep') <> (severity = 'none') THEN 'severity of action' END] AS ps FROM b)
 SELECT doc_id, id, p AS problem FROM (SELECT doc_id, id, unnest(ps) AS p FROM c) WHERE p IS NOT NULL UNION ALL SELECT doc_id + 1000000000, id, 'not in index' FROM b WHERE doc_id % 3 = 0""",
)
def _batch_validate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    gold = _gold(spark, sf_dir).join(docs.withColumn("source_text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumnRenamed("text", "t"), "doc_id")
    gold = gold.withColumn("text", F.substring("t", F.col("start") + 1, F.col("end") - F.col("start"))).drop("t")
    gold = gold.withColumn("reason", F.when(F.col("doc_id") % 7 == 0, "").otherwise("r")).withColumn("confidence", F.when(F.col("doc_id") % 6 == 0, 1.5))
    lost = gold.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return score.batch_validate(gold.unionByName(lost), docs)


@query(
    "consensus",
    f"""SELECT CAST(a.doc_id AS VARCHAR) AS doc_id, a.action, a.id AS a_id, b.id AS b_id, a.label = 'EMAIL' AS compatible, (least(a."end", b."end") - greatest(a.start, b.start)) / (greatest(a."end", b."end") - least(a.start, b.start)) AS iou,
 greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM ({_GOLD_SQL}) a JOIN (SELECT doc_id, CAST(start AS VARCHAR) AS id, start, "end" FROM ({_SPANS_SQL})) b
 ON a.doc_id = b.doc_id AND a.action = 'redact' AND a.start < b."end" AND b.start < a."end" WHERE iou >= 0.5
 QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.id ORDER BY iou DESC, b.id) = 1 AND row_number() OVER (PARTITION BY b.doc_id, b.id ORDER BY iou DESC, a.id) = 1""",
)
def _consensus(spark, sf_dir):
    gold = _gold(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    other = _spans(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("start").cast("string").alias("id"), F.lit("redact").alias("action"), F.lit("EMAIL").alias("label"), "start", "end")
    return score.consensus(gold, other)


@query(
    "consensus_pairs",
    f"""SELECT a.doc_id, a.id AS a_id, b.id AS b_id, (least(a."end", b."end") - greatest(a.start, b.start)) / (greatest(a."end", b."end") - least(a.start, b.start)) AS iou FROM ({_GOLD_SQL}) a
 JOIN (SELECT doc_id, CAST(start AS VARCHAR) AS id, start, "end" FROM ({_SPANS_SQL})) b ON a.doc_id = b.doc_id AND a.action = 'redact' AND a.start < b."end" AND b.start < a."end"
 WHERE (least(a."end", b."end") - greatest(a.start, b.start)) / (greatest(a."end", b."end") - least(a.start, b.start)) >= 0.5""",
)
def _pairs(spark, sf_dir):
    other = _spans(spark, sf_dir).select("doc_id", F.col("start").cast("string").alias("id"), F.lit("redact").alias("action"), F.lit("EMAIL").alias("label"), "start", "end")
    return score.iou_pairs(_gold(spark, sf_dir), other).select("doc_id", "a_id", "b_id", "iou")


@query("gold_dedupe", f'SELECT doc_id, id, action, label, severity, start, "end" FROM ({_GOLD_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY id) = 1')
def _gold_dedupe(spark, sf_dir):
    return score.gold_dedupe(_gold(spark, sf_dir))


_RUNS = [("r1", 0.5), ("r2", 0.6)], [("r2", 0.7), ("r3", 0.8)]


@query("score_history_upsert", f"SELECT * FROM {_values(_RUNS[0], 'run_id, recall')} WHERE run_id NOT IN ('r2', 'r3') UNION ALL SELECT * FROM {_values(_RUNS[1], 'run_id, recall')}")
def _history(spark, sf_dir):
    old, new = (_fixture(spark, r, "run_id string, recall double") for r in _RUNS)
    return score.history_upsert(old, new)


def _sums_sql(digest: str) -> str:
    return ", ".join(f"CAST(sum(CAST('0x' || substr({digest}, {a}, 15) AS BIGINT)) AS VARCHAR) AS {n}" for a, n in ((1, "x"), (16, "y")))


@query(
    "suite_fingerprint",
    f"""WITH g AS (SELECT doc_id, {_sums_sql('d')} FROM (SELECT doc_id, sha256(id || '|' || action || '|' || label || '|' || start || '|' || "end") AS d FROM ({_GOLD_SQL})) GROUP BY doc_id),
 t AS (SELECT count(*) AS n, {_sums_sql('d')} FROM (SELECT sha256(doc_id || '|' || sha256(coalesce(text, '')) || '|' || coalesce(x, '0') || '|' || coalesce(y, '0')) AS d FROM documents LEFT JOIN g USING (doc_id)))
 SELECT sha256(n || '|' || coalesce(x, '0') || '|' || coalesce(y, '0')) AS fingerprint FROM t""",
)
def _fingerprint(spark, sf_dir):
    return score.suite_fingerprint(_table(spark, sf_dir, "documents"), _gold(spark, sf_dir))


# --- restoring ----------------------------------------------------------------

_KEY = [("p", "EMAIL_001", "a@x.example", 2, True), ("p", "PERSON_001", "Mara Quill", 1, False), ("p", "PERSON_001", "Quill", 1, False), ("p", "DATE_000", "1 May", 1, False), ("p", "X", "y", 1, False), ("p", "ORG_1234", "Acme", 3, True)]
_DRAFTS = [("p", "d1", "Write EMAIL_001 and EMAIL_001 for PERSON_001."), ("p", "d2", "DATE_000 CASE_REF_009 ORG_1234"), ("p", "d3", "none"), ("p", "d4", None), ("p", "d5", " \n"), ("p", "d6", "EMAIL_001 EMAIL_001 ORG_1234"), ("p", "d7", "ZIP_004 ZIP_004 EMAIL_001")]
_TOKEN_RE2 = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_[0-9]{3,}\b"


def _key(spark) -> DataFrame:
    rows = _fixture(spark, [r[:4] for r in _KEY], "pack_id string, replacement string, value string, match_count long")
    return restore.restore_key(rows.withColumns({"kind": F.regexp_extract("replacement", "^[A-Z_]*[A-Z]", 0), "reason": F.lit("r"), "sources": F.array(F.lit("s"))}))


@query(
    "restore_key",
    rf"SELECT pack_id, replacement, value, n AS count, regexp_full_match(replacement, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*_[0-9]{{3,}}') AND NOT regexp_matches(replacement, '_0+$') AS safe, count(*) OVER (PARTITION BY pack_id, replacement) > 1 AS ambiguous FROM {_values([r[:4] for r in _KEY], 'pack_id, replacement, value, n')}",
)
def _restore_key(spark, sf_dir):
    return _key(spark).select("pack_id", "replacement", "value", "count", "safe", "ambiguous")


@query(
    "restore_scan",
    rf"""WITH k AS (SELECT pack_id, replacement AS token, bool_and(regexp_full_match(replacement, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*_[0-9]{{3,}}') AND NOT regexp_matches(replacement, '_0+$')) AS safe, count(*) > 1 AS ambiguous FROM {_values([r[:4] for r in _KEY], 'pack_id, replacement, value, n')} GROUP BY ALL),
 t AS (SELECT pack_id, draft_id, token, count(*) AS count FROM (SELECT pack_id, draft_id, unnest(regexp_extract_all(coalesce(text, ''), '{_TOKEN_RE2}')) AS token FROM {_values(_DRAFTS, 'pack_id, draft_id, text')}) GROUP BY ALL)
 SELECT t.pack_id, draft_id, t.token, count, CASE WHEN k.token IS NULL THEN 'unknown' WHEN ambiguous THEN 'ambiguous' WHEN NOT safe THEN 'unsafe' ELSE 'restorable' END AS status FROM t LEFT JOIN k ON k.pack_id = t.pack_id AND k.token = t.token""",
)
def _restore_scan(spark, sf_dir):
    return restore.restore_scan(_fixture(spark, _DRAFTS, "pack_id string, draft_id string, text string"), _key(spark))


@query("restore_text", f"SELECT draft_id, replace(replace(coalesce(text, ''), 'EMAIL_001', 'a@x.example'), 'ORG_1234', 'Acme') AS restored FROM {_values(_DRAFTS, 'pack_id, draft_id, text')}")
def _restore_text(spark, sf_dir):
    return restore.restore_text(_fixture(spark, _DRAFTS, "pack_id string, draft_id string, text string"), _key(spark)).select("draft_id", "restored")


_SCAN_SQL = ORACLE_SQL["restore_scan"]


@query(
    "restore_status",
    f"""SELECT d.pack_id, d.draft_id, CASE WHEN u > 0 THEN u || ' unknown' WHEN l > 0 THEN l || ' left' WHEN regexp_full_match(coalesce(d.text, ''), '\\s*') THEN 'Empty' ELSE 'Draft' END AS status
 FROM {_values(_DRAFTS, 'pack_id, draft_id, text').replace('AS f(', 'AS d(')} LEFT JOIN (SELECT pack_id, draft_id, count(*) FILTER (status = 'unknown') AS u, count(*) FILTER (status = 'restorable') AS l
 FROM ({_SCAN_SQL}) GROUP BY ALL) s ON s.pack_id = d.pack_id AND s.draft_id = d.draft_id""",
)
def _restore_status(spark, sf_dir):
    return restore.restore_status(_fixture(spark, _DRAFTS, "pack_id string, draft_id string, text string"), _key(spark))


# --- sources ------------------------------------------------------------------


@query(
    "index_docs",
    "SELECT doc_id, format('doc-{:03d}', row_number() OVER (ORDER BY source, doc_id)) AS name, sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_sha256 FROM documents",
)
def _index_docs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return readers.index_docs(docs.select("doc_id", F.col("source").alias("path"), "text"))


@query("ext_filter", "SELECT name, regexp_matches(lower(name), '\\.(md|markdown|txt|docx|pdf)$') AS supported FROM (VALUES ('a.md'), ('b.TXT'), ('c.doc'), ('d.docx'), ('e'), ('f.pdf')) AS t(name)")
def _ext(spark, sf_dir):
    rows = _fixture(spark, [(n,) for n in ("a.md", "b.TXT", "c.doc", "d.docx", "e", "f.pdf")], "name string")
    return rows.select("name", readers.is_supported(F.col("name")).alias("supported"))


_RUN_ITEMS = [(1, 0, "Hello", 10.0, 700.0, 30.0, 12.0), (1, 1, "world", 45.0, 700.0, 30.0, 12.0), (1, 2, "Next", 10.0, 680.0, 25.0, 12.0), (2, 0, "Page two", 10.0, 700.0, 50.0, 12.0)]


@query("pdf_reconstruct")
def _pdf(spark, sf_dir):
    return readers.reconstruct_pdf(_fixture(spark, _RUN_ITEMS, "page int, item_ord int, str string, x double, y double, width double, height double").withColumn("doc_id", F.lit("d")))


@query("engine_version", f"SELECT '{plan.ENGINE_VERSION}' AS version, {len(rules.DIRECT) + len(rules.LABELS)} AS general_rules, {len(rules.HAN) + len(rules.HAN_LABELS)} AS han_rules")
def _version(spark, sf_dir):
    return spark.range(1).select(F.lit(plan.ENGINE_VERSION).alias("version"), F.lit(len(rules.DIRECT) + len(rules.LABELS)).alias("general_rules"), F.lit(len(rules.HAN) + len(rules.HAN_LABELS)).alias("han_rules"))


# --- review -------------------------------------------------------------------

_ENTRIES = [("p", "a@x.example", "EMAIL_001", "EMAIL", "email address", 3), ("p", "Mara Quill", "PERSON_001", "PERSON", "title plus person name", 2), ("p", "Falcon", "CUSTOM_002", "CUSTOM", "user custom term", 0), ("q", "Acme", "ORG_001", "ORG", "organization suffix", 1)]
_ENTRY_COLUMNS = "pack_id, value, replacement, kind, reason, match_count"


def _entries(spark) -> DataFrame:
    rows = _fixture(spark, _ENTRIES, "pack_id string, value string, replacement string, kind string, reason string, match_count long")
    return rows.withColumn("sources", F.array(F.concat("pack_id", F.lit("-mail.md"))))


@query("entry_search", f"SELECT pack_id, value FROM {_values(_ENTRIES, _ENTRY_COLUMNS)} WHERE contains(lower(value || '|' || replacement || '|' || kind || '|' || reason), 'person')")
def _search(spark, sf_dir):
    return review.entry_search(_entries(spark), "PERSON").select("pack_id", "value")


@query("entry_group", f"SELECT kind, count(*) AS n, CAST(sum(match_count) AS BIGINT) AS matches, CAST({_PRIORITY} AS INTEGER) AS display_order FROM {_values(_ENTRIES, _ENTRY_COLUMNS)} GROUP BY kind")
def _group(spark, sf_dir):
    return review.entry_group(_entries(spark))


@query("entry_totals", f"SELECT count(*) AS rules, CAST(sum(match_count) AS BIGINT) AS replacements, count(*) || ' rules, ' || sum(match_count) || ' replacements' AS text FROM {_values(_ENTRIES, _ENTRY_COLUMNS)} WHERE match_count > 0")
def _totals(spark, sf_dir):
    return review.entry_totals(_entries(spark))


@query("entry_add_manual", f"SELECT pack_id, 'CUSTOM_' || lpad(CAST(max(coalesce(TRY_CAST(regexp_extract(replacement, '^CUSTOM_([0-9]+)$', 1) AS INTEGER), 0)) + 1 AS VARCHAR), 3, '0') AS replacement FROM {_values(_ENTRIES, _ENTRY_COLUMNS)} GROUP BY pack_id")
def _manual(spark, sf_dir):
    return review.next_custom(_entries(spark))


@query("possessive", "SELECT v AS value, CASE WHEN regexp_matches(v, '(?i)[''’]s$') THEN 'X_001''s' ELSE 'X_001' END AS shown FROM (VALUES ('Ann''s'), ('Ann’S'), ('Anns'), ('')) AS t(v)")
def _possessive(spark, sf_dir):
    rows = _fixture(spark, [("Ann's",), ("Ann’S",), ("Anns",), ("",)], "value string")
    return rows.select("value", T.possessive(F.col("value"), F.lit("X_001")).alias("shown"))


_ANCHORED = [(1, '<span id="_Toc12" class="anchor"></span>Intro'), (2, "[Intro [1](#_Toc1)](#_Toc1)"), (3, "see [x](#_Toc9) and [y](z)"), (4, "plain")]


@query(
    "strip_anchors",
    r"SELECT id, regexp_replace(regexp_replace(regexp_replace(v, '(?i)<span\s+id=\"_Toc[0-9]+\"\s+class=\"anchor\"\s*></span>', '', 'g'), '\[([^\[\]\n]+?)\s+\[([0-9]+)\]\(#_Toc[0-9]+\)\]\(#_Toc[0-9]+\)', '\1 \2', 'g'), '\[([^\[\]\n]+)\]\(#_Toc[0-9]+\)', '\1', 'g') AS text FROM "
    + _values(_ANCHORED, "id, v"),
)
def _anchors(spark, sf_dir):
    return _fixture(spark, _ANCHORED, "id int, v string").select("id", T.strip_anchors(F.col("v")).alias("text"))


@query(
    "preview_search",
    """SELECT h.doc_id, h.start, h.start + 11 AS "end", substr(text, greatest(h.start - 54, 0) + 1, 11 + least(h.start, 54) + 54) AS snippet, EXISTS (SELECT 1 FROM ("""
    + _SPANS_SQL
    + """) s WHERE s.doc_id = h.doc_id AND s.start < h.start + 11 AND h.start < s."end") AS redacted FROM (
 SELECT doc_id, text, CAST(sum(length(g) + 11) OVER (PARTITION BY doc_id ORDER BY i) - 11 AS BIGINT) AS start FROM (
  SELECT doc_id, text, unnest(gs[1:len(gs) - 1]) AS g, generate_subscripts(gs[1:len(gs) - 1], 1) AS i FROM (SELECT doc_id, text, string_split(lower(text), 'example.com') AS gs FROM documents) WHERE len(gs) > 1)) h""",
)
def _preview(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = review.preview_search(docs, _spans(spark, sf_dir), "Example.com")
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "snippet", "redacted")


def _mail_review(spark, sf_dir) -> DataFrame:
    """Documents redacted by the rule of mail addresses alone, which SQL can follow."""
    docs = _packs(spark, sf_dir)
    return rewrite.apply_entries(docs, resolve.entries(detect.add_candidates(detect.detect_rules(docs, [_rule("email address")]))), 1)


@query("predicted_spans", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, start, \"end\", 'EMAIL' AS kind, text FROM ({_SPANS_SQL})")
def _predicted(spark, sf_dir):
    found = score.predicted_spans(_mail_review(spark, sf_dir))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "text")


@query("mail_counts", f"SELECT CAST(doc_id AS VARCHAR) AS pack_id, 'EMAIL' AS kind, count(*) AS count FROM ({_SPANS_SQL}) GROUP BY doc_id")
def _mail_counts(spark, sf_dir):
    docs = _packs(spark, sf_dir)
    found = resolve.entries(detect.add_candidates(detect.detect_rules(docs, [_rule("email address")])))
    return rewrite.kind_counts(rewrite.entry_counts(found, rewrite.apply_entries(docs, found, 1)))


@query("reconstruct", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents")
def _reconstruct(spark, sf_dir):
    return score.reconstruct(plan.redact(_packs(spark, sf_dir), level=1).documents)


_NEEDLES = [("d", 1, "redact", "Ann Lee", "PERSON", "high", None), ("d", 2, "redact", "Lee", "PERSON", "low", None), ("d", 3, "keep", "met", "OTHER", "none", 1), ("d", 4, "redact", "a.b", "URL", "low", None)]


@query("gold_build")
def _gold_build(spark, sf_dir):
    docs = _fixture(spark, [("d", "Ann Lee met Lee; they met at a.b, not axb.")], "doc_id string, text string")
    return review.gold_build(docs, _fixture(spark, _NEEDLES, "doc_id string, item_ord int, action string, needle string, label string, severity string, most int"))


@query(
    "gold_validate",
    f"""SELECT doc_id, id, problem FROM (SELECT g.doc_id, g.id, CASE WHEN d.text IS NULL THEN 'no document' WHEN NOT g."end" > g.start OR g.start < 0 OR g."end" > length(d.text) THEN 'offsets'
 WHEN substr(d.text, g.start + 1, g."end" - g.start) <> 'x' THEN 'text' WHEN (g.action = 'keep') <> (g.severity = 'none') THEN 'severity' END AS problem FROM ({_GOLD_SQL}) g LEFT JOIN documents d USING (doc_id)) WHERE problem IS NOT NULL""",
)
def _gold_validate(spark, sf_dir):
    gold = _gold(spark, sf_dir).withColumn("text", F.lit("x"))
    return score.gold_validate(gold, _table(spark, sf_dir, "documents")).select("doc_id", "id", "problem")


def _touched_sql(severity: str) -> str:
    return f"""EXISTS (SELECT 1 FROM g WHERE g.severity = '{severity}' AND g.doc_id = p.doc_id AND p.start < g."end" AND g.start < p."end")"""


@query(
    "prediction_support",
    f"""WITH g AS ({_GOLD_SQL}), p AS (SELECT DISTINCT doc_id, start, "end" FROM ({_SPANS_SQL}))
 SELECT CASE WHEN {_touched_sql('high')} THEN 'confirmed' WHEN {_touched_sql('low')} THEN 'uncertain' ELSE 'unsupported' END AS support, count(*) AS spans, CAST(sum("end" - start) AS BIGINT) AS chars FROM p GROUP BY 1""",
)
def _support(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    return review.prediction_support(_spans(spark, sf_dir), gold.filter("severity = 'high'"), gold.filter("severity = 'low'"))


@query(
    "report_render",
    f"""SELECT '| scope | key | spans | covered | recall |' || chr(10) || '|-|-|-|-|-|' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS markdown
 FROM (SELECT printf('| %s | %s | %d | %d | %.1f %% |', scope, key, spans, covered, recall * 100) AS line FROM ({_BUCKETS_SQL}))""",
)
def _report(spark, sf_dir):
    return review.report_markdown(_buckets(spark, sf_dir))


_RESTORE_JSON = '{"kind": "restore-key", "version": 1, "level": "light", "entries": [{"replacement": "EMAIL_001", "value": "a@x.example", "kind": "EMAIL", "reason": "r", "sources": ["s"]}, {"replacement": "EMAIL_001", "value": "b@x.example", "kind": "EMAIL", "reason": "r", "sources": [], "count": 4}]}'


@query(
    "restore_parse",
    f"""SELECT 'p' AS pack_id, e->>'$.replacement' AS replacement, e->>'$.value' AS value, e->>'$.kind' AS kind, e->>'$.reason' AS reason, CAST(e->'$.sources' AS VARCHAR[]) AS sources,
 coalesce(CAST(e->>'$.count' AS BIGINT), 1) AS count, regexp_full_match(e->>'$.replacement', '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*_[0-9]{{3,}}') AS safe, false AS ambiguous
 FROM (SELECT unnest(CAST('{_RESTORE_JSON}'::JSON->'$.entries' AS JSON[])) AS e, generate_subscripts(CAST('{_RESTORE_JSON}'::JSON->'$.entries' AS JSON[]), 1) AS i)
 QUALIFY row_number() OVER (PARTITION BY e->>'$.replacement' ORDER BY i DESC) = 1""",
)
def _restore_parse(spark, sf_dir):
    return restore.restore_parse(_fixture(spark, [("p", _RESTORE_JSON)], "pack_id string, json string"))


@query(
    "restore_remaining",
    f"""SELECT 'p' AS pack_id, draft_id, v AS token, pos AS start, pos + length(v) AS "end" FROM (
 SELECT draft_id, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY draft_id ORDER BY i) AS BIGINT) - length(v) AS pos FROM (SELECT draft_id, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
  SELECT draft_id, regexp_extract_all(restored, '{_TOKEN_RE2}') AS ms, string_split_regex(restored, '{_TOKEN_RE2}') AS gs FROM ({ORACLE_SQL['restore_text']})))) WHERE list_contains({[r[1] for r in _KEY]}, v)""",
)
def _remaining(spark, sf_dir):
    drafts = _fixture(spark, _DRAFTS, "pack_id string, draft_id string, text string")
    return restore.restore_remaining(restore.restore_text(drafts, _key(spark)), _key(spark))


@query(
    "merge_entries",
    f"""WITH e AS (SELECT pack_id, value, 'EMAIL:' || replace(url_encode(value), '%7E', '~') AS id, replacement FROM ({ORACLE_SQL['token_assign']}))
 SELECT pack_id, id, CASE WHEN id = min(id) OVER (PARTITION BY pack_id) THEN 'HIDDEN' ELSE replacement END AS replacement FROM e""",
)
def _merge_entries(spark, sf_dir):
    detected = resolve.entries(_email_candidates(spark, sf_dir))
    first = detected.groupBy("pack_id").agg(F.min("id").alias("id"))
    user = detected.join(first, ["pack_id", "id"], "left_semi").withColumn("replacement", F.lit("HIDDEN"))
    return resolve.merge_entries(detected, user, first.limit(0)).select("pack_id", "id", "replacement")


_NOTES = [
    (1, "---\nslug: a\ntitle: T: x\ndate: May\nsummary: s\n---\n## Head *x* <b>\n\nA `c<` and ==m== **s** *e* & \"q\"\nnext\n\n- one\n- *two*\n\n1. a\n2. b\n\n> q1\n>q2\n\n![al](p.png \"cap\")\n\n![](q.png)\n\n- no\nlist"),
    (2, "no front"), (3, "---\nslug: a\ntitle:\ndate: May\nsummary: s\n---\ntext"), (4, None), (5, "---\nslug: a\ntitle: t\ndate: May\ndatetime: 2024-05-01\nsummary: s\n---\n"),
]


def _notes(spark, sf_dir) -> DataFrame:
    """The documents as bodies of notes, and some notes with all forms of blocks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("---\nslug: s\ntitle: t\ndate: d\nsummary: x\n---\n"), F.coalesce("text", F.lit(""))).alias("source"))
    return docs.withColumnRenamed("doc_id", "note_id").unionByName(_fixture(spark, [(-i, t) for i, t in _NOTES], "note_id long, source string"))


@query("note_parse")
def _note_parse(spark, sf_dir):
    return notes.note_parse(_notes(spark, sf_dir)).select("note_id", "slug", "title", "date", "datetime", "summary", "problem", F.size("blocks").alias("n_blocks"), F.to_json("blocks").alias("blocks"))


@query("note_render")
def _note_render(spark, sf_dir):
    return notes.note_render(notes.note_parse(_notes(spark, sf_dir)))


# --- detectors by name, on fixtures -------------------------------------------

_LETTERS = [
    "From: Ann Lee <ann.lee@x.example>, accounts@x.example\nTo: Bo Chen (Acme LLP) <bo@y.example>\nClient: Blue Sky Trading Limited\nRef: AB-12; CD-34\nAttention:\nMara Quill\nAddress: 12 Baker Street\nSuite 5, Tower Block\n\nDear Sir",
    "Inventors: Ann Lee, Springfield (US); Bo Chen, Leeds (GB)\n         Carl Diaz, Lyon (FR)\nAssignee: Acme Corp",
    "Before: Ann Lee, Commissioner\n          Bo Chen\nMARA QUILL, Plaintiff, v. CARL DIAZ, Defendant\n<td>JOHN SMITH</td>\nMARY JONES",
    "This lease is between Ann Lee (the \"Tenant\") and Bo Chen, Carl Diaz and Mara Quill.\nSigned\n/s/ Ann Lee\nName: Bo Chen\nWitness Statement of Carl Diaz\nMr. Diaz testified. Bo's response. Dear Lee,",
    "Project Falcon ran in London and New York. Falcon needs product candidate AB-123. Grand Lake Pier opened. Grand Lake Pier closed. Grand Lake Pier fell. London Stock Exchange rules.",
    "100 Main Street\nBoston, MA 02110\nP.O. Box 12\nAttn: Mara Quill\nBo Chen\nthe second floor\nCarl Diaz\n\nAnn Lee",
    "住址：\n北京市海淀区\n中关村大街1号\n联系人：张伟\n地址：上海市浦东新区世纪大道100号\n环球金融中心20楼\n甲方：北京蓝天科技有限公司\n乙方：李明\n由王小明与赵强就买卖事宜\n审 判 长 王 建 国\n授权代表签字（刘洋）\n请李女士联系。身份证号：11010519491231002X\n统一社会信用代码 91350100M000100Y43 与 91350100M000100Y44。签署日期 2020年3月5日，电话：13800138000，案号：（2021）京01民终123号",
    None, "",
]
_DETECTORS = {
    "detect_labels": "detector = 2 and reason like '%label'", "detect_recipients": "reason = 'email recipient display name'", "detect_label_cont": "reason = 'label continuation value'",
    "detect_addr_cont": "reason = 'address continuation'", "detect_addr_line": "reason = 'standalone address-looking line'", "detect_addr_tail": "reason like 'address-tail%'",
    "detect_people": "kind = 'PERSON' and detector = 5", "detect_inventors": "reason = 'patent inventor name'", "detect_person_lists": "reason = 'title-case person in list'",
    "detect_person_lines": "reason = 'standalone title-case person line'", "detect_attention": "reason like 'attention block%'", "detect_caption_personnel": "reason like 'caption-block%'",
    "detect_caption_party": "reason = 'caption party name'", "detect_preamble_party": "reason = 'contract preamble party'", "detect_signature": "reason = 'signature block name'",
    "detect_orgs": "kind = 'ORG' and detector = 6", "detect_matter": "reason like 'project%'", "detect_product_code": "reason = 'product-candidate code'", "detect_locations": "reason in ('common location', 'patent inventor/assignee residence')",
    "detect_proper_nouns": "kind = 'PROPER_NOUN'", "detect_zh_direct": "detector = 1 and rule < 200", "detect_zh_labels": "detector = 1 and rule between 200 and 299",
    "detect_zh_addr_block": "reason = 'Chinese multi-line labeled address'", "detect_zh_addr_wrap": "reason = 'Chinese wrapped labeled address'", "detect_zh_orgs": "reason like 'Chinese context organization%'",
    "detect_zh_party": "reason like 'Chinese party role%'", "detect_zh_agreement": "reason = 'Chinese agreement party heading'", "detect_zh_signature": "reason like 'Chinese signature%'",
    "detect_zh_court": "reason = 'Chinese court signature name'", "detect_zh_honorific": "reason = 'Chinese honorific-suffixed name'",
}


_LEXICON = [("organization", 1, "Mountain example"), ("organization", 2, "mail4.example"), ("organization", 3, "Blue Sky"), ("matter", 1, " licensed UNDER "), ("matter", 2, "Falcon"), ("location", 1, "example.com"), ("location", 2, "london"), ("location", 3, "the")]


def _with_letters(spark, sf_dir) -> DataFrame:
    return _packs(spark, sf_dir, "source").unionByName(detect.sample_pack(spark, _LETTERS, "letters"))


#: What SQL reads of the same documents and letters.
_BOTH_SQL = f"SELECT source AS pack_id, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'letters', i, coalesce(t, '') FROM {_values(list(enumerate(_LETTERS)), 'i, t')}"


@query(
    "detect_configured",
    f"""WITH l AS (SELECT type, regexp_replace(trim(term), '\\s+', ' ', 'g') AS term FROM {_values([r for r in _LEXICON if r[2] != 'the'], 'type, ord, term')}),
 s AS (SELECT pack_id, doc_id, text, type, term, string_split(lower(text), lower(term)) AS gs FROM ({_BOTH_SQL}), l),
 u AS (SELECT pack_id, doc_id, text, type, term, unnest(gs[1:len(gs) - 1]) AS g, generate_subscripts(gs[1:len(gs) - 1], 1) AS i FROM s WHERE len(gs) > 1),
 p AS (SELECT *, CAST(sum(length(g) + length(term)) OVER (PARTITION BY pack_id, doc_id, type, term ORDER BY i) AS BIGINT) - length(term) AS pos FROM u)
 SELECT pack_id, doc_id, CASE type WHEN 'organization' THEN 'ORG' WHEN 'matter' THEN 'PROJECT_OR_ISSUE' ELSE 'LOCATION' END AS kind, 2 AS level,
  CASE type WHEN 'organization' THEN 'configured organization' WHEN 'matter' THEN 'configured matter term' ELSE 'configured location' END AS reason, substr(text, pos + 1, length(term)) AS value, pos FROM p
 WHERE CASE type WHEN 'organization' THEN NOT regexp_matches(substr(text, pos, CASE WHEN pos > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, pos + length(term) + 1, 1), '[A-Za-z0-9]')
  WHEN 'location' THEN NOT regexp_matches(regexp_replace(substr(text, greatest(pos - 24, 0) + 1, least(pos, 24) + length(term) + 32), '\\s+', ' ', 'g'), '(?i)Exchanges and Clearing|Stock Exchange of Hong Kong|London Stock Exchange|Singapore Exchange') ELSE true END""",
)
def _configured(spark, sf_dir):
    docs = _with_letters(spark, sf_dir)
    terms = _fixture(spark, _LEXICON, "term_type string, ord int, term string").join(docs.select("pack_id").distinct())
    return detect.detect_configured(docs, terms).select("pack_id", F.col("doc_ord").alias("doc_id"), "kind", "level", "reason", "value", F.col("pos").cast("long").alias("pos"))


_RUNS18_SQL = f"""SELECT pack_id, doc_id, v, pos FROM (SELECT pack_id, doc_id, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY pack_id, doc_id ORDER BY i) AS BIGINT) - length(v) AS pos FROM (
 SELECT pack_id, doc_id, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (SELECT pack_id, doc_id, regexp_extract_all(text, '[0-9A-Za-z]+') AS ms, string_split_regex(text, '[0-9A-Za-z]+') AS gs FROM ({_BOTH_SQL})) WHERE len(ms) > 0))
 WHERE regexp_full_match(v, '[0-9A-Z]{{17}}[0-9A-Zx]')"""


@query(
    "detect_bare_ids",
    f"""WITH r AS ({_RUNS18_SQL}) SELECT pack_id, doc_id, 'NATIONAL_ID' AS kind, v AS value, pos FROM r WHERE {_prc_sql('v')}
 UNION ALL SELECT pack_id, doc_id, 'BUSINESS_ID', v, pos FROM r WHERE {_uscc_sql('v')} AND regexp_matches(v, '[A-Z]') AND NOT regexp_matches(v, '{'|'.join(c + '{9}' for c in USCC_ALPHABET)}')""",
)
def _bare(spark, sf_dir):
    return detect.detect_bare_ids(_with_letters(spark, sf_dir)).select("pack_id", F.col("doc_ord").alias("doc_id"), "kind", "value", F.col("pos").cast("long").alias("pos"))


def _detector(condition: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan.detect(_with_letters(spark, sf_dir)).filter(condition).select("pack_id", F.col("doc_ord").alias("doc_id"), "kind", "level", "reason", "value", F.col("pos").cast("long").alias("pos"))

    return run


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _person_sql(v: str) -> str:
    """``scan.looks_like_person`` of a value."""
    bare = rf"regexp_replace(regexp_replace({v}, '^(?i:{'|'.join(L.TITLES)})\.?\s+', ''), '[''’]s$', '')"
    bad = _listed([*L.PERSON_STOPS, *L.AGENCY_WORDS, *sorted(scan._SMALL)])
    own = "list_filter([trim(regexp_replace(x, '[''’]s$', ''), '\"''“”‘’.,;:()-') FOR x IN ws], lambda x: x <> '' AND NOT regexp_full_match(x, '[A-Z]\\.?'))"
    lead, terms = _listed(L.LEADING_WORDS), _listed(L.CONTRACT_TERMS)

    def cut(x: str) -> str:
        return f"list_transform([{x}], lambda o: CASE WHEN len(o) > 1 AND list_contains({lead}, o[1]) THEN o[2:] ELSE o END)[1]"

    term = f"(len({own}) >= 2 AND list_transform([{cut(cut(own))}], lambda o: list_contains({terms}, o[1]) OR len(list_filter(o, lambda x: list_contains({terms}, x))) >= 2)[1])"
    words = (
        f"len(ws) BETWEEN 2 AND 4 AND len(list_filter(ws, lambda w: (length(w) >= 2 AND regexp_full_match(w, '[^a-z]*[A-Z][^a-z]*')) OR list_contains({bad}, w))) = 0"
        f" AND NOT list_contains({_listed(L.ORG_NAME_TAILS)}, ws[-1]) AND NOT list_contains({_listed(L.HEADING_ENDINGS)}, regexp_replace(ws[-1], '\\.$', '')) AND NOT {term}"
    )
    return (
        f"list_transform([{bare}], lambda b: NOT regexp_matches(b, '\\b(Stock\\s+Exchange|Exchanges?\\s+and\\s+Clearing|Exchange\\s+Limited)\\b')"
        f" AND len(list_filter({_listed(L.PERSON_PHRASES)}, lambda p: contains(b, p))) = 0"
        f" AND list_transform([list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '')], lambda ws: {words})[1])[1]"
    )


_NAME_RE2 = scan.NAME.replace("'", "''")


def _hits_sql(pattern: str, group: int, source: str = _BOTH_SQL) -> str:
    """``pack_id, doc_id, text, w, v, pos``: matches with one group's value and the match's place."""
    return f"""SELECT pack_id, doc_id, text, w, v, CAST(sum(length(g) + length(w)) OVER (PARTITION BY pack_id, doc_id ORDER BY i) AS BIGINT) - length(w) AS pos FROM (
 SELECT pack_id, doc_id, text, unnest(ms) AS w, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
  SELECT pack_id, doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS gs FROM ({source})) WHERE len(ms) > 0)"""


def _found_sql(pattern: str, group: int, kind: str, level: int, reason: str, where: str = "true") -> str:
    return f"SELECT pack_id, doc_id, {kind} AS kind, {level} AS level, {reason} AS reason, v AS value, pos FROM ({_hits_sql(pattern, group)}) WHERE {where}"


_TITLE_SQL = "array_to_string([upper(substr(x, 1, 1)) || lower(substr(x, 2)) FOR x IN regexp_extract_all(v, '[A-Za-z]+|[^A-Za-z]+')], '')"
_HAN_PERSON = "regexp_full_match(v, '[一-鿿]{2,6}') AND NOT regexp_matches(v, '公司|集团|中心|银行|医院|学校|大学|局|厂|店|社|所|院')"
_ROLE_RE2 = "(?:甲方|乙方|丙方|丁方|戊方|己方)\\s*(?:[（(][^）)\\r\\n]{0,12}[）)])?\\s*[：:]\\s*([^\\s，,。；;（(]{2,40})"
_AGREED_RE2 = "由([一-鿿（）()A-Za-z0-9·]{2,40}?)与([一-鿿（）()A-Za-z0-9·]{2,40}?)就"
_JUDGES_RE2 = "(?:审\\s*判\\s*长|审\\s*判\\s*员|书\\s*记\\s*员|人\\s*民\\s*陪\\s*审\\s*员|代\\s*理\\s*审\\s*判\\s*员)\\s*[:：]?\\s*([一-鿿](?:\\s*[一-鿿]){1,3})\\s*(?:\\r?\\n|$)"
_PHRASES_SQL = _hits_sql("\\b[A-Z][A-Za-z''’-]+(?: [A-Z][A-Za-z''’-]+){1,4}\\b", 0)
_LISTS_SQL = _hits_sql(rf"\b{_NAME_RE2}(?:(?:[^\S\r\n]*,[^\S\r\n]*|[^\S\r\n]*,?[^\S\r\n]+and[^\S\r\n]+){_NAME_RE2})+", 0)
_PROJECT_RE2 = "\\bProject\\s+([A-Z][A-Za-z0-9-]{2,})\\b"
ORACLE_SQL |= {
    "detect_matter": _found_sql(_PROJECT_RE2, 0, "'PROJECT_OR_ISSUE'", 1, "'project name'") + " UNION ALL " + _found_sql(_PROJECT_RE2, 1, "'PROJECT_OR_ISSUE'", 1, "'project codename alias'", "length(v) > 3"),
    "detect_product_code": _found_sql(
        "\\b[A-Z]{2,4}-[0-9]{3}\\b", 0, "'BRAND'", 2, "'product-candidate code'",
        "regexp_matches(substr(text, greatest(pos - 40, 0) + 1, least(pos, 40) + length(w) + 40), '(?i)product\\s+candidate|drug\\s+candidate')",
    ),
    "detect_zh_agreement": " UNION ALL ".join(_found_sql(_AGREED_RE2, g, "CASE WHEN length(v) <= 4 THEN 'PERSON' ELSE 'ORG' END", 2, "'Chinese agreement party heading'") for g in (1, 2)),
    "detect_zh_party": _found_sql(_ROLE_RE2, 1, f"CASE WHEN {_HAN_PERSON} THEN 'PERSON' ELSE 'ORG' END", 2, f"CASE WHEN {_HAN_PERSON} THEN 'Chinese party role (individual)' ELSE 'Chinese party role (organization)' END"),
    "detect_zh_signature": _found_sql("(?:签字|签名|签章|签署|授权代表)[^\\r\\n（(]{0,8}[（(]([一-鿿·]{2,4})[）)]", 1, "'PERSON'", 2, "'Chinese signature / authorization name'"),
    "detect_zh_court": f"SELECT pack_id, doc_id, kind, level, reason, regexp_replace(value, '\\s+', '', 'g') AS value, pos FROM ({_found_sql(_JUDGES_RE2, 1, chr(39) + 'PERSON' + chr(39), 2, chr(39) + 'Chinese court signature name' + chr(39))})",
    "detect_preamble_party": _found_sql(scan._PARTY.pattern.replace("'", "''"), 1, "'PERSON_OR_ORG'", 2, "'contract preamble party'", _person_sql("v")),
    "detect_caption_party": _found_sql(scan._CAPTION_PARTY.pattern.replace("'", "''"), 1, "'PERSON'", 2, "'caption party name'", _person_sql(_TITLE_SQL)),
    "detect_proper_nouns": f"SELECT pack_id, doc_id, 'PROPER_NOUN' AS kind, 3 AS level, 'repeated capitalized phrase' AS reason, v AS value, min(pos) AS pos FROM ({_PHRASES_SQL}) GROUP BY pack_id, doc_id, v HAVING count(*) >= 3 OR count(*) = 2 AND {_person_sql('v')}",
}
ORACLE_SQL["detect_person_lists"] = f"""SELECT pack_id, doc_id, 'PERSON' AS kind, 2 AS level, 'title-case person in list' AS reason, v AS value, base + CAST(e AS BIGINT) - length(v) AS pos FROM (
 SELECT *, sum(length(g) + length(v)) OVER (PARTITION BY pack_id, doc_id, base ORDER BY i) AS e FROM (
  SELECT pack_id, doc_id, base, unnest(ns) AS v, unnest(gs[1:len(ns)]) AS g, generate_subscripts(ns, 1) AS i FROM (
   SELECT pack_id, doc_id, pos AS base, regexp_extract_all(w, '{_NAME_RE2}') AS ns, string_split_regex(w, '{_NAME_RE2}') AS gs FROM ({_LISTS_SQL})))) WHERE {_person_sql('v')}"""

# Detectors that go by lines: ``k`` numbers a document's lines, ``s`` is a line without blanks at its ends.
_ROWS_SQL = f"""SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS s, lead(line) OVER d AS next_line, lead(pos) OVER d AS next_pos FROM (
 SELECT pack_id, doc_id, line, i AS k, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY pack_id, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM (
  SELECT pack_id, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT pack_id, doc_id, string_split(text, chr(10)) AS ls FROM ({_BOTH_SQL})))) WINDOW d AS (PARTITION BY pack_id, doc_id ORDER BY k)"""
_PLAIN_SQL = _clean_sql("regexp_replace(line, '<[^>]+>|[*_`]', '', 'g')")
_STREETS_RE2 = "|".join(L.STREETS)
_ADDRESS_RE2 = f"(?i)\\b(?:{_STREETS_RE2})\\b|\\b(?:{'|'.join(L.UNITS + L.BUILDINGS)})\\b|\\b[0-9]+\\s*/\\s*F\\b"
_NUMBERED_RE2 = f"\\b[0-9]+[A-Za-z]?\\s+(?:[A-Z][A-Za-z''’-]+\\s+){{1,5}}(?:{_STREETS_RE2})\\b"
_TAIL_RE2 = f"\\s*([A-Z][A-Za-z .''-]+),\\s*(?:{'|'.join(L.US_STATES)})\\.?(?:\\s+([0-9]{{5}}(?:-[0-9]{{4}})?))?\\s*"
_STREET_LINE_SQL = f"""SELECT *, t AS v FROM (SELECT *, {_PLAIN_SQL} AS t FROM ({_ROWS_SQL})) WHERE length(t) BETWEEN 8 AND 100 AND regexp_matches(t, '{_NUMBERED_RE2}') AND NOT regexp_matches(t, '[.!?]\\s+[A-Z][a-z]+ [a-z]+')"""
_EMPTY_LABEL_RE2 = "(?i)(?:[-*]\\s+)?(To|From|Cc|Client|Prepared for|Attention|Attn|Contact Person)\\s*[:：]"
_ATTENTION_RE2 = f"^\\s*(?:Attention|Attn)\\.?\\s*[:：]?\\s*({_NAME_RE2})"
_INVENTOR_RE2 = "^\\s*(?:\\([0-9]+\\)\\s*)?(?:Inventors?|Applicants?)\\s*[:：]\\s*(.+)"
_PERSONNEL_RE2 = "^" + scan._PERSONNEL.pattern
_MAIL_RE2 = scan._MAIL.pattern


def _line_sql(kind: str, level: int, reason: str, value: str, source: str, pos: str = "pos") -> str:
    return f"SELECT pack_id, doc_id, {kind} AS kind, {level} AS level, {reason} AS reason, {value} AS value, {pos} AS pos FROM ({source})"


def _names_of_lines(condition: str, reason: str, level: int, source: str) -> str:
    """Names in ``src`` of the lines that meet a condition."""
    return _line_sql("'PERSON'", level, reason, "v", f"SELECT * FROM (SELECT *, unnest(regexp_extract_all(src, '{_NAME_RE2}')) AS v FROM ({source}) WHERE {condition}) WHERE {_person_sql('v')}")


_BARE_SQL = f"SELECT *, regexp_replace(t, '^(?:[-*]\\s+|Dear\\s+)', '') AS v FROM (SELECT *, {_PLAIN_SQL} AS t FROM ({_ROWS_SQL}))"
ORACLE_SQL |= {
    "detect_label_cont": _line_sql(
        f"CASE WHEN {_person_sql('v')} THEN 'PERSON' ELSE 'PERSON_OR_ORG' END", 1, "'label continuation value'", "v",
        f"SELECT * FROM (SELECT *, {_clean_sql('next_line')} AS v FROM ({_ROWS_SQL}) WHERE next_line IS NOT NULL AND regexp_full_match(s, '{_EMPTY_LABEL_RE2}')) WHERE regexp_matches(v, '^[A-Z]') AND length(v) <= 80 AND NOT regexp_matches(v, '{_MAIL_RE2}')", "next_pos",
    ),
    "detect_addr_line": _line_sql("'ADDRESS'", 1, "'standalone address-looking line'", "t", _STREET_LINE_SQL),
    "detect_addr_tail": _line_sql("'LOCATION'", 1, "'address-tail city-state line'", f"regexp_extract(next_line, '{_TAIL_RE2}', 1)", f"SELECT * FROM ({_STREET_LINE_SQL}) WHERE regexp_full_match(next_line, '{_TAIL_RE2}')", "next_pos")
    + " UNION ALL " + _line_sql("'POSTCODE'", 1, "'address-tail ZIP'", f"regexp_extract(next_line, '{_TAIL_RE2}', 2)", f"SELECT * FROM ({_STREET_LINE_SQL}) WHERE regexp_full_match(next_line, '{_TAIL_RE2}') AND regexp_extract(next_line, '{_TAIL_RE2}', 2) <> ''", "next_pos"),
    "detect_addr_cont": _line_sql("'ADDRESS'", 1, "'address continuation'", "t", f"""SELECT * FROM (SELECT *, max(CASE WHEN head THEN k END) OVER before AS last_head, max(CASE WHEN stop THEN k END) OVER before AS last_stop FROM (
 SELECT *, regexp_full_match(s, '(?i)(?:[-*]\\s+)?Address\\s*[:：].*') AS head, t <> '' AND (regexp_matches(t, '^(?:[A-Za-z ]{{2,30}}\\s*[:：]|[0-9]+\\.\\s+[A-Z])') OR NOT regexp_matches(t, '{_ADDRESS_RE2}|\\b[0-9]{{4,6}}\\b')) AS stop
 FROM (SELECT *, {_clean_sql('line')} AS t FROM ({_ROWS_SQL}))) WINDOW before AS (PARTITION BY pack_id, doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE t <> '' AND NOT stop AND last_head >= coalesce(last_stop, 0)"""),
    "detect_person_lines": _line_sql("'PERSON'", 2, "'standalone title-case person line'", "v", f"SELECT * FROM ({_BARE_SQL}) WHERE regexp_full_match(v, '{_NAME_RE2}') AND {_person_sql('v')}"),
    "detect_attention": _line_sql("'PERSON'", 1, "'attention block continuation'", "v", f"""SELECT * FROM (SELECT *, min(CASE WHEN m THEN k END) OVER (PARTITION BY pack_id, doc_id, block) AS head FROM (
 SELECT *, regexp_matches(line, '{_ATTENTION_RE2}') AS m, sum(CAST(t = '' AS INT)) OVER (PARTITION BY pack_id, doc_id ORDER BY k) AS block FROM ({_BARE_SQL}))) WHERE head < k AND regexp_full_match(v, '{_NAME_RE2}') AND {_person_sql('v')}""")
    + " UNION ALL " + _line_sql("'PERSON'", 1, "'attention block name'", "v", f"SELECT * FROM (SELECT *, regexp_extract(line, '{_ATTENTION_RE2}', 1) AS v FROM ({_ROWS_SQL}) WHERE regexp_matches(line, '{_ATTENTION_RE2}')) WHERE {_person_sql('v')}"),
    "detect_inventors": _names_of_lines(
        "src IS NOT NULL", "'patent inventor name'", 1,
        f"SELECT *, CASE WHEN m THEN regexp_extract(line, '{_INVENTOR_RE2}', 1) WHEN s <> '' AND lag(m) OVER (PARTITION BY pack_id, doc_id ORDER BY k) THEN line END AS src FROM (SELECT *, regexp_matches(line, '{_INVENTOR_RE2}') AS m FROM ({_ROWS_SQL}))",
    ),
    "detect_caption_personnel": _names_of_lines(
        "src IS NOT NULL", "CASE WHEN m THEN 'caption-block personnel' ELSE 'caption-block continuation' END", 2,
        f"""SELECT *, CASE WHEN m THEN regexp_extract(line, '{_PERSONNEL_RE2}', 1) WHEN more AND min(CASE WHEN m THEN k END) OVER (PARTITION BY pack_id, doc_id, block) < k THEN line END AS src FROM (
 SELECT *, sum(CAST(NOT more AS INT)) OVER (PARTITION BY pack_id, doc_id ORDER BY k) AS block FROM (SELECT *, regexp_matches(line, '{_PERSONNEL_RE2}') AS m, starts_with(line, repeat(' ', 8)) AND s <> '' AS more FROM ({_ROWS_SQL})))""",
    ),
}
_HONORED_RE2 = "(^|[，,。；;：:、\\s（(由与和对向请为])([一-鿿]{1,3})(先生|女士|小姐)"
_HONORED_SQL = _hits_sql(_HONORED_RE2, 2)
ORACLE_SQL["detect_zh_honorific"] = f"""SELECT pack_id, doc_id, 'PERSON' AS kind, 2 AS level, 'Chinese honorific-suffixed name' AS reason, substr(v, lead + 1) || right(w, 2) AS value, pos + length(w) - length(v) - 2 + lead AS pos
 FROM (SELECT *, CASE WHEN length(v) > 1 THEN length(v) - length(ltrim(v, '由与和对向请为致给让')) ELSE 0 END AS lead FROM ({_HONORED_SQL}))"""
_SIGN_RE2 = scan._SIGN.pattern.replace("[^\\W\\d_]", "\\p{L}").replace("[\\w.", "[\\p{L}\\p{N}_.").replace("'", "''")
_SIGNED_SQL = f"SELECT * FROM ({_hits_sql(_SIGN_RE2, 1)}) WHERE regexp_matches(v, '\\p{{Lu}}') AND len(list_filter(string_split_regex(v, '\\s+'), lambda w: list_contains({_listed([*L.ORG_NAME_TAILS, *L.PERSON_STOPS])}, w))) = 0"
ORACLE_SQL["detect_signature"] = _line_sql("'PERSON'", 1, "'signature block name'", "v", _SIGNED_SQL) + " UNION ALL " + _line_sql("'PERSON'", 1, "'signature block name'", _TITLE_SQL, f"SELECT * FROM ({_SIGNED_SQL}) WHERE NOT regexp_matches(v, '\\p{{Ll}}')")
_VETO_RE2 = "\\b(Stock\\s+Exchange|Exchanges?\\s+and\\s+Clearing|Exchange\\s+Limited)\\b"
_RESIDENCE_RE2 = "\\b([A-Z][A-Za-z''’ -]{2,30}?)\\s*\\(([A-Z]{2})\\)"
ORACLE_SQL["detect_locations"] = f"""SELECT pack_id, doc_id, 'LOCATION' AS kind, 2 AS level, 'common location' AS reason, substr(text, pos + 1, length(city)) AS value, pos FROM (
 SELECT *, CAST(sum(length(g) + length(city)) OVER (PARTITION BY pack_id, doc_id, city ORDER BY i) AS BIGINT) - length(city) AS pos FROM (
  SELECT pack_id, doc_id, text, city, unnest(gs[1:len(gs) - 1]) AS g, generate_subscripts(gs[1:len(gs) - 1], 1) AS i FROM (
   SELECT pack_id, doc_id, text, city, string_split(lower(replace(text, 'İ', chr(1))), lower(city)) AS gs FROM ({_BOTH_SQL}), (SELECT unnest({_listed(L.CITIES)}) AS city)) WHERE len(gs) > 1))
 WHERE NOT regexp_matches(substr(text, greatest(pos - 24, 0) + 1, least(pos, 24) + length(city) + 32), '{_VETO_RE2}')
 UNION ALL SELECT pack_id, doc_id, 'LOCATION', 2, 'patent inventor/assignee residence', string_split(rv, ',')[-1], base + CAST(e AS BIGINT) - length(rw) FROM (
 SELECT *, sum(length(rg) + length(rw)) OVER (PARTITION BY pack_id, doc_id, base ORDER BY ri) AS e FROM (
  SELECT pack_id, doc_id, base, unnest(ws) AS rw, unnest(regexp_extract_all(part, '{_RESIDENCE_RE2}', 1)) AS rv, unnest(string_split_regex(part, '{_RESIDENCE_RE2}')[1:len(ws)]) AS rg, generate_subscripts(ws, 1) AS ri FROM (
   SELECT pack_id, doc_id, pos + length(w) AS base, substr(text, pos + length(w) + 1, 120) AS part, regexp_extract_all(substr(text, pos + length(w) + 1, 120), '{_RESIDENCE_RE2}') AS ws FROM ({_hits_sql(chr(92) + 'b(?:Inventors?|Applicants?|Assignees?)' + chr(92) + 'b', 0)}))))"""


for _name, _condition in _DETECTORS.items():
    QUERIES[_name] = _detector(_condition)


@query("alias_person")
def _aliases(spark, sf_dir):
    docs = _with_letters(spark, sf_dir)
    merged = resolve.merge(plan.candidates_of(docs))
    return resolve.person_aliases(merged, docs).select("pack_id", F.col("doc_ord").alias("doc_id"), "value", "level", "reason", "pos")


_ORGS = [("p", "ORG", "Blue Sky (UK) Limited", 2, 5), ("p", "ORG", "Acme Ltd", 2, 9), ("p", "PERSON", "Ann Lee (x)", 2, 3), ("q", "ORG", "北京蓝天（集团）公司", 2, 1), ("q", "ORG", "AB (C)", 2, 7)]


@query(
    "alias_org",
    f"SELECT pack_id, trim(regexp_extract(value, '^([^(（]{{3,}})[(（]', 1)) AS value, 'organization bracket alias' AS reason FROM {_values(_ORGS, 'pack_id, kind, value, level, pos')} WHERE kind = 'ORG' AND length(trim(regexp_extract(value, '^([^(（]{{3,}})[(（]', 1))) > 2",
)
def _alias_org(spark, sf_dir):
    rows = _fixture(spark, _ORGS, "pack_id string, kind string, value string, level int, pos int")
    merged = rows.withColumns({"seq": F.struct(F.lit(0).alias("doc_ord"), F.lit(0).alias("detector"), F.lit(0).alias("rule"), "pos"), "sources": F.array(F.lit("a"))})
    return resolve.org_aliases(merged).select("pack_id", "value", "reason")


_ZH_PLACES = [("p", "ADDRESS", "上海市浦东新区世纪大道100号20楼1室", 2, 5), ("p", "ADDRESS", "北京市海淀区中关村", 2, 6), ("q", "ADDRESS", "12 Baker Street", 2, 1)]


@query(
    "alias_zh_addr",
    f"""SELECT pack_id, v AS value, 'Chinese address prefix alias' AS reason FROM (SELECT pack_id, unnest([substr(value, 1, n) FOR n IN range(6, greatest(length(value), 7))]) AS v FROM {_values(_ZH_PLACES, 'pack_id, kind, value, level, pos')}
 WHERE regexp_matches(value, '[㐀-鿿]') AND length(value) > 6) WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '(?:号|室|楼|层|栋|幢|座|单元|弄|村|路|街)$')""",
)
def _alias_zh(spark, sf_dir):
    rows = _fixture(spark, _ZH_PLACES, "pack_id string, kind string, value string, level int, pos int")
    merged = rows.withColumns({"seq": F.struct(F.lit(0).alias("doc_ord"), F.lit(0).alias("detector"), F.lit(0).alias("rule"), "pos"), "sources": F.array(F.lit("a"))})
    return resolve.address_aliases(merged).select("pack_id", "value", "reason")


_PERSONS = [("p", "PERSON", v, 1, i) for i, v in enumerate(("Mara Quill", "Ms Quill", "Quill", "Ann Lee", "Bo Lee", "Lee", "Dr. Ann Lee", "Sir Zed"))]


@query(
    "canonical_person",
    f"""WITH r AS (SELECT value, regexp_replace(value, '^(?i:{'|'.join(L.TITLES)})\\.?\\s+', '') AS bare FROM {_values(_PERSONS, 'pack_id, kind, value, level, pos')}),
 f AS (SELECT string_split(bare, ' ')[-1] AS surname, min(value) AS full_name FROM r WHERE bare = value AND contains(bare, ' ') GROUP BY 1 HAVING count(DISTINCT value) = 1)
 SELECT r.value, coalesce((SELECT k.value FROM r k WHERE k.value = k.bare AND contains(k.value, ' ') AND k.value = r.bare), CASE WHEN NOT contains(r.bare, ' ') THEN f.full_name END, r.value) AS canonical
 FROM r LEFT JOIN f ON f.surname = string_split(r.bare, ' ')[-1]""",
)
def _canonical(spark, sf_dir):
    return resolve.canonical_person(_fixture(spark, _PERSONS, "pack_id string, kind string, value string, level int, pos int")).select("value", "canonical")
