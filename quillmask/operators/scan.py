"""All document-local detectors in one Arrow pass.

Patterns are compiled once a worker, from the same rule table that the native path reads.
Contextual detectors (people, organisations, headers, address blocks) are small functions
over a document's text and lines; each yields ``(kind, level, reason, value, pos, rule)``.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.functions import lexicons as L
from quillmask.functions.dialect import java
from quillmask.operators import rules as R
from quillmask.operators.detect import spread

Found = tuple[str, int, str, str, int, int]
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", re.A)
_EDGE = " \t\r\n\f\v 　,.;:()[]{}<>\"'“”‘’"


def _py(pattern: str, ignore_case: bool = False, multiline: bool = False) -> re.Pattern:
    return re.compile(java(pattern, ignore_case, multiline).replace(r"\z", r"\Z"), re.A)


def clean(v: str) -> str:
    v = v.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").strip(_EDGE)
    return " ".join(v.split())


#: Letters that a text must hold, in lower case, for a rule to match at all; for rules that no digit guards.
_NEEDS = {
    "SWIFT/BIC code": ("swift", "bic"), "OCR-spaced SWIFT/BIC code": ("ift",), "sales channel label": ("channel",), "label-bound bare domain URL": (":", "#"), "messaging handle label": ("@", "wechat"),
    "skype live: handle label": ("skype",), "Vehicle Identification Number (VIN) label": ("vin", "vehicle"), "travel/shipping identifier label": ("passport", "tracking", "booking"), "HMRC reference": ("hmrc",),
    "bare www. website URL (no scheme)": ("www",), "LEI legal entity identifier": ("lei", "legal"), "SEDOL securities identifier": ("sedol",), "OCR-spaced bank account number label": ("accoun",),
}


@functools.cache
def _direct() -> list[tuple[R.Rule, re.Pattern, bool, tuple[str, ...]]]:
    return [(r, _py(r.pattern, r.ignore_case, r.multiline), r"\d" in r.pattern and r.kind not in ("EMAIL", "URL"), _NEEDS.get(r.reason, ())) for r in R.DIRECT]


@functools.cache
def _han() -> list[tuple[R.Rule, re.Pattern]]:
    return [(r, _py(r.pattern)) for r in R.HAN]


@functools.cache
def _han_labels() -> list[tuple[R.HanLabel, re.Pattern, re.Pattern]]:
    return [(r, re.compile(r.java, re.A), re.compile(r.valid, re.A)) for r in R.HAN_LABELS]


@functools.cache
def _labels() -> list[tuple[R.Label, re.Pattern]]:
    return [(r, re.compile(r.java.replace(r"\z", r"\Z"), re.A)) for r in R.LABELS]


_SPLIT_NUMBER = re.compile(r"\d{1,4}[\s-]\d{1,4}", re.A)
_NUMBER_LABEL = re.compile(r"\b(?:File|Docket|Matter|Case|Charge|Claim|Reference)\s+Nos?\b\.?\s*[:#]?\s*\Z", re.A | re.I)
_ZH_NUMBER_LABEL = re.compile("(?:发票代码|发票号码|发票号|校验码|流水号|凭证号|订单号|运单号|保单号|住院号|门诊号|病案号|病历号|出生证编号|员工编号|员工号|工号|人员编号)\\s*[：:#]\\s*\\Z")
_CLINICAL = re.compile("(?:狭窄|阻塞|梗阻|钙化|闭塞|狭窄度|阻塞度|射血分数|阻塞比例)\\Z")


def iban_ok(v: str) -> bool:
    s = "".join(v.split()).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}", s, re.A) or s[:2] not in L.IBAN_COUNTRIES:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def direct(text: str) -> Iterator[Found]:
    digits = any(c.isdigit() and c.isascii() for c in text)
    lower = text.lower()
    for i, (r, p, needs_digit, letters) in enumerate(_direct()):
        if letters and not any(x in lower for x in letters):
            continue
        if needs_digit and not digits or r.kind == "EMAIL" and "@" not in text or r.kind == "NON_LATIN_TEXT" and text.isascii():
            continue
        for m in p.finditer(text):
            value = (m[1] if p.groups else None) or m[0]
            pos = m.start()
            if r.kind == "PHONE" and (
                _SPLIT_NUMBER.fullmatch(value) and _NUMBER_LABEL.search(text[max(0, pos - 30) : pos]) or _ZH_NUMBER_LABEL.search(text[max(0, pos - 24) : pos])
            ):
                continue
            if r.reason == "IBAN" and not iban_ok(value):
                continue
            if r.reason == "percentage" and _CLINICAL.search(text[max(0, pos - 12) : pos]):
                continue
            yield r.kind, r.level, r.reason, value, pos, i


_HAN_CHAR = re.compile("[㐀-鿿]")
_ZH_FIRST = re.compile(r"\s*((?:[^，,、\s]|(?<=\d),(?=\d))+(?: [0-9A-Za-z.'-]+)*)")


def han(text: str) -> Iterator[Found]:
    if not _HAN_CHAR.search(text):
        return
    for i, (r, p) in enumerate(_han()):
        for m in p.finditer(text):
            yield r.kind, r.level, r.reason, (m[1] if p.groups else None) or m[0], m.start(), i
    for i, (r, p, valid) in enumerate(_han_labels()):
        for m in p.finditer(text):
            first = _ZH_FIRST.match(m[1])
            value = first[1] if first else ""
            if not valid.fullmatch(value):
                value = clean(value).strip("，。；：、（）【】《》「」『』〔〕")
            if value and value not in R.PLACEHOLDERS and valid.fullmatch(value):
                yield r.kind, r.level, r.reason, value, m.start(), 200 + i
    for m in re.finditer(r"由([一-鿿（）()A-Za-z0-9·]{2,40}?)与([一-鿿（）()A-Za-z0-9·]{2,40}?)就", text):
        for g in (1, 2):
            yield ("PERSON" if len(m[g]) <= 4 else "ORG"), 2, "Chinese agreement party heading", m[g], m.start(), 300
    for m in re.finditer(r"(?:甲方|乙方|丙方|丁方|戊方|己方)\s*(?:[（(][^）)\r\n]{0,12}[）)])?\s*[：:]\s*([^\s，,。；;（(]{2,40})", text):
        person = re.fullmatch(r"[一-鿿]{2,6}", m[1]) and not re.search("公司|集团|中心|银行|医院|学校|大学|局|厂|店|社|所|院", m[1])
        yield ("PERSON" if person else "ORG"), 2, f"Chinese party role ({'individual' if person else 'organization'})", m[1], m.start(), 301
    for m in re.finditer(r"(?:签字|签名|签章|签署|授权代表)[^\r\n（(]{0,8}[（(]([一-鿿·]{2,4})[）)]", text):
        yield "PERSON", 2, "Chinese signature / authorization name", m[1], m.start(), 302
    for m in re.finditer(r"(?:审\s*判\s*长|审\s*判\s*员|书\s*记\s*员|人\s*民\s*陪\s*审\s*员|代\s*理\s*审\s*判\s*员)\s*[:：]?\s*([一-鿿](?:\s*[一-鿿]){1,3})(?=\s*(?:\r?\n|\Z))", text):
        yield "PERSON", 2, "Chinese court signature name", "".join(m[1].split()), m.start(), 303
    for m in re.finditer(r"(?:^|(?<=[，,。；;：:、\s（(由与和对向请为]))([一-鿿]{1,3})(?:先生|女士|小姐)", text):
        lead = len(m[1]) - len(m[1].lstrip("由与和对向请为致给让")) if len(m[1]) > 1 else 0
        yield "PERSON", 2, "Chinese honorific-suffixed name", m[0][lead:], m.start() + lead, 304
    for m in re.finditer(r"(?<!《)[一-鿿（）()A-Za-z0-9]{2,30}?(?:有限责任公司|股份有限公司|有限公司|集团公司|律师事务所|会计师事务所|仲裁委员会|人民法院|人民检察院|医院|大学|银行)", text):
        value = re.sub("^.*?(?:系|为|由|与|和|向|对|在|至|以及|及|被|将)(?=[一-鿿]{4})", "", m[0])
        yield "ORG", 2, "Chinese context organization (strong suffix)", value, m.start(), 305


def split_label(value: str, kind: str) -> list[str]:
    if kind == "ADDRESS":
        return [value]
    if kind == "EMAIL":
        return _MAIL.findall(value) or [value]
    value = " ".join(value.split())  # runs of spaces would cost the split their square
    cut = r"\s*/\s*|；|;|\s+and\s+" if kind in ("PERSON", "PERSON_OR_ORG") else r"\s*/\s*|；|;|,|\s+and\s+"
    return [c for c in map(clean, re.split(cut, value, flags=re.I)) if c]


def lines_of(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for m in re.finditer(r"\r?\n|\Z", text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    return out


def labels(rows: list[tuple[int, str]]) -> Iterator[Found]:
    for pos, line in rows:
        s = re.sub(r"\A[-*]\s+", "", line.strip())
        if not s:
            continue
        for i, (r, p) in enumerate(_labels()):
            m = p.match(s)
            for part in split_label(m[1], r.kind) if m else ():
                if r.kind in ("CASE_REF", "BUSINESS_ID", "BANK_ACCOUNT") and not re.search(r"\d", part, re.A):
                    continue
                if r.kind == "PERSON" and (not_a_name(part) or exchange(part)) or r.kind == "PERSON_OR_ORG" and exchange(part):
                    continue
                if r.reason in ("from label", "to label", "cc label", "contact label") and _MAIL.search(part):
                    continue
                yield r.kind, r.level, r.reason, part, pos, i


def exchange(v: str) -> bool:
    return bool(re.search(r"\b(?:Stock\s+Exchange|Exchanges?\s+and\s+Clearing|Exchange\s+Limited)\b", v))


def not_a_name(v: str) -> bool:
    """Whether a part is a department or role rather than a name."""
    return bool(re.search(r"\b(?:Department|Division|Team|Office|Unit|Committee|Board|Desk|Manager|Officer|Agreement|Contract|Party|Company)\b", v))


_STOPS = frozenset(L.PERSON_STOPS)
_TAILS = frozenset(L.ORG_NAME_TAILS)
_AGENCY = frozenset(L.AGENCY_WORDS)
_HEADINGS = frozenset(L.HEADING_ENDINGS)
_LEADING = frozenset(L.LEADING_WORDS)
_TERMS = frozenset(L.CONTRACT_TERMS)
_SMALL = frozenset("The A An Of And Or In On At By For To From With This That These Those Such Any All Some Other Said Our Your Their His Her Its As If When Where".split())
_TITLE = re.compile(rf"\A(?:{'|'.join(L.TITLES)})\.?\s+", re.A | re.I)
NAME = r"[A-Z][A-Za-z'’-]+(?:[^\S\r\n]+[A-Z][A-Za-z'’-]+){1,3}"


def looks_like_person(v: str) -> bool:
    """A cascade of vetoes: none of the words may speak against a person's name."""
    v = re.sub(r"['’]s\Z", "", _TITLE.sub("", v))
    words = v.split()
    if not 2 <= len(words) <= 4 or exchange(v) or any(p in v for p in L.PERSON_PHRASES):
        return False
    if any(len(w) >= 2 and w.isupper() for w in words) or any(w in _SMALL for w in words):
        return False
    if words[-1] in _TAILS or words[-1].removesuffix(".") in _HEADINGS or any(w in _AGENCY for w in words) or contract_term(words):
        return False
    return not any(w in _STOPS for w in words)


def contract_term(words: list[str]) -> bool:
    """Whether words, without up to two that lead in, are a defined term: two of them are terms, or the first is one."""
    own = [w for w in (re.sub(r"['’]s\Z", "", x).strip("\"'“”‘’.,;:()-") for x in words) if w and not re.fullmatch(r"[A-Z]\.?", w)]
    if len(own) < 2:
        return False
    for _ in range(2):
        if len(own) > 1 and own[0] in _LEADING:
            own = own[1:]
    return own[0] in _TERMS or sum(w in _TERMS for w in own) >= 2


# Context patterns of people, with their levels and reasons.
_PEOPLE = [
    (2, "witness/expert heading", re.compile(rf"\b(?:Witness Statement|Expert Report|Statement|Report|Affidavit|Declaration|Affirmation) of ({NAME})")),
    (2, "parenthetical person", re.compile(rf"\(({NAME})\)")),
    (2, "communication context", re.compile(rf"\b(?:from|to|between|and|by) ({NAME})(?=\s+(?:to|and)\b|\s*[:,;])")),
    (2, "alternate name", re.compile(rf"\b(?:called|named|identified as|translation as) ({NAME})")),
    (2, "full name before witness verb", re.compile(rf"\b({NAME})\s+(?:testified|stated|said|confirmed|explained|denied|claimed|alleged|gave|recalled|noted|argued|wrote|admitted)\b")),
    (2, "full name before state verb", re.compile(rf"\b({NAME})\s+(?:was|is|has been|had been)\s+(?:also\s+)?(?:involved|present|appointed|employed|responsible|copied|informed|aware)\b")),
    (2, "litigation role plus name", re.compile(rf"\b(?:Defendant|Plaintiff|Claimant|Respondent|Petitioner|Appellant|Appellee)s?,? ({NAME})")),
    (2, "patent examiner plus name", re.compile(rf"\bExaminer\s*[—–:-]\s*({NAME})")),
    (2, "form/benefits label plus name", re.compile(rf"\b(?:Member|Patient|Insured|Subscriber|Claimant|Employee|Borrower|Loan Officer)(?: Name)?\s*:\s*({NAME})")),
    (1, "name with esq suffix", re.compile(r"\b([A-Z][A-Za-z.'’-]+(?:\s+[A-Z][A-Za-z.'’-]+){0,3}),?\s+Esq\b\.?")),
    (1, "named business contact", re.compile(rf"\b(?:lead partner|account manager|contact|relationship manager)[^.\r\n]{{0,40}}\bis ({NAME})")),
    (1, "handled-by business contact", re.compile(rf"\bwill be handled by ({NAME})")),
    (2, "agreement party heading", re.compile(rf"\bBetween\s+({NAME})\s+and\s+{NAME}")),
    (2, "case caption name", re.compile(r"\b([A-Z][a-z]+) v\.? [A-Z][a-z]+")),
]
_TITLED = re.compile(rf"\b(?:{'|'.join(L.TITLES)})\.?[^\S\r\n]+([A-Z][A-Za-z'’-]+(?:[^\S\r\n]+[A-Z][A-Za-z'’-]+){{0,3}})")
_LIST = re.compile(rf"\b{NAME}(?:(?:[^\S\r\n]*,[^\S\r\n]*|[^\S\r\n]*,?[^\S\r\n]+and[^\S\r\n]+){NAME})+")
_SIGN = re.compile(r"(?:/s/|(?:Printed\s+)?Name\s*:|By\s*:|_{3,})[^\S\r\n]*([^\W\d_][\w.'’-]*(?:[^\S\r\n]+(?:de|da|van|von|der|la|[^\W\d_][\w.'’-]*)){1,3})")
_PARTY = re.compile(rf"\b({NAME})[^()\r\n]{{0,120}}\(\s*(?:the\s+)?[\"“](?:Tenant|Landlord|Buyer|Seller|Borrower|Lender|Employee|Employer|Consultant|Contractor|Licensor|Licensee|Guarantor|Purchaser|Vendor|Assignor|Assignee|Lessor|Lessee|Client|Company|Trustee|Settlor)[\"”]\s*\)")


def people(text: str, rows: list[tuple[int, str]]) -> Iterator[Found]:
    for m in _TITLED.finditer(text):
        yield "PERSON", 1, "title plus person name", m[0], m.start(), 0
        if " " in m[1]:
            yield "PERSON", 1, "name after title", m[1], m.start(), 1
    for i, (level, reason, p) in enumerate(_PEOPLE):
        for m in p.finditer(text):
            if reason in ("name with esq suffix", "case caption name") or looks_like_person(m[1]):
                yield "PERSON", level, reason, m[1], m.start(), 2 + i
    for m in _LIST.finditer(text):
        for name in re.finditer(NAME, m[0]):
            if looks_like_person(name[0]):
                yield "PERSON", 2, "title-case person in list", name[0], m.start() + name.start(), 30
    for m in _PARTY.finditer(text):
        if looks_like_person(m[1]):
            yield "PERSON_OR_ORG", 2, "contract preamble party", m[1], m.start(), 31
    for m in _SIGN.finditer(text):
        v = m[1]
        if not any(w in _TAILS or w in _STOPS for w in v.split()) and any(c.isupper() for c in v):
            yield "PERSON", 1, "signature block name", v, m.start(), 32
            if v.isupper():
                yield "PERSON", 1, "signature block name", v.title(), m.start(), 32
    attention = False
    for pos, line in rows:
        s = clean(re.sub(r"<[^>]+>|[*_`]", "", line))
        bare = re.sub(r"\A(?:[-*]\s+|Dear\s+)", "", s)
        if re.fullmatch(NAME, bare) and looks_like_person(bare):
            yield "PERSON", 2, "standalone title-case person line", bare, pos, 33
            if attention:
                yield "PERSON", 1, "attention block continuation", bare, pos, 35
        m = re.match(rf"\s*(?:Attention|Attn)\.?\s*[:：]?\s*({NAME})", line)
        attention = bool(m) or attention and bool(s)
        if m and looks_like_person(m[1]):
            yield "PERSON", 1, "attention block name", m[1], pos, 34
        m = re.match(rf"\s*({NAME})\s*[—–-].*?{_MAIL.pattern}", line)
        if m and looks_like_person(m[1]):
            yield "PERSON", 1, "contact line before email", m[1], pos, 36


_CAPS = r"[A-Z][A-Z.'’-]+(?:[^\S\r\n]+[A-Z][A-Z.'’-]*){1,3}"
_ROLE = r"(?:Plaintiff|Defendant|Petitioner|Respondent|Appellant|Appellee|Claimant)s?"
_CAPTION_PARTY = re.compile(rf"\b({_CAPS}),?(?:[^\S\r\n]*\(?{_ROLE}\b|[^a-z]{{0,300}}?\b{_ROLE}\b)")
_PERSONNEL = re.compile(r"\s*(?:Commissioners|Judges|Before|Panel|Present|Coram)\s*[:：]?\s+(.+)")


def headings(text: str, rows: list[tuple[int, str]]) -> Iterator[Found]:
    """People of patent headers, captions and tables."""
    inventors = personnel = False
    for pos, line in rows:
        m = re.match(r"\s*(?:\(\d+\)\s*)?(?:Inventors?|Applicants?)\s*[:：]\s*(.+)", line)
        if m or inventors and line.strip():
            for name in re.finditer(NAME, m[1] if m else line):
                if looks_like_person(name[0]):
                    yield "PERSON", 1, "patent inventor name", name[0], pos, 40
        inventors = bool(m)
        m = _PERSONNEL.match(line)
        more = personnel and line.startswith(" " * 8) and line.strip()
        if m or more:
            for name in re.finditer(NAME, m[1] if m else line):
                if looks_like_person(name[0]):
                    yield "PERSON", 2, "caption-block personnel" if m else "caption-block continuation", name[0], pos, 41
        personnel = bool(m or more)
        s = line.strip()
        if re.fullmatch(r"[A-Z][A-Z'’-]+(?: [A-Z][A-Z'’-]+){1,2}", s) and looks_like_person(s.title()):
            yield "PERSON", 2, "all-caps line person", s, pos, 43
    for m in _CAPTION_PARTY.finditer(text):
        if looks_like_person(m[1].title()):
            yield "PERSON", 2, "caption party name", m[1], m.start(), 42
    for m in re.finditer(r">([A-Z][A-Z'’-]+(?: [A-Z][A-Z'’-]+){1,2})<", text):
        if looks_like_person(m[1].title()):
            yield "PERSON", 2, "all-caps table person", m[1], m.start(1), 44
    for m in re.finditer(r"\b(?:Inventors?|Applicants?|Assignees?)\b", text):
        for r in re.finditer(r"\b([A-Z][A-Za-z'’ -]{2,30}?)\s*\(([A-Z]{2})\)", text[m.end() : m.end() + 120]):
            yield "LOCATION", 2, "patent inventor/assignee residence", r[1].split(",")[-1], m.end() + r.start(), 45


_ZH_ADDRESS = "|".join(sorted(R.HAN_LABELS[4].labels.split(), key=lambda x: (-len(x), x)))
_ZH_LABEL_LINE = re.compile(r"[\u4e00-\u9fff]{2,8}\s*[：:]")


def han_addresses(rows: list[tuple[int, str]]) -> Iterator[Found]:
    """Han addresses over several lines, after an empty label or wrapped from their first line."""
    for k, (pos, line) in enumerate(rows):
        m = re.fullmatch(rf"\s*(?:{_ZH_ADDRESS})\s*[：:]\s*(.*?)\s*", line)
        if not m:
            continue
        parts, most = ([m[1]], 4) if m[1] else ([], 5)
        if m[1] and (not re.search(r"\d", m[1], re.A) or re.search("[。；;]$", m[1])):
            continue
        for _, nxt in rows[k + 1 :]:
            t = nxt.strip()
            if len(parts) >= most or not t or not _HAN_CHAR.search(t) or _ZH_LABEL_LINE.match(t) or len(t) > 40 or re.search("[。；;]", t[:-1]):
                break
            parts.append(t.rstrip("。；;"))
        if len(parts) > (1 if m[1] else 0):
            yield "ADDRESS", 2, "Chinese wrapped labeled address" if m[1] else "Chinese multi-line labeled address", "".join(parts), pos, 310
            for part in parts:
                yield "ADDRESS", 2, "Chinese wrapped labeled address" if m[1] else "Chinese multi-line labeled address", part, pos, 311


_TAIL = "|".join([*L.ORG_TAILS, *(w.upper() for w in L.ORG_TAILS), "Law Offices"])
_ORG = re.compile(rf"\b((?:[A-Z][A-Za-z0-9'’.-]*[A-Za-z0-9]|[A-Z]&[A-Z]|&)(?:[^\S\r\n]+(?:[A-Z][A-Za-z0-9'’.-]*[A-Za-z0-9]|&|of|and)){{0,6}}(?:[^\S\r\n]+(?:{_TAIL})|,?[^\S\r\n]+(?:{L.LEGAL_FORMS})))(?![A-Za-z0-9])")
_GENERIC = frozenset("Services Service Systems System Solutions Solution Groups Holding Company Limited The".split()) | frozenset(L.ORG_TAILS)


def organizations(text: str) -> Iterator[Found]:
    for m in _ORG.finditer(text):
        v = re.sub(r"\A(?:and|of|The|Between|And)\s+", "", m[1])
        words = v.split()
        if len(words) < 2 or _TITLE.match(v) or all(w.strip(".,") in _GENERIC for w in words) or "working group" in v.lower():
            continue
        yield "ORG", 2, "ampersand organization suffix" if "&" in words else "organization suffix", v, m.start(), 0
    for m in re.finditer(r">([A-Z][A-Z0-9 &.,'-]{2,60} (?:LIMITED|LTD|INC|CORPORATION))<", text):
        yield "ORG", 2, "all-caps table organization", m[1], m.start(1), 1


def recipients(rows: list[tuple[int, str]]) -> Iterator[Found]:
    for pos, line in rows:
        m = re.match(r"\s*(?:From|To|Cc|Bcc|E-?mail|Reply-To)\s*[:：]\s*(.+)", line, re.I)
        if not m or "@" not in line:
            continue
        part, depth, parts = "", 0, []
        for c in m[1]:
            depth = depth + 1 if c in "<(" else max(0, depth - 1) if c in ">)" else depth
            if c in ",;" and not depth:
                parts.append(part)
                part = ""
            else:
                part += c
        for r in (*parts, part):
            name = clean(re.sub(r"\s*\([^)]*\)\s*\Z", "", _MAIL.sub(" ", re.sub(r"<[^>]*>", " ", r)).strip()))
            if re.fullmatch(r"[A-Z][A-Za-z.'’-]+(?:\s*,\s*[A-Z][A-Za-z.'’-]+)?(?:\s+[A-Z][A-Za-z.'’-]+){0,5}", name):
                yield ("PERSON" if looks_like_person(name) else "PERSON_OR_ORG"), 1, "email recipient display name", name, pos, 0


_ADDRESS = re.compile(rf"\b(?:{'|'.join(L.STREETS)})\b|\b(?:{'|'.join(L.UNITS + L.BUILDINGS)})\b|\b\d+\s*/\s*F\b", re.I | re.A)
_NUMBERED_STREET = re.compile(rf"\b\d+[A-Za-z]?\s+(?:[A-Z][A-Za-z'’-]+\s+){{1,5}}(?:{'|'.join(L.STREETS)})\b", re.A)


def blocks(rows: list[tuple[int, str]]) -> Iterator[Found]:
    """Values on the line after an empty label, and lines of addresses."""
    for k, (pos, line) in enumerate(rows):
        s = line.strip()
        m = re.fullmatch(r"(?:[-*]\s+)?(To|From|Cc|Client|Prepared for|Attention|Attn|Contact Person)\s*[:：]", s, re.I)
        if m and k + 1 < len(rows):
            value = clean(rows[k + 1][1])
            if re.match(r"[A-Z]", value) and len(value) <= 80 and not _MAIL.search(value):
                kind = "PERSON" if looks_like_person(value) else "PERSON_OR_ORG"
                yield kind, 1, "label continuation value", value, rows[k + 1][0], 0
        if re.fullmatch(r"(?:[-*]\s+)?Address\s*[:：].*", s, re.I):
            for p, nxt in rows[k + 1 :]:
                t = clean(nxt)
                if not t:
                    continue
                if re.match(r"[A-Za-z ]{2,30}\s*[:：]|\d+\.\s+[A-Z]", t) or not (_ADDRESS.search(t) or re.search(r"\b\d{4,6}\b", t)):
                    break
                yield "ADDRESS", 1, "address continuation", t, p, 1
        t = clean(re.sub(r"<[^>]+>|[*_`]", "", line))
        if 8 <= len(t) <= 100 and _NUMBERED_STREET.search(t) and not re.search(r"[.!?]\s+[A-Z][a-z]+ [a-z]+", t):
            yield "ADDRESS", 1, "standalone address-looking line", t, pos, 2
            if k + 1 < len(rows):
                m = re.fullmatch(rf"\s*([A-Z][A-Za-z .'-]+),\s*(?:{'|'.join(L.US_STATES)})\.?(?:\s+(\d{{5}}(?:-\d{{4}})?))?\s*", rows[k + 1][1])
                if m:
                    yield "LOCATION", 1, "address-tail city-state line", m[1], rows[k + 1][0], 3
                    if m[2]:
                        yield "POSTCODE", 1, "address-tail ZIP", m[2], rows[k + 1][0], 4


#: Like the letters of a word, its ends are ASCII: "ÉAB CD" holds the phrase "AB CD".
_PHRASE = re.compile(r"\b[A-Z][A-Za-z'’-]+(?: [A-Z][A-Za-z'’-]+){1,4}\b", re.A)


def other(text: str) -> Iterator[Found]:
    for m in re.finditer(r"\bProject\s+([A-Z][A-Za-z0-9-]{2,})\b", text):
        yield "PROJECT_OR_ISSUE", 1, "project name", m[0], m.start(), 0
        if len(m[1]) > 3:
            yield "PROJECT_OR_ISSUE", 1, "project codename alias", m[1], m.start(), 1
    for m in re.finditer(r"\b[A-Z]{2,4}-\d{3}\b", text, re.A):
        if re.search(r"product\s+candidate|drug\s+candidate", text[max(0, m.start() - 40) : m.end() + 40], re.I):
            yield "BRAND", 2, "product-candidate code", m[0], m.start(), 2
    lower = text.replace("\u0130", "\0").lower()  # the one letter that lower case makes longer
    for i, city in enumerate(L.CITIES):
        at = lower.find(city.lower())
        while at >= 0:
            if not exchange(text[max(0, at - 24) : at + len(city) + 32]):
                yield "LOCATION", 2, "common location", text[at : at + len(city)], at, 10 + i
            at = lower.find(city.lower(), at + len(city))
    seen: Counter = Counter()
    first: dict[str, int] = {}
    for m in _PHRASE.finditer(text):
        seen[m[0]] += 1
        first.setdefault(m[0], m.start())
    for v, n in seen.items():
        if n >= 3 or n == 2 and looks_like_person(v):
            yield "PROPER_NOUN", 3, "repeated capitalized phrase", v, first[v], 50


def all_found(text: str) -> Iterator[tuple[int, Found]]:
    rows = lines_of(text)
    for number, some in enumerate((direct(text), han(text), labels(rows), recipients(rows), blocks(rows), people(text, rows), organizations(text), other(text), headings(text, rows), han_addresses(rows))):
        for f in some:
            yield number, f


def _runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["pack_id", "doc_ord", "name", "kind", "level", "reason", "value", "pos", "rule", "detector"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        out = []
        for pack, ordinal, name, text in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
            for number, (kind, level, reason, value, pos, rule) in all_found(text) if text else ():
                out.append((pack, ordinal, name, kind, level, reason, value, pos, rule, number))
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def detect(docs: DataFrame) -> DataFrame:
    """Raw candidates of every document-local detector."""
    schema = "pack_id string, doc_ord long, name string, kind string, level int, reason string, value string, pos int, rule int, detector int"
    rows = docs.select("pack_id", F.col("doc_ord").cast("long").alias("doc_ord"), "name", F.coalesce("text", F.lit("")).alias("text"))
    return spread(rows).mapInArrow(_runner, schema)
