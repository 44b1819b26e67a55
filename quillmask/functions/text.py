"""Cleaning and normalising of values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.dialect import WS
from quillmask.functions.lexicons import FUNCTION_WORDS, ROLE_INBOXES, TITLES

_EDGE = WS + r",.;:()\[\]{}<>\"'“”‘’"
_ZH_EDGE = _EDGE + "，。；：、（）【】《》「」『』〔〕"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _stripped(v: Column, edge: str) -> Column:
    return F.regexp_replace(F.regexp_replace(v, rf"\A[{edge}]+|[{edge}]+\z", ""), rf"[{WS}]+", " ")


def clean_value(v: Column) -> Column:
    """Entities decoded, punctuation and blanks off both ends, inner blanks single."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        v = F.replace(v, F.lit(entity), F.lit(char))
    return _stripped(v, _EDGE)


def clean_value_zh(v: Column) -> Column:
    return _stripped(v, _ZH_EDGE)


def meaningful(v: Column) -> Column:
    """Whether a cleaned value has two characters and is no function word."""
    return (F.length(v) >= 2) & ~v.isin(*FUNCTION_WORDS)


def without_title(v: Column) -> Column:
    return F.regexp_replace(v, rf"(?i)\A(?:{'|'.join(TITLES)})\.?[{WS}]+", "")


def dedupe_norm(v: Column) -> Column:
    """The form by which values count as the same."""
    v = F.regexp_replace(without_title(clean_value(v)), r"(?i)['’]s\z", "")
    return F.lower(F.regexp_replace(v, rf"[{WS}]+", " "))


def visible_line(v: Column) -> Column:
    """A Markdown line without tags, emphasis and hard break."""
    v = F.regexp_replace(v, "<[^>]+>", "")
    v = F.regexp_replace(v, "[*_`]", "")
    return clean_value(F.regexp_replace(v, r"\\[ \t]*\z", ""))


def recipient_name(v: Column) -> Column:
    """The display name of a mail recipient."""
    v = F.regexp_replace(v, rf"<[^>]*>[{WS}]*\z", "")
    v = F.regexp_replace(v, rf"[{WS}]*<[^>]*>[{WS}]*", " ")
    v = F.trim(F.regexp_replace(v, EMAIL, " "))
    bare = F.trim(F.regexp_replace(v, rf"[{WS}]*\([^)]*\)[{WS}]*\z", ""))
    return clean_value(F.when(bare != "", bare).otherwise(v))


def recipient_shape(v: Column) -> Column:
    """Whether a display name has the form of a name."""
    token = r"[A-Z][A-Za-z.'’-]+"
    bare = F.trim(F.regexp_replace(v, rf"[{WS}]*\([^)]*\)[{WS}]*\z", ""))
    return bare.rlike(rf"\A{token}(?:[{WS}]*,[{WS}]*{token})?(?:[{WS}]+{token}){{0,5}}\z")


def generic_mailbox(address: Column) -> Column:
    """Whether a mail address is that of a role."""
    local = F.lower(F.split(F.split(address, "@")[0], r"\+")[0])
    tokens = F.filter(F.split(local, "[^a-z0-9]+"), lambda t: t != "")
    return F.regexp_replace(local, "[^a-z0-9]+", "").isin(*ROLE_INBOXES) | (
        (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(*ROLE_INBOXES))
    )


def role_inbox(recipient: Column) -> Column:
    """Whether all addresses of a recipient, one at least, are those of roles."""
    found = F.regexp_extract_all(recipient, F.lit(EMAIL), F.lit(0))
    return (F.size(found) > 0) & F.forall(found, generic_mailbox)


def entry_id(kind: Column, value: Column) -> Column:
    """``kind:value`` with the value percent-encoded as in a URI component."""
    v = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        v = F.replace(v, F.lit(code), F.lit(char))
    return F.concat(kind, F.lit(":"), v)


def possessive(value: Column, replacement: Column) -> Column:
    """The replacement of a value, which keeps its closing 's."""
    return F.when(value.rlike(r"(?i)['’]s\z"), F.concat(replacement, F.lit("'s"))).otherwise(replacement)


def strip_anchors(text: Column) -> Column:
    """Text without the anchors and links of a table of contents."""
    text = F.regexp_replace(text, r'(?i)<span\s+id="_Toc[0-9]+"\s+class="anchor"\s*></span>', "")
    text = F.regexp_replace(text, r"\[([^\[\]\n]+?)\s+\[([0-9]+)\]\(#_Toc[0-9]+\)\]\(#_Toc[0-9]+\)", "$1 $2")
    return F.regexp_replace(text, r"\[([^\[\]\n]+)\]\(#_Toc[0-9]+\)", "$1")
