"""Gates and checksums of values, as columns.  A null fails every check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.dialect import WS
from quillmask.functions.lexicons import AMBIGUOUS_NAMES, IBAN_COUNTRIES, PRC_ID_CHECKS, PRC_ID_WEIGHTS, USCC_ALPHABET, USCC_WEIGHTS

HANDLES = ("messaging handle label", "skype live: handle label")


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _char(v: Column, i) -> Column:
    return F.substring(v, i if isinstance(i, Column) else F.lit(i), F.lit(1))


def is_valid_iban(v: Column) -> Column:
    """Country of the scheme and remainder 1 modulo 97."""
    s = F.upper(F.regexp_replace(v, rf"[{WS}]+", ""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(a: Column, i: Column) -> Column:
        n = F.ascii(_char(turned, i))
        return F.when(n < 58, (a * 10 + n - 48) % 97).otherwise((a * 100 + n - 55) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0), step)
    shape = s.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\z") & F.substring(s, 1, 2).isin(*IBAN_COUNTRIES)
    return _no(F.when(shape, rest == 1).otherwise(False))


def is_valid_isin(v: Column) -> Column:
    """Twelve characters whose digits, letters as 10 to 35, pass the Luhn check from the right."""
    codes = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.when(F.ascii(_char(v, i)) < 58, _char(v, i)).otherwise((F.ascii(_char(v, i)) - 55).cast("string"))), ""
    )
    back = F.reverse(codes)

    def term(i: Column) -> Column:
        d = F.try_to_number(_char(back, i), F.lit("9")).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), lambda a, i: a + term(i))
    return _no(F.when(v.rlike(r"\A[A-Z]{2}[A-Z0-9]{9}[0-9]\z"), total % 10 == 0).otherwise(False))


def is_valid_uscc(v: Column) -> Column:
    """Weighted sum modulo 31 over the code's alphabet."""
    code = [F.instr(F.lit(USCC_ALPHABET), _char(v, i)) - 1 for i in range(1, 19)]
    total = sum((c * w for c, w in zip(code[:17], USCC_WEIGHTS, strict=True)), F.lit(0))
    return _no(F.when(v.rlike(rf"\A[{USCC_ALPHABET}]{{18}}\z"), (31 - total % 31) % 31 == code[17]).otherwise(False))


def is_valid_prc_id(v: Column) -> Column:
    """Weighted sum modulo 11, and a date of birth of 1900 to 2099."""
    s = F.upper(v)
    total = sum((F.ascii(_char(s, i + 1)) - 48) * w for i, w in enumerate(PRC_ID_WEIGHTS))
    year, month, day = ((F.substring(s, a, n)).try_cast("int") for a, n in ((7, 4), (11, 2), (13, 2)))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    good = year.between(1900, 2099) & month.between(1, 12) & (day >= 1) & (day <= days)
    check = _char(F.lit(PRC_ID_CHECKS), total % 11 + 1) == _char(s, 18)
    return _no(F.when(s.rlike(r"\A[1-9][0-9]{16}[0-9X]\z"), good & check).otherwise(False))


def gate_phone(v: Column, reason: Column) -> Column:
    """Whether a cleaned phone candidate can be a phone: digits, and no date or code."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    enough = (F.length(digits) >= 7) | reason.isin("phone extension label", *HANDLES)
    shapes = (
        r"\A[0-9]{4}\.[0-9]{2}\.[0-9]{2}\z", r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", r"\A[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}\z", r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\z",
        r"\A[0-9]{5}-[0-9]{4}\z", r"\A[0-9]{1,3}-[0-9]{5,6}\z",
    )
    other = v.rlike("|".join(shapes)) | digits.rlike(r"\A(?:19|20)[0-9]{6}\z")
    return enough & (F.length(digits) <= 15) & ~other


def fix_paren_phone(cleaned: Column, raw: Column) -> Column:
    """A phone gets back the bracket that cleaning took off its area code."""
    lost = cleaned.rlike(rf"\A[0-9]{{3}}\)[{WS}.-]+[0-9]") & F.ltrim(raw).startswith("(")
    return F.when(lost, F.concat(F.lit("("), cleaned)).otherwise(cleaned)


def gate_person(v: Column) -> Column:
    """Rejects a name that is one ambiguous word."""
    return ~v.isin(*AMBIGUOUS_NAMES)
