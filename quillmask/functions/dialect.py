"""One pattern dialect for rules, translated to Java's for Spark and kept for RE2.

Rules use ``\\b`` for ASCII word edges and ``\\s`` for white space with no-break and
ideographic blanks.  Java's ``\\b`` is Unicode-aware and its ``\\s`` is ASCII, so both are
spelled out.
"""

from __future__ import annotations

WS = r"\t\n\x0B\f\r    -     　﻿"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """``pattern`` for Java's regular expressions."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            if two == r"\b" and not inside:
                out.append(_EDGE)
            elif two == r"\s":
                out.append(WS if inside else f"[{WS}]")
            elif two == r"\S" and not inside:
                out.append(f"[^{WS}]")
            else:
                out.append(two)
            i += 2
            continue
        if c == "[" and inside:
            out.append(r"\[")
        elif c == "&" and inside and pattern[i : i + 2] == "&&":
            out.append(r"\&")
        else:
            out.append(c)
            inside = (inside or c == "[") and c != "]"
        i += 1
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    return (f"(?{flags})" if flags else "") + "".join(out)
