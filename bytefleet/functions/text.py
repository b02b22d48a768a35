"""Pattern predicates over names and payloads, compiled to built-in column expressions when the plan is made."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(text: Column) -> Column:
    """a-z become A-Z and nothing else changes, unlike upper()."""
    return F.translate(text, _LOWER, _UPPER)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes: the fold of 7-bit PETSCII."""
    return F.translate(text, _UPPER, _LOWER)


def _fold(pattern: str) -> str:
    return pattern.translate(str.maketrans(_LOWER, _UPPER))


def name_matches(name: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Whole-name match: `?` is one character, a first `%` skips to the FIRST occurrence of the next character
    (there is no backtracking), any later `%` accepts whatever follows.

    A pattern that begins with `%%` or `%?` is refused. A `?` after a leading `%` is checked one place too far,
    as the semantics ask, so one at the very end never matches. A null name is no match (null).
    """
    if pattern[:2] in ("%%", "%?"):
        raise ValueError("a pattern can't begin with %% or %?")
    if not case_sensitive:
        name, pattern = ascii_upper(name), _fold(pattern)
    skip = len(pattern) > 1 and pattern[0] == "%"
    body, open_end = (pattern[1:] if skip else pattern), False
    if "%" in body:
        body, open_end = body[: body.index("%")], True
    if skip:
        found = F.instr(name, body[0])
        rest, there = F.substr(name, F.greatest(found, F.lit(1))), found > 0
    else:
        rest, there = name, F.lit(True)
    if "?" not in body:
        if open_end:
            return there & F.startswith(rest, F.lit(body)) if body else there
        return there & (rest == F.lit(body))
    regex = "(?s)^" + "".join("." if c == "?" else re.escape(c) for c in body) + ("" if open_end else r"\z")
    if skip:
        last = max(k for k, c in enumerate(body) if c == "?")
        there = there & (F.char_length(rest) > last + 1)
    return there & F.rlike(rest, F.lit(regex))


def inside_matches(text: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Substring match over text; `?` and `%` each stand for one arbitrary character.

    A trailing wildcard needs no character to stand on. A null text is no match (null).
    """
    if not case_sensitive:
        text, pattern = ascii_upper(text), _fold(pattern)
    core = pattern.rstrip("?%")
    if not core:
        return F.char_length(text) > 0
    if not re.search(r"[?%]", core):
        return F.contains(text, F.lit(core))
    return F.rlike(text, F.lit("(?s)" + "".join("." if c in "?%" else re.escape(c) for c in core)))


def hex_inside(data: Column, digits: str) -> Column:
    """The bytes that the digits name occur in a binary payload; an odd last digit is ignored."""
    if not re.fullmatch(r"[0-9A-Fa-f]+", digits):
        raise ValueError("hexadecimal digits only")
    whole = digits[: len(digits) // 2 * 2]
    return F.contains(data, F.unhex(F.lit(whole)))
