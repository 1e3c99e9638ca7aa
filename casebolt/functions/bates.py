"""Bates numbers as columns: a lazy prefix and trailing digits. Two numbers are of one series if the trimmed upper-case prefix
and the digit width agree, so A1 and A01 are not. Numbers are decimal(38,0): they can be wider than 64 bits.
A null or a value without trailing digits has no parts and matches nothing; it sorts last."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: prefix and trailing digits of a Bates number.
PATTERN = r"^(.*?)(\d+)$"


def _value(c) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c)


def _head(c) -> Column:
    """What is left of the trailing digits; a plain trim, cheaper than a pattern for each row."""
    return F.rtrim(_value(c), F.lit("0123456789"))


def digits(c) -> Column:
    """The trailing digits, empty without any."""
    return F.substring(_value(c), F.length(_head(c)) + 1, F.lit(64))


def prefix(c) -> Column:
    return F.when(digits(c) != "", F.upper(F.trim(_head(c))))


def width(c) -> Column:
    return F.nullif(F.length(digits(c)), F.lit(0))


def number(c) -> Column:
    return digits(c).try_cast("decimal(38,0)")


def series(c) -> Column:
    """Prefix and width in one key for equi-joins; null without one."""
    return F.concat(prefix(c), F.lit("#"), F.length(digits(c)))


def contains(begin, end, query) -> Column:
    return (series(begin) == series(query)) & (series(F.coalesce(_value(end), _value(begin))) == series(query)) & number(query).between(number(begin), number(F.coalesce(_value(end), _value(begin))))


def overlaps(begin, end, q_begin, q_end) -> Column:
    """Spans of one series that share a number; a missing end is the begin."""
    end, q_end = F.coalesce(_value(end), _value(begin)), F.coalesce(_value(q_end), _value(q_begin))
    same = (series(begin) == series(end)) & (series(q_begin) == series(q_end)) & (series(begin) == series(q_begin))
    return same & (number(begin) <= number(q_end)) & (number(end) >= number(q_begin))


def order(c, tie: str = "id") -> list[Column]:
    """Unparsable last, then prefix, number, raw text."""
    raw = F.col(c) if isinstance(c, str) else c
    return [number(c).isNull(), prefix(c).asc_nulls_last(), number(c).asc_nulls_last(), raw.asc_nulls_last(), F.col(tie)]


_TOKEN = re.compile(r"^\S*\d$")


def parse_query(text: str) -> tuple[str, str] | None:
    """(begin, end) if a search text is a Bates number or range, None if it is a text search. A range needs blanks around its
    dash unless both sides end in digits; a single token with digits at its end is one number."""
    t = text.strip()
    m = re.match(r"^(\S*\d)\s*[-–]\s*(\S*\d)$", t)
    if m and (" " in t or "–" in t):
        return m[1], m[2]
    return (t, t) if _TOKEN.match(t) else None


def within(a: tuple[str, str] | None, b: tuple[str, str]) -> tuple[str, str] | None:
    """Intersection of two ranges of one series, None if they share nothing."""
    if a is None:
        return b
    key = lambda x: (m[1].strip().upper(), len(m[2]), int(m[2])) if (m := re.match(PATTERN, x.strip())) else None
    (a1, a2, b1, b2) = map(key, (*a, *b))
    if None in (a1, a2, b1, b2) or len({k[:2] for k in (a1, a2, b1, b2)}) > 1:
        return None
    low, high = (a[0] if a1[2] >= b1[2] else b[0]), (a[1] if a2[2] <= b2[2] else b[1])
    return (low, high) if key(low)[2] <= key(high)[2] else None
