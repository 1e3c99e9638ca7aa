"""The filter language: SQL-like expressions over fields, compiled to Columns so that Catalyst pushes them to the scan.

    expression := term (OR term)* ; term := factor (AND factor)* ; factor := NOT factor | ( expression ) | predicate
    predicate  := field (= | != | <> | < | <= | > | >=) literal | field [NOT] LIKE text | field IS [NOT] NULL
                | field [NOT] IN (literal, ...) | field [NOT] BETWEEN literal AND literal

Literals are quoted text, numbers, TRUE, FALSE and NULL. LIKE ignores case. A comparison with NULL is NULL, as in SQL. Multi-valued
fields (array columns) compare existentially; != negates the whole comparison. Text dates compare as text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebolt.plans.fields import Catalog, Field

# Limits of an expression.
MAX_LENGTH, MAX_IN = 8192, 999


class FilterError(ValueError):
    pass


_TOKEN = re.compile(r"""\s*(?:('(?:[^']|'')*'|"(?:[^"]|"")*")|(-?\d+(?:\.\d+)?(?![\w.]))|(<=|>=|!=|<>|=|<|>|\(|\)|,)|([A-Za-z_][\w.]*))""")
_WORDS = {"and", "or", "not", "like", "is", "null", "in", "between", "true", "false"}


def tokens(text: str) -> list[tuple[str, object]]:
    if len(text) > MAX_LENGTH:
        raise FilterError(f"filter longer than {MAX_LENGTH} characters")
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"cannot read the filter at: {text[at:at + 20]!r}")
        quoted, number, op, word = m.groups()
        if quoted is not None:
            out.append(("text", quoted[1:-1].replace(quoted[0] * 2, quoted[0])))
        elif number is not None:
            out.append(("number", float(number) if "." in number else int(number)))
        elif op is not None:
            out.append(("op", op))
        else:
            out.append(("word", word.lower()) if word.lower() in _WORDS else ("name", word))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, catalog: Catalog, column):
        self.t, self.i, self.catalog, self.column = tokens(text), 0, catalog, column

    def peek(self, kind: str, value=None) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] == kind and (value is None or self.t[self.i][1] == value)

    def take(self, kind: str, value=None):
        if not self.peek(kind, value):
            got = self.t[self.i][1] if self.i < len(self.t) else "the end"
            raise FilterError(f"expected {value or kind}, found {got}")
        self.i += 1
        return self.t[self.i - 1][1]

    def maybe(self, kind: str, value) -> bool:
        if self.peek(kind, value):
            self.i += 1
            return True
        return False

    def expression(self) -> Column:
        parts = [self.conjunction()]
        while self.maybe("word", "or"):
            parts.append(self.conjunction())
        return reduce(lambda a, b: a | b, parts)

    def conjunction(self) -> Column:
        parts = [self.factor()]
        while self.maybe("word", "and"):
            parts.append(self.factor())
        return reduce(lambda a, b: a & b, parts)

    def factor(self) -> Column:
        if self.maybe("word", "not"):
            return ~self.factor()
        if self.maybe("op", "("):
            e = self.expression()
            self.take("op", ")")
            return e
        return self.predicate()

    def literal(self, f: Field):
        for kind in ("text", "number"):
            if self.peek(kind):
                return value_of(f, self.take(kind))
        for word, v in (("true", True), ("false", False), ("null", None)):
            if self.maybe("word", word):
                return v
        raise FilterError("expected a literal")

    def predicate(self) -> Column:
        f = self.catalog.resolve(self.take("name"))
        c = self.column(f)
        if self.peek("op"):
            op = self.take("op")
            if op not in COMPARE:
                raise FilterError(f"not a comparison: {op}")
            v = self.literal(f)
            return c.compare(op, v)
        negate = self.maybe("word", "not")
        if self.maybe("word", "like"):
            like = self.take("text")
            return c.negated(negate, lambda x: x.cast("string").ilike(like))
        if self.maybe("word", "in"):
            self.take("op", "(")
            vs = [self.literal(f)]
            while self.maybe("op", ","):
                vs.append(self.literal(f))
            self.take("op", ")")
            if len(vs) > MAX_IN:
                raise FilterError(f"more than {MAX_IN} values")
            return c.negated(negate, lambda x: x.isin(*vs))
        if self.maybe("word", "between"):
            a = self.literal(f)
            self.take("word", "and")
            b = self.literal(f)
            return c.negated(negate, lambda x: x.between(a, b))
        self.take("word", "is")
        negate = self.maybe("word", "not")
        self.take("word", "null")
        return c.is_null(negate)


COMPARE = {
    "=": lambda x, v: x == v, "!=": lambda x, v: x != v, "<>": lambda x, v: x != v, "<": lambda x, v: x < v,
    "<=": lambda x, v: x <= v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v,
}


class Scalar:
    """A plain column in a predicate."""

    def __init__(self, c: Column):
        self.c = c

    def compare(self, op: str, v) -> Column:
        return COMPARE[op](self.c, F.lit(v))

    def negated(self, negate: bool, test) -> Column:
        return ~test(self.c) if negate else test(self.c)

    def is_null(self, negate: bool) -> Column:
        return self.c.isNotNull() if negate else self.c.isNull()


class Multi(Scalar):
    """An array column: true if some value passes; != is the negation of =."""

    def compare(self, op: str, v) -> Column:
        if op in ("!=", "<>"):
            return ~self.compare("=", v)
        return F.coalesce(F.exists(self.c, lambda x: COMPARE[op](x, F.lit(v))), F.lit(False))

    def negated(self, negate: bool, test) -> Column:
        e = F.coalesce(F.exists(self.c, test), F.lit(False))
        return ~e if negate else e

    def is_null(self, negate: bool) -> Column:
        empty = F.coalesce(F.size(self.c), F.lit(0)) <= 0
        return ~empty if negate else empty


def value_of(f: Field, v):
    """A literal in the field's type."""
    try:
        if f.kind == "integer" and isinstance(v, str):
            return int(v)
        if f.kind == "real" and not isinstance(v, bool):
            return float(v)
        if f.kind == "boolean" and not isinstance(v, bool):
            s = str(v).lower()
            if s not in ("1", "0", "true", "false", "yes", "no"):
                raise ValueError(s)
            return s in ("1", "true", "yes")
        if f.kind in ("text", "date") and not isinstance(v, str):
            return str(v)
    except ValueError as e:
        raise FilterError(f"{f.name} is {f.kind}, not {v!r}") from e
    return v


def compile_filter(text: str, catalog: Catalog, columns: dict[str, Column] | None = None, multi: tuple[str, ...] = ()) -> Column:
    """Column of an expression. ``columns`` replaces fields (virtual ones) by Columns, ``multi`` names array fields."""
    columns = columns or {}
    of = lambda f: (Multi if f.name in multi else Scalar)(columns.get(f.name, F.col(f"`{f.name}`")))
    p = _Parser(text, catalog, of)
    e = p.expression()
    if p.i != len(p.t):
        raise FilterError(f"unexpected: {p.t[p.i][1]}")
    return e


TUPLE_OPS = {"eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def tuple_filter(field: str, op: str, value, catalog: Catalog, columns: dict[str, Column] | None = None) -> Column:
    """The programmatic form: field, eq|neq|gt|gte|lt|lte|contains|is-null|not-null, value; values are never spliced into text."""
    f = catalog.resolve(field)
    c = (columns or {}).get(f.name, F.col(f"`{f.name}`"))
    if op in TUPLE_OPS:
        return COMPARE[TUPLE_OPS[op]](c, F.lit(value_of(f, value)))
    if op == "contains":
        return F.contains(F.lower(c.cast("string")), F.lower(F.lit(str(value))))
    if op in ("is-null", "not-null"):
        return c.isNull() if op == "is-null" else c.isNotNull()
    raise FilterError(f"unknown operator: {op}")
