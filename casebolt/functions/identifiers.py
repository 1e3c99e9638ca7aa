"""Normal forms of entity identifiers: e-mail, handle, phone, message ids, subjects; null where a value is none."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Wide forms of ASCII characters and blanks that compatibility normalisation makes plain.
_WIDE = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "\u3000\u00a0\u2002\u2003\u2009\u202f"
_PLAIN = "".join(chr(x) for x in range(0x21, 0x7F)) + " " * 6


@F.pandas_udf(T.StringType())
def nfkc(s):
    """Unicode compatibility composition (NFKC); plain() does its common part inside the JVM."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else None)


@F.pandas_udf(T.StringType())
def nfc(s):
    """Unicode composition (NFC), the form of stored texts."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else None)


def plain(c) -> Column:
    """Wide characters and odd blanks made plain, trimmed."""
    return F.regexp_replace(F.translate(_col(c), _WIDE, _PLAIN), r"^\s+|\s+$", "")


def email(c) -> Column:
    """Lower case, without mailto: and the marks around it; any local part of the mail standard, a host with a dot in it."""
    marks = lambda x: F.regexp_replace(x, "^[<>;,]+|[<>;,]+$", "")
    v = marks(F.regexp_replace(F.lower(marks(plain(c))), "^mailto:", ""))
    host = F.substring_index(v, "@", -1)
    return F.when(v.rlike(r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9]([a-z0-9.-]*[a-z0-9])?$") & host.contains("."), v)


def handle(c) -> Column:
    """Lower case without one leading @ and blanks; 2 to 128 letters, digits, dots, lines."""
    v = F.lower(F.regexp_replace(F.regexp_replace(plain(c), "^@", ""), r"\s+", ""))
    return F.when(v.rlike(r"^[a-z0-9._-]{2,128}$"), v)


def phone(c) -> Column:
    """The digits of a number with an extension as x and its digits. A number written with + keeps it, ten digits and eleven that start
    with 1 are North American and get it, others have none. 7 to 15 digits; under ten only if written like a phone number."""
    v = plain(c)
    pattern = r"(?i)(?:ext\.?|extension|x)\s*([0-9]{1,10})\b"
    ext = F.regexp_extract(v, pattern, 1)
    main = F.trim(F.when(ext != "", F.concat(F.regexp_extract(v, rf"(?s)^(.*?){pattern}", 1), F.regexp_extract(v, rf"(?s)^.*?{pattern}(.*)$", 2))).otherwise(v))
    d = F.regexp_replace(main, "[^0-9]", "")
    north = (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))
    base = F.when(main.startswith("+"), F.concat(F.lit("+"), d)).when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when(north, F.concat(F.lit("+"), d)).otherwise(d)
    ok = F.length(d).between(7, 15) & (main.rlike(r"[()+\-\s.]") | (F.length(d) >= 10))
    return F.when(ok, F.concat(base, F.when(ext != "", F.concat(F.lit("x"), ext)).otherwise("")))


def lookup_text(c) -> Column:
    """Lower case, letters, digits and identifier marks only, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain(c)), r"[^\p{L}\p{N}_@.+#/-]+", " "), r"\s+", " "))


def subject(c) -> Column:
    """Subject without its reply and forward marks, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_col(c), r"\s+", " "), r"(?i)^\s*((re|fwd?)\s*(\[\d+\])?\s*:\s*)+", "")))


def message_ids(c) -> Column:
    """Distinct message ids of a references field, in order, in lower case without brackets."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(_col(c)), F.lit("<([^<>\\s]+)>"), F.lit(1)), lambda x: x))


def index_root(c) -> Column:
    """The root of a conversation index: its first 44 characters without white space."""
    v = F.substring(F.regexp_replace(_col(c), r"\s+", ""), 1, 44)
    return F.when(v != "", v)


def label(name, mail, tel, ident) -> Column:
    """name <email>, else name, e-mail, phone, else Unknown Entity and its id."""
    name, mail, tel = (F.when(F.trim(_col(x)) != "", F.trim(_col(x))) for x in (name, mail, tel))
    both = F.when(name.isNotNull() & mail.isNotNull() & (F.lower(name) != F.lower(mail)), F.concat(name, F.lit(" <"), mail, F.lit(">")))
    return F.coalesce(both, name, mail, tel, F.concat(F.lit("Unknown Entity "), _col(ident).cast("string")))
