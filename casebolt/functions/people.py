"""Names, value lists and identifiers inside free entity text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebolt.operators.packed import address_parses

# Honorifics and marks that are no part of a name, and words of mail stores around one.
NO_NAME = "mr|mrs|ms|miss|dr|prof|jr|sr|ii|iii|iv|esq"
STORES = "mailbox|archive|export|pst|mbox"

NAME = T.StructType([T.StructField(c, T.StringType()) for c in ("given", "middle", "family", "full_name", "sort_name")] + [T.StructField("is_full", T.BooleanType())])
_NO_NAME, _STORES = re.compile(rf"(?i)\b(?:{NO_NAME})\b\.?"), re.compile(rf"(?i)\b(?:{STORES})\b")


def _lookup(t: str) -> str:
    return " ".join(re.sub(r"[^\w@.+#/-]+", " ", t.lower()).split())


def name_words(text: str) -> list[str]:
    """The words of a name, without marks, honorifics and full stops."""
    return [w for w in re.split(r"[\s.]+", _NO_NAME.sub(" ", re.sub("[\"'()<>]", " ", text))) if re.search("[A-Za-z]", w)]


def parse_name(text: str | None) -> dict | None:
    """given, middle, family, full and sort form, and whether given and family part are there. "Family, Given" is turned round; one word
    is a given part. Blank texts, addresses and texts without a letter name nobody."""
    t = " ".join(unicodedata.normalize("NFKC", text or "").split())
    bare = " ".join(_STORES.sub(" ", t).split())
    t = bare if len(name_words(bare)) > 1 else t
    if not t or "@" in t:
        return None
    family, given = (name_words(x) for x in ([*t.split(",", 1), ""])[:2])
    if not (family and given):
        words = name_words(t)
        given, family = (words[:-1], words[-1:]) if len(words) > 1 else (words, [])
    if not given:
        return None
    form = lambda ws: _lookup(" ".join(ws))
    sort_name = " ".join(filter(None, map(form, (family, given[:1], given[1:]))))
    return {"given": given[0], "middle": " ".join(given[1:]) or None, "family": " ".join(family) or None, "full_name": form([*given, *family]), "sort_name": sort_name, "is_full": bool(family)}


@F.pandas_udf(NAME)
def name_parts(s: pd.Series) -> pd.DataFrame:
    fields = NAME.fieldNames()
    return pd.DataFrame([(parse_name(x) if isinstance(x, str) else None) or dict.fromkeys(fields) for x in s], columns=fields)


def is_full_name(c) -> Column:
    """Whether a text names somebody by two words or more; inside the JVM."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(c, "[\"'()<>]", " "), rf"(?i)\b(?:{NO_NAME})\b\.?", " ")
    return ~c.contains("@") & (F.size(F.filter(F.split(bare, r"[\s.]+"), lambda w: w.rlike("[A-Za-z]"))) >= 2)


@F.pandas_udf(T.ArrayType(T.StringType()))
def value_list(s: pd.Series) -> pd.Series:
    """The entries of an author or participant field: parted by semicolons, else by commas outside names and quotes."""
    return s.map(lambda x: (address_parses(x) or [(None, 0, [])])[-1][2] if isinstance(x, str) else None)


def artefact(c) -> Column:
    """Names that are traces of an export: a leading dash, no vowel at all, or a short code of mixed case with digits."""
    c = F.col(c) if isinstance(c, str) else c
    code = c.rlike(r"^[A-Za-z0-9_-]{4,8}$") & c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike("[0-9_-]")
    return c.startswith("-") | (~F.lower(c).rlike("[aeiouyäöüáéíóúèàâêîôûñ]") & c.rlike("[A-Za-z]")) | code


def external_ids(c) -> Column:
    """label:value pairs such as "Employee ID: 1234", as label=value in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    pairs = F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z ]{1,24}(?:ID|No|Number|#)\s*[:=]\s*[A-Za-z0-9-]+)"), F.lit(1))
    return F.transform(pairs, lambda x: F.lower(F.regexp_replace(x, r"\s*[:=]\s*", "=")))


def candidate_keys(name, mail, tel, handle) -> Column:
    """Sorted identifier keys of a candidate, kind:value; empty kinds are left out."""
    one = lambda k, c: F.when(F.trim(c) != "", F.concat(F.lit(k + ":"), F.lower(F.trim(c))))
    return F.array_sort(F.array_compact(F.array(one("email", mail), one("handle", handle), one("name", name), one("phone", tel))))
