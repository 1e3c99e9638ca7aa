"""Mail headers printed in a text: blocks of From, To, Cc, Bcc, Sent, Date and Subject lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The labels of a block, and the lines of a text in which its own headers stand.
LABELS = ("from", "to", "cc", "bcc", "sent", "date", "subject")
OWN_LINES = 60

BLOCK = T.StructType([T.StructField(x, T.StringType()) for x in LABELS])
_LABEL = re.compile(rf"({'|'.join(LABELS)}):\s*(.*)", re.I)


def _fields(lines: list[str]):
    """(label, text) of each labelled line; None where a block cannot go on: ("", "blank") and ("", "other") lines. Indented lines belong
    to the label above."""
    for line in lines:
        bare = line.strip()
        m = _LABEL.fullmatch(bare)
        yield (m[1].lower(), m[2]) if m else ("", "blank") if not bare else ("+", bare) if line[0].isspace() else ("", "other")


def header_blocks(text: str | None, most_lines: int | None = None) -> list[dict[str, str]]:
    """The blocks of a text, in order. A block has a sender and one other field; it ends at a blank or foreign line once it has two fields, or at
    the next sender."""
    blocks: list[dict[str, str]] = [{}]
    last = None
    for label, value in _fields(re.split(r"\r\n|\r|\n", text or "")[:most_lines]):
        now = blocks[-1]
        if (label == "" or label == "from") and len(now) >= 2:
            blocks.append({})
            now, last = blocks[-1], None
        if label == "+":
            if last:
                now[last] += " " + value
        elif label:
            now[label], last = value, label
        elif value == "other" and not now:
            last = None
    clean = [{k: " ".join(v.split()) for k, v in b.items() if v.strip()} for b in blocks]
    return [b for b in clean if "from" in b and len(b) >= 2]


@F.pandas_udf(T.ArrayType(BLOCK))
def blocks(s: pd.Series) -> pd.Series:
    """All header blocks of a text; null for a null text."""
    return s.map(lambda t: [{k: b.get(k) for k in LABELS} for b in header_blocks(t)] if isinstance(t, str) else None)


@F.pandas_udf(BLOCK)
def own_headers(s: pd.Series) -> pd.DataFrame:
    """The first block among the first OWN_LINES lines: the headers of the text itself, which show that it is a mail."""
    rows = [(header_blocks(t, OWN_LINES) or [{}])[0] if isinstance(t, str) else {} for t in s]
    return pd.DataFrame([{k: r.get(k) for k in LABELS} for r in rows], columns=LABELS)


def chain_people(c) -> Column:
    """Distinct senders and recipients of all blocks, in first-seen order (an array)."""
    parts = F.flatten(F.transform(c, lambda b: F.array_compact(F.array(b["from"], b["to"], b["cc"], b["bcc"]))))
    people = F.flatten(F.transform(parts, lambda x: F.filter(F.transform(F.split(x, ";"), lambda y: F.trim(y)), lambda y: y != "")))
    return F.array_distinct(people)
