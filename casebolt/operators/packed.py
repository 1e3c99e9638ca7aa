"""Several values packed in one field: the dialect with the shortest description wins, then every field is parsed with it.

A dialect is a delimiter set with its quoting. Each distinct field text is parsed under every dialect that could apply. The
values of all parses are counted over the whole collection (each parse of a text weighs 1 / number of its parses), and the
count of a value gives its code length; a parse costs its dialect, its values and the quote marks it leaves over. The cheapest
parse of each text is joined back to the rows. Only texts with more than one distinct parse are scored.

Nulls, blanks and texts of delimiters only give no value. Items are trimmed, empty ones take no position, repeated ones stay.
Equal texts always get equal results; ties go to the simpler dialect. Texts of any length are parsed whole.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebolt.common import Scratch

#: Description of a value that occurs nowhere else: bits per character and per value.
CHAR_BITS, VALUE_BITS, STRAY_BITS = 5.0, 8.0, 14.0

_DELIMS = ",;|\t\n"
_NAMES = {",": "comma", ";": "semicolon", "|": "pipe", "\t": "tab", "\n": "line"}


def _pattern(delims: str) -> re.Pattern:
    d = re.escape(delims)
    return re.compile(
        rf' *(?:"((?:[^"\\]|""|\\.)*)"(?= *(?:[{d}]|\Z))|\'((?:[^\'\\]|\'\'|\\.)*)\'(?= *(?:[{d}]|\Z))|((?:\\.|[^{d}\\]|\\\Z)*)) *(?:[{d}]|\Z)', re.S
    )


_PATTERNS: dict[str, re.Pattern] = {}
_UNESCAPE = re.compile(r"\\(.)", re.S)


def _split(text: str, delims: str) -> list[str]:
    """The non-empty values of a text: double or single quotes, doubled quotes and backslashes protect delimiters."""
    p = _PATTERNS.get(delims) or _PATTERNS.setdefault(delims, _pattern(delims))
    out, at, n = [], 0, len(text)
    while at <= n:
        m = p.match(text, at)
        double, single, bare = m.groups()
        if double is not None:
            v = _UNESCAPE.sub(r"\1", double.replace('""', '"'))
        elif single is not None:
            v = _UNESCAPE.sub(r"\1", single.replace("''", "'"))
        else:
            v = re.sub(rf"\\([{re.escape(delims)}\"'\\])", r"\1", bare)
        if v := v.strip():
            out.append(v)
        if m.end() >= n and (m.end() == at or m.end() == n):
            break
        at = m.end()
    return out


def label_parses(text: str) -> list[tuple[str, float, list[str]]]:
    """(dialect, bits, values) of a list of labels under each applicable dialect, the simpler first."""
    t = text.strip(" \r\n\t")
    if not t:
        return []
    if t[0] == "[" and t[-1] == "]":
        try:
            got = json.loads(t)
            if isinstance(got, list) and all(isinstance(x, str) for x in got):
                return [("json", 2.0, [y for x in got if (y := x.strip())])]
        except ValueError:
            pass
        if t.count("[") == t.count("]") == 1:
            t = t[1:-1].strip()
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    there = [d for d in _DELIMS if d in t]
    out = [("whole", 1.0, _split(t, "\0"))] if len(there) == 0 else [("whole", 1.0, [w for w in [t] if w.strip(_DELIMS + " ")])]
    out += [(_NAMES[d], 3.0, _split(t, d)) for d in there]
    if len(there) > 1:
        out.append(("mixed", 6.0, _split(t, "".join(there))))
    return out


# ---- addresses
_TOKEN = re.compile(r'"(?:[^"\\]|""|\\.)*"|<[^<>]*>|\([^()]*\)|\\.|[,;\n]|[^",;\n<(\\]+|.', re.S)
_EMAIL = re.compile(r"[^\s<>\"'(),;:\[\]\\]+@[^\s<>\"'(),;:\[\]\\]+")
_GROUP = re.compile(r"^\s*[^\s\"<>@,;:][^\"<>@,;:]*:\s*")


def _chunks(text: str, delims: str) -> list[tuple[str, str]]:
    """(raw value, delimiter after it); quotes, angle brackets and comments protect delimiters."""
    out, now = [], []
    for m in _TOKEN.finditer(text):
        x = m[0]
        if x in delims and len(x) == 1:
            out.append(("".join(now).strip(), x))
            now = []
        else:
            now.append(x)
    out.append(("".join(now).strip(), ""))
    return out


def address_value(raw: str) -> str:
    """The e-mail address in lower case, else the name without quotes."""
    angle = re.findall(r"<\s*([^<>\s]+@[^<>\s]+)\s*>", raw)
    if angle:
        return angle[-1].lower()
    bare = re.sub(r'"(?:[^"\\]|""|\\.)*"', " ", raw)
    if m := _EMAIL.search(bare) or _EMAIL.search(raw):
        return m[0].strip(".").lower() if m[0].lower().startswith("mailto:") is False else m[0][7:].lower()
    v = raw.strip()
    if len(v) > 1 and v[0] == v[-1] == '"':
        v = _UNESCAPE.sub(r"\1", v[1:-1].replace('""', '"'))
    elif len(v) > 1 and v[0] == v[-1] == "'":
        v = v[1:-1]
    return re.sub(r"\s*<>\s*$", "", v.replace("\\,", ",")).strip()


def _joined(chunks: list[tuple[str, str]]) -> list[str]:
    """Single words on both sides of a bare comma are one name (Family, Given), with or without an address after it."""
    out, k = [], 0
    while k < len(chunks):
        raw, after = chunks[k]
        if after == "," and k + 1 < len(chunks) and _single(raw) and _single(re.sub(r"\s*(<[^<>]*>|\([^()]*\))\s*$", "", chunks[k + 1][0])):
            raw, k = f"{raw}, {chunks[k + 1][0]}", k + 1
        out.append(raw)
        k += 1
    return out


def _single(raw: str) -> bool:
    return bool(raw) and not re.search(r'[\s"<>@():]', raw)


_PROTECTED = re.compile(r'"(?:[^"\\]|""|\\.)*"|<[^<>]*>|\([^()]*\)', re.S)


def _clean(raw: str) -> bool:
    """One value: no delimiter outside quotes, brackets and comments but the comma of a bare Family, Given name."""
    rest = _GROUP.sub("", _PROTECTED.sub("", raw)).strip()
    if ";" in rest or "\n" in rest or rest.count("@") + raw.count("<") > 1:
        return False
    return "," not in rest or bool(re.fullmatch(r"[^\s,@]+,\s*[^\s,@]+", rest))


def _values(raws: list[str]) -> list[str]:
    out = []
    for raw in raws:
        if (m := _GROUP.match(raw)) and not raw.lower().startswith("mailto:"):
            raw = raw[m.end() :]
        if raw and (v := address_value(raw)):
            out.append(v)
    return out


def address_parses(text: str) -> list[tuple[str, float, list[str]]]:
    """(dialect, bits, values) of an address list, the simpler first. A folded line (line end and blank) is no delimiter of its own."""
    t = re.sub(r"\r\n?", "\n", text).strip(" \n\t")
    if not t.strip(",; \n\t"):
        return []
    there = [d for d in ",;\n" if d in t]
    if not there:
        return [("whole", 1.0, _values([t]))]
    out = [("whole", 1.0, _values([t.strip(",; \n")]) if _clean(t.strip(",; \n")) else [t])]
    for d in there:
        cut = _chunks(t, d + "\n" if d != "\n" else d)
        got = _joined(cut) if d == "," else [r for r, _ in cut]
        # what this dialect leaves with a delimiter inside is no value: it stays as written and costs its marks
        out.append((_NAMES[d], 3.0, [x for r in got for x in (_values([r]) if _clean(r) else [r])]))
    if len(there) > 1:
        out.append(("mixed", 5.0, _values(_joined(_chunks(t, ",;\n")))))
    return out


_STRAY = re.compile(r"^[\"'\[\]]|[\"'\[\]\\]$|\\[,;|]|\"\s*[,;|]|[,;|]\s*\"")

_BARE_NAME = re.compile(r"^[^\s,]+, [^\s,]+$")


def _stray(kind: str, item: str) -> int:
    """Delimiters and quote marks that a value still holds although they look like packing."""
    n = int(bool(_STRAY.search(item)))
    if kind == "addresses":
        n += item.count(";") + item.count("\n") + max(0, item.count("@") - 1)
        n += "," in item and not _BARE_NAME.match(item)
    return n


_CAND = "k1 long, k2 long, kind string, n_parses int, parse_no int, dialect string, bits double, items array<string>"


def _parse_batches(batches):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kind", pa.string()), ("n_parses", pa.int32()), ("parse_no", pa.int32()), ("dialect", pa.string()), ("bits", pa.float64()), ("items", pa.list_(pa.string()))])
    for b in batches:
        cols: list[list] = [[] for _ in schema]
        for k1, k2, kind, text in zip(*(c.to_pylist() for c in b.columns)):
            seen, kept = set(), []
            for dialect, bits, items in label_parses(text) if kind == "labels" else address_parses(text):
                key = tuple(items)
                if items and key not in seen:
                    seen.add(key)
                    kept.append((dialect, bits + STRAY_BITS * sum(_stray(kind, x) for x in items), items))
            for i, (dialect, bits, items) in enumerate(kept):
                for c, v in zip(cols, (k1, k2, kind, len(kept), i, dialect, bits, items)):
                    c.append(v)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def split_packed(df: DataFrame, id_col: str, kinds: dict[str, str], scratch: Scratch | None = None) -> DataFrame:
    """One row per value: ``id_col``, field_name, dialect, pos (from 1), item.

    ``kinds`` maps column -> 'labels' or 'addresses'. Values are counted per kind over all rows' distinct texts."""
    scratch = scratch or Scratch(df.sparkSession, "packed")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(k).alias("kind"), F.col(c).alias("text")) for c, k in kinds.items()])).alias("x")
    rows = df.select(F.col(id_col), fields).select(id_col, "x.*").where(r"text is not null and text rlike '[^\\s,;|]'")
    rows = rows.withColumns({"k1": F.xxhash64("kind", "text"), "k2": F.xxhash64(F.lit(7), "text", "kind")})
    texts = rows.groupBy("k1", "k2").agg(F.first("kind").alias("kind"), F.first("text").alias("text"))
    cand = scratch.put(texts.select("k1", "k2", "kind", "text").mapInArrow(_parse_batches, _CAND))
    # Values are counted and looked up by a 64-bit hash: a collision can only change a code length.
    coded_items = lambda c: c.select("kind", "k1", "k2", "parse_no", "bits", "n_parses", F.explode("items").alias("item")).select("kind", "k1", "k2", "parse_no", "bits", (1 / F.col("n_parses")).cast("float").alias("w"), F.xxhash64("kind", "item").alias("h"), (CHAR_BITS * F.length("item") + VALUE_BITS).cast("float").alias("unknown"))
    counts = coded_items(cand).groupBy("h", "kind").agg(F.sum("w").alias("w"))
    total = {r["kind"]: r["total"] for r in counts.groupBy("kind").agg(F.sum("w").alias("total")).collect()}  # one row per kind
    total_of = F.element_at(F.create_map(*[F.lit(x) for kv in (total or {"": 1.0}).items() for x in kv]), F.col("kind"))
    known = counts.select("h", F.col("w").alias("seen"), F.log2(total_of / F.col("w")).alias("code"))
    # The texts with one parse only need no score; the others are scored value by value, regrouped once.
    open_ = coded_items(cand.where("n_parses > 1")).select("k1", "k2", "parse_no", "bits", "h", "unknown")
    bits = F.least(F.col("code") + F.col("unknown") / F.greatest("seen", F.lit(0.5)), F.col("unknown")) + 1
    scored = open_.join(known, "h").select("k1", "k2", F.col("parse_no").cast("short"), F.col("bits").cast("float"), bits.cast("float").alias("b"))
    per = scored.repartition("k1", "k2").groupBy("k1", "k2", "parse_no").agg((F.max("bits") + F.sum("b")).alias("cost"))
    best = per.groupBy("k1", "k2").agg(F.min(F.struct(F.round("cost", 3).alias("cost"), "parse_no")).alias("b")).select("k1", "k2", F.col("b.parse_no").cast("int").alias("parse_no"))
    chosen = best.join(cand.where("n_parses > 1"), ["k1", "k2", "parse_no"]).select("k1", "k2", "dialect", "items").unionByName(cand.where("n_parses = 1").select("k1", "k2", "dialect", "items"))
    out = rows.select(id_col, "field_name", "k1", "k2").join(chosen, ["k1", "k2"])
    return out.select(id_col, "field_name", "dialect", F.posexplode("items").alias("pos", "item")).withColumn("pos", F.col("pos") + 1)


def found(gmail: DataFrame) -> DataFrame:
    got = split_packed(gmail.select("meta_id", "labels", "cc", "bcc"), "meta_id", {"labels": "labels", "cc": "addresses", "bcc": "addresses"})
    return got.select("meta_id", "field_name", "pos", "item")
