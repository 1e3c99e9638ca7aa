"""Splitting oversized texts at natural boundaries, with an overlap between neighbours.

A hierarchy of separators (section, paragraph, line, sentence, word, character) is applied recursively: a unit that fits stays
whole, a unit that does not is split at the next finer separator. Units are packed greedily up to the limit; each further piece
starts ``overlap`` characters before the end of the one before it. Offsets are code points of the stored text, and the pieces
without their overlaps give the text back exactly.

Defined results: a null text has no pieces; a text within the limit is one piece; an empty text is one empty piece in
``split_texts`` and no case in ``found``; an overlap of the limit or more counts as limit - 1.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, DEFAULT_OVERLAP = 3200, 250

#: Separators from coarse to fine. A unit ends after the match.
SEPARATORS = [
    ("section", re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*){2,}|\f|(?:\r\n|\r|\n)[ \t]*[-=_*]{3,}[ \t]*(?:\r\n|\r|\n)")),
    ("paragraph", re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")),
    ("line", re.compile(r"\r\n|\r|\n")),
    ("sentence", re.compile(r"[.!?…。！？][\"'»”’)\]]*\s+|[。！？]")),
    ("word", re.compile(r"\s+")),
]
LEVELS = [n for n, _ in SEPARATORS] + ["character", "end"]

_NUMBER = re.compile(r"(\d+(?:[_,]\d{3})*(?:\.\d+)?)\s*(k\b)?\s*(%)?")


def parse_profile(text: str | None) -> tuple[int, int]:
    """(limit, overlap) in characters from a profile's notation. Null or blank, and what it leaves out, means 3200 and 250.
    k is thousand, a percentage is of the limit. The number next to the word overlap is the overlap, otherwise the second."""
    if text is None or not text.strip():
        return DEFAULT_LIMIT, DEFAULT_OVERLAP
    t = text.lower()
    found = [(m.start(), m.end(), float(re.sub("[_,]", "", m[1])) * (1000 if m[2] else 1), bool(m[3])) for m in _NUMBER.finditer(t)]
    overlap = limit = None
    word = t.find("overlap")
    percent = [f for f in found if f[3]]
    if percent:
        overlap = percent[0]
    elif word >= 0:
        after = [f for f in found if f[0] > word and not re.search(r"[a-z]", t[word + 7 : f[0]])]
        before = [f for f in found if f[1] <= word]
        overlap = after[0] if after else (before[-1] if len(before) > 1 else None)
    elif len(found) > 1:
        overlap = found[1]
    rest = [f for f in found if f is not overlap]
    if rest:
        limit = rest[0]
    size = int(limit[2]) if limit else DEFAULT_LIMIT
    if overlap is None:
        return size, DEFAULT_OVERLAP
    return size, int(round(size * overlap[2] / 100)) if overlap[3] else int(overlap[2])


def _units(text: str, a: int, b: int, room: int, level: int, out: list[tuple[int, int]]) -> None:
    """Ends of the units of text[a:b], none longer than room, with the level each end was cut at."""
    if b - a <= room or level == len(SEPARATORS):
        at = a
        while b - at > room:
            at += room
            out.append((at, len(SEPARATORS)))
        return
    start = a
    for m in SEPARATORS[level][1].finditer(text, a, b):
        end = m.end()
        if end <= start or end >= b:
            continue
        _units(text, start, end, room, level + 1, out)
        out.append((end, level))
        start = end
    _units(text, start, b, room, level + 1, out)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces: every end - start <= limit, each start = the previous end - overlap."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    ends: list[tuple[int, int]] = []
    _units(text, 0, n, limit - overlap, 0, ends)
    ends.append((n, len(LEVELS) - 1))
    out, start, k = [], 0, 0
    while True:
        best = k
        while best + 1 < len(ends) and ends[best + 1][0] - start <= limit:
            best += 1
        end, level = ends[best]
        out.append((start, end, LEVELS[level]))
        if end >= n:
            return out
        start, k = max(0, end - overlap), best + 1


_PIECES = "mail_id long, max_chars int, overlap_chars int, piece_no int, n_pieces int, char_start int, char_end int, boundary string, piece string"
_SCHEMA = pa.schema([("mail_id", pa.int64()), ("max_chars", pa.int32()), ("overlap_chars", pa.int32()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("boundary", pa.string()), ("piece", pa.string())])


def _cut_batches(batches):
    for b in batches:
        cols: list[list] = [[] for _ in _SCHEMA]
        size = 0
        for mail, limit, overlap, text in zip(*(c.to_pylist() for c in b.columns)):
            got = cut(text, limit, overlap)
            for i, (s, e, boundary) in enumerate(got, 1):
                for c, v in zip(cols, (mail, limit, overlap, i, len(got), s, e, boundary, text[s:e])):
                    c.append(v)
            size += len(text)
            if size > 16_000_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)
                cols, size = [[] for _ in _SCHEMA], 0
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _profile_batches(batches):
    for b in batches:
        got = [parse_profile(t) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())], names=["job_version_id", "max_chars", "overlap_chars"])


def profiles(versions: DataFrame) -> DataFrame:
    """job_version_id, max_chars, overlap_chars."""
    return versions.select("job_version_id", "segment_profile").where("job_version_id is not null").mapInArrow(_profile_batches, "job_version_id long, max_chars int, overlap_chars int")


def split_mails(mail: DataFrame, versions: DataFrame) -> DataFrame:
    """Pieces of every text_body longer than its limit. A null or unknown job_version_id means the default limits."""
    m = mail.select("mail_id", "job_version_id", "text_body").join(profiles(versions), "job_version_id", "left")
    m = m.select("mail_id", F.coalesce("max_chars", F.lit(DEFAULT_LIMIT)).alias("max_chars"), F.coalesce("overlap_chars", F.lit(DEFAULT_OVERLAP)).alias("overlap_chars"), "text_body")
    return m.where("char_length(text_body) > max_chars").mapInArrow(_cut_batches, _PIECES)


def found(mail: DataFrame, versions: DataFrame) -> DataFrame:
    return split_mails(mail, versions).where("piece_no = 1 and n_pieces > 1").select("mail_id", "max_chars", "overlap_chars")
