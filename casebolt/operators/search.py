"""Keyword search on postings: tokens with their positions by scope and column, a boolean query language, BM25 ranking.

    query := or ; or := and (OR and)* ; and := not+ (AND or juxtaposition) ; not := atom (NOT atom)*
    atom  := word | prefix* | "phrase" | column:atom | NEAR(words, n) | ( query )

A posting row is (doc, column, term, tf, positions). ``build`` writes the postings once, in the order of terms, with the lengths of the
documents and their number: a query of the written index reads the row groups of its terms only. Every query term filters the
postings first; matches are set operations over documents, phrases compare positions within one column.
score = -sum idf * f (k1+1) / (f + k1 (1 - b + b |D| / avgdl)), k1 1.2, b 0.75, idf = ln((N - n + .5) / (n + .5)), at least 1e-6;
|D| counts all indexed columns. Smaller is better. Null texts have no postings; a query without hits gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebolt.common import Scratch
from casebolt.functions.text import tokens_of

K1, B = 1.2, 0.75


def _postings_of(columns: list[str]):
    def run(batches):
        for b in batches:
            doc, column, term, tf, places = [], [], [], [], []
            ids = b.column(0).to_pylist()
            for name, texts in zip(columns, b.columns[1:]):
                for i, text in zip(ids, texts.to_pylist()):
                    at: dict[str, list[int]] = {}
                    for k, w in enumerate(tokens_of(text)):
                        at.setdefault(w, []).append(k)
                    doc += [i] * len(at)
                    column += [name] * len(at)
                    term += at
                    places += at.values()
                    tf += map(len, at.values())
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(column, pa.string()), pa.array(term, pa.string()), pa.array(tf, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["doc", "column", "term", "tf", "positions"])

    return run


def index(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Postings (doc, column, term, tf, positions) of the named text columns; made row by row, without a shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), *[F.col(c).cast("string") for c in columns])
    return rows.mapInArrow(_postings_of(columns), "doc long, column string, term string, tf long, positions array<int>")


def lengths(postings: DataFrame) -> DataFrame:
    """(doc, len): tokens of all indexed columns."""
    return postings.groupBy("doc").agg(F.sum("tf").alias("len"))


@dataclass(frozen=True)
class Index:
    """A written index: postings in the order of terms, (doc, len), and (number of documents, mean length)."""

    postings: DataFrame
    sizes: DataFrame
    statistics: tuple[int, float]


def build(docs: DataFrame, id_col: str, columns: list[str], scratch: Scratch) -> Index:
    """Writes the index of the named text columns. Ranges of (term, doc) spread a frequent term over many files."""
    rows = scratch.put(index(docs, id_col, columns))
    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    postings = scratch.put(rows.repartitionByRange(parts, "term", "doc").sortWithinPartitions("term", "doc"))
    scratch.drop(rows)
    sizes = scratch.put(lengths(postings))
    r = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    return Index(postings, sizes, (r["n"], r["mean"] or 1.0))


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]  # one word, or a phrase
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Near:
    terms: tuple[Term, ...]
    distance: int


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple


class QueryError(ValueError):
    pass


_TOK = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*?)|(\()|(\))|(,)|([^\s()",:]+)(:?))')


class _Parser:
    def __init__(self, text: str):
        self.t, at = [], 0
        while text[at:].strip():
            m = _TOK.match(text, at)
            if not m:
                raise QueryError(f"cannot read the query at {text[at:at + 20]!r}")
            phrase, star, opening, closing, comma, word, colon = m.groups()
            if phrase is not None:
                self.t.append(("phrase", phrase.replace('""', '"'), bool(star)))
            elif opening or closing or comma:
                self.t.append((opening or closing or comma, "", False))
            elif colon:
                self.t.append(("column", word, False))
            elif word in ("AND", "OR", "NOT"):
                self.t.append((word, "", False))
            elif word == "NEAR" and text[m.end() : m.end() + 1] == "(":
                self.t.append(("NEAR", "", False))
            else:
                self.t.append(("word", word, False))
            at = m.end()
        self.i = 0

    def kind(self) -> str | None:
        return self.t[self.i][0] if self.i < len(self.t) else None

    def parse(self):
        e = self.either()
        if self.kind() is not None:
            raise QueryError(f"unexpected {self.kind()}")
        return e

    def either(self):
        parts = [self.all()]
        while self.kind() == "OR":
            self.i += 1
            parts.append(self.all())
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts))

    def all(self):
        parts = [self.without()]
        while self.kind() not in (None, "OR", ")", ","):
            if self.kind() == "AND":
                self.i += 1
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def without(self):
        e = self.atom(None)
        while self.kind() == "NOT":
            self.i += 1
            e = Op("not", (e, self.atom(None)))
        return e

    def atom(self, column: str | None):
        if self.i >= len(self.t):
            raise QueryError("the query ends too early")
        kind, value, star = self.t[self.i]
        self.i += 1
        if kind == "(":
            e = self.either()
            if self.kind() != ")":
                raise QueryError("missing )")
            self.i += 1
            return e
        if kind == "column":
            return self.atom(value)
        if kind == "NEAR":
            self.i += 1
            terms, distance = [], 10
            while self.kind() not in (")", ",", None):
                terms.append(self.atom(column))
            if self.kind() == ",":
                self.i += 1
                distance = int(self.t[self.i][1])
                self.i += 1
            if self.kind() != ")":
                raise QueryError("missing )")
            self.i += 1
            return Near(tuple(terms), distance)
        if kind in ("word", "phrase"):
            star = star or (kind == "word" and value.endswith("*"))
            words = tuple(tokens_of(value))
            if not words:
                raise QueryError(f"no word in {value!r}")
            return Term(words, star, column)
        raise QueryError(f"unexpected {kind}")


def parse_query(text: str):
    return _Parser(text).parse()


def within(old: str | None, new: str) -> str:
    return f"({old}) AND ({new})" if old else new


def _terms(e) -> list[Term]:
    """Terms that count for the score, in order; those behind NOT do not."""
    if isinstance(e, Term):
        return [e]
    if isinstance(e, Near):
        return list(e.terms)
    return _terms(e.parts[0]) if e.kind == "not" else [t for p in e.parts for t in _terms(p)]


def occurrences(postings: DataFrame, t: Term) -> DataFrame:
    """(doc, column, positions) where a word, prefix or phrase begins."""
    p = postings if t.column is None else postings.where(F.col("column") == t.column)
    *front, last = t.words
    match = lambda w, star: p.where(F.col("term").startswith(w) if star else F.col("term") == w)
    if not front:
        got = match(last, t.prefix)
        return got.groupBy("doc", "column").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")) if t.prefix else got.select("doc", "column", "positions")
    got = None
    for k, w in enumerate(t.words):
        star = t.prefix and k == len(t.words) - 1
        here = match(w, star)
        if star:
            here = here.groupBy("doc", "column").agg(F.flatten(F.collect_list("positions")).alias("positions"))
        shifted = here.select("doc", "column", F.expr(f"transform(positions, x -> x - {k})").alias(f"p{k}"))
        got = shifted.withColumnRenamed("p0", "positions") if got is None else got.join(shifted, ["doc", "column"]).withColumn("positions", F.array_intersect("positions", f"p{k}")).drop(f"p{k}")
    return got.where(F.size("positions") > 0)


def matches(postings: DataFrame | Index, e) -> DataFrame:
    """(doc) of the documents a query selects."""
    if isinstance(postings, Index):
        postings = postings.postings
    if isinstance(e, Term):
        return occurrences(postings, e).select("doc").distinct()
    if isinstance(e, Near):
        got = None
        for k, t in enumerate(e.terms):
            o = occurrences(postings, t).select("doc", "column", F.explode("positions").alias(f"p{k}"))
            if got is None:
                got = o.withColumn("low", F.col("p0")).withColumn("high", F.col("p0") + len(t.words) - 1)
            else:
                got = got.join(o, ["doc", "column"]).withColumn("low", F.least("low", f"p{k}")).withColumn("high", F.greatest("high", F.col(f"p{k}") + len(t.words) - 1))
                got = got.where(F.col("high") - F.col("low") + 1 <= sum(len(x.words) for x in e.terms[: k + 1]) + e.distance)
        return got.select("doc").distinct()
    sets = [matches(postings, p) for p in e.parts]
    if e.kind == "or":
        return reduce(lambda a, b: a.unionByName(b), sets).distinct()
    if e.kind == "not":
        return sets[0].join(sets[1], "doc", "left_anti")
    return reduce(lambda a, b: a.join(b, "doc", "left_semi"), sets)


def rank(source: DataFrame | Index, query: str) -> DataFrame:
    """(doc, score) of the documents a query selects, unordered, from a written index or from postings (whose lengths are counted then)."""
    e = parse_query(query)
    if isinstance(source, Index):
        postings, size, (n_docs, mean) = source.postings, source.sizes, source.statistics
    else:
        postings, size = source, lengths(source)
        r = size.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
        n_docs, mean = r["n"], r["mean"] or 1.0
    ids = matches(postings, e)
    parts = []
    for k, t in enumerate(_terms(e)):
        tf = occurrences(postings, t).groupBy("doc").agg(F.sum(F.size("positions")).alias("f"))
        parts.append(tf.withColumn("k", F.lit(k)))
    tf = reduce(lambda a, b: a.unionByName(b), parts)
    df = tf.groupBy("k").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    # the number of query terms bounds the rows of df
    scored = tf.join(ids, "doc", "left_semi").join(df, "k").join(size, "doc")
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / mean))
    return scored.groupBy("doc").agg((-F.sum(part)).alias("score"))


def search_documents(meta: DataFrame | Index, chunk_postings: DataFrame | Index, chunk_docs: DataFrame, query: str) -> DataFrame:
    """(doc, score): the better of a document's own fields and its best chunk."""
    a = rank(meta, query)
    b = rank(chunk_postings, query).join(chunk_docs.select(F.col("chunk").alias("doc"), "document_id"), "doc").select(F.col("document_id").alias("doc"), "score")
    return a.unionByName(b).groupBy("doc").agg(F.min("score").alias("score"))


def snippet(text, word: str, width: int = 80):
    """The text around the first occurrence of a word, its beginning without one."""
    t = F.regexp_replace(text, r"\s+", " ")
    at = F.instr(F.lower(t), word.lower())
    return F.substring(t, F.greatest(at - F.lit(width // 2), F.lit(1)), F.lit(width))
