"""Variant spellings of names, by a noisy channel.

A typed name is read into a family (or firm) part, a given (or trade) part, a middle initial and how the given part was written. The
frequent given parts of the whole collection are the candidates for the given part: exact, short form, abbreviation, or one typing
error away, weighed by frequency. Short forms are learned: a given part that stands with another, more frequent one under the same family
part of a scope far more often than chance brings them together is a short form of it (``short_forms``); no list of nicknames is used.

Family parts are compared within one scope and given part, through the one-deletion neighbourhood of the spelling: each spelling is
attached to the spelling with the largest posterior, its frequency times the likelihood of the error, against the probability that a
new name of that length lies so close to a known one. Given parts that are no candidates are compared likewise under one family part, and a
name in the other order of its parts is attached to the more frequent order. An initial is attached to the most probable full name
with that initial. Attached spellings form one entity; the least identifier of it is its name.

Defined results: a null or blank spelling is replaced by normalized_full_name, where the rows have it; a name without either (and one that
is only a title or punctuation) names nobody and gets no row; a null scope is no scope and gives no row; equal spellings of one scope
always name the same one; ties go to the alphabetically first spelling.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebolt.common import Scratch
from casebolt.llm.groups import contract, pairs_within

# Words around a name that are no part of it.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "herr", "frau", "hr", "fr", "sr", "sra", "mme", "mlle", "mag", "ing"}
SUFFIXES = {"esq", "jr", "sr", "phd", "md", "ii", "iii", "iv", "cpa", "jd"}
LEGAL = {
    "inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "ag", "kg", "sa", "sarl", "sas",
    "plc", "bv", "nv", "srl", "sl", "ab", "oy",
}

#: A given part is a candidate for all scopes from this share of all names on, so there are at most 1 / share of them.
COMMON_SHARE, COMMON_LEAST = 5e-4, 8
#: A short form stands with its full form in so many families and in this part of its own, so many times oftener than by chance, and is so
#: much rarer.
SHORT_LEAST, SHORT_PART, SHORT_LIFT, SHORT_RARER = 3, 0.3, 5.0, 1.5
#: Probability that a typed name holds one error, and the least that a new name lies so close to a known one of the scope.
P_ERROR, P_NEW = 0.08, 1e-4
#: Part of an explained spelling's frequency that supports its origin.
EXPLAINED = 0.3


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.casefold())
    return "".join(c for c in s if not unicodedata.combining(c)).replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("đ", "d")


_DOTTED = re.compile(r"\b(?:[A-Za-z]\.){2,}")


def read_name(text: str | None) -> tuple[list[str], int, bool] | None:
    """(words, how many of them stand before a comma, organisation). Words keep a final full stop if they had one; hyphens stay inside words."""
    if text is None:
        return None
    t = re.sub(r"<[^>]*>|\[[^\]]*\]", " ", text).strip().strip("\"'")
    bracketed = [fold(re.sub(r"[^\w]", "", x)) for x in re.findall(r"\(([^()]*)\)", t)]
    t = re.sub(r"\([^()]*\)", " ", t)
    # L.L.C. is one word, T.Ternes two
    t = _DOTTED.sub(lambda m: m[0].replace(".", "") + " " if fold(m[0].replace(".", "")) in LEGAL else m[0], t)
    t = re.sub(r"\b([^\W\d_])\.(?=[^\W\d_]{2})", r"\1. ", t)
    organisation = any(b in LEGAL for b in bracketed)
    parts = [re.findall(r"[^\W_](?:[^\W_]|[-'’]+(?=[^\W_]))*\.?", p) for p in t.split(",")]
    parts = [[fold(w) for w in p] for p in parts]
    parts = [p for p in parts if p]
    while len(parts) > 1 and all(w.strip(".") in SUFFIXES | LEGAL for w in parts[-1]):
        organisation |= any(w.strip(".") in LEGAL for w in parts[-1])
        parts.pop()
    comma = len(parts[0]) if len(parts) > 1 else 0
    words = [w for p in parts for w in p]
    if len(words) > 1 and words[0] == "the":
        words, organisation, comma = words[1:], True, max(0, comma - 1)
    while len(words) > 1 and words[-1].strip(".") in LEGAL:
        words, organisation = words[:-1], True
    while len(words) > 1 and words[0].strip(".") in TITLES:
        words, comma = words[1:], max(0, comma - 1)
    while len(words) > 2 and words[-1].strip(".") in SUFFIXES:
        words = words[:-1]
    words = [w for w in words if w.strip(".")]
    return (words, comma, organisation) if words and not (len(words) == 1 and words[0].strip(".") in TITLES) else None


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def deletions(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


class Channel:
    """Reads names with the collection's common given parts (word -> count) and their short forms (word -> full form)."""

    def __init__(self, common: dict[str, int], short: dict[str, str] | None = None):
        self.common, self.short = common, short or {}
        self.by_key: dict[str, set[str]] = {}
        for w in common:
            if len(w) > 3:
                for k in deletions(w):
                    self.by_key.setdefault(k, set()).add(w)
        self.given = functools.lru_cache(200_000)(self._given)

    def _formal(self, w: str) -> str:
        return self.short.get(w, w)

    def _given(self, w: str) -> tuple[str, str]:
        """(full form, how it was written) of a given part."""
        bare = w.strip(".")
        if len(bare) == 1:
            return bare, "initial"
        if bare in self.common:
            full = self._formal(bare)
            return full, "exact" if full == bare else "nickname"
        if w.endswith(".") or len(bare) <= 4:
            full = [c for c in self.common if c.startswith(bare) and len(c) > len(bare)] if len(bare) > 2 else []
            if full:
                return self._formal(max(full, key=lambda c: (self.common[c], c))), "short"
        close = {c for k in deletions(bare) for c in self.by_key.get(k, ()) if near(c, bare)} if len(bare) > 2 else set()
        if close:
            return self._formal(max(close, key=lambda c: (self.common[c], c))), "error"
        return bare, "rare"

    def read(self, text: str | None) -> tuple[str, str, str, str] | None:
        """(family, given, how, middle) of a typed name."""
        got = read_name(text)
        if got is None:
            return None
        words, comma, organisation = got
        if len(words) == 1 and "-" in words[0] and self._given(words[0].rsplit("-", 1)[1])[1] in ("exact", "error"):
            words = words[0].rsplit("-", 1)
        if len(words) == 1:
            return words[0].strip("."), "", "none", ""
        if comma and comma < len(words):
            family, rest = words[:comma], words[comma:]
        else:
            weight = lambda w: self.common.get(w.strip("."), 0)
            how_first, how_last = self.given(words[0])[1], self.given(words[-1])[1]
            sure = ("exact", "nickname", "initial")
            swapped = how_last in sure and how_first not in sure or (organisation or how_last == "short") and how_first == "rare" or how_last == "error" and how_first == "rare"
            if how_first in sure and how_last in sure and len(words) == 2:
                swapped = weight(words[-1]) > 50 * max(1, weight(words[0]))
            family, rest = (words[:1], words[1:]) if swapped else (words[-1:], words[:-1])
            # a family part written as two words: what follows the given part and is neither initial nor given name
            while not swapped and len(rest) > 1 and len(rest[-1].strip(".")) > 1 and self.given(rest[-1])[1] == "rare":
                family, rest = [rest[-1], *family], rest[:-1]
        given, how = self.given(rest[0])
        middle = "".join(w[0] for w in rest[1:])
        return re.sub(r"[^\w]", "", "".join(family)), given, how, middle


def _words(batches):
    for b in batches:
        given: dict[str, int] = {}
        family: dict[str, int] = {}
        for t in b.column(0).to_pylist():
            got = read_name(t)
            if got and len(got[0]) > 1:
                words, comma, organisation = got
                # the given part follows the comma, the trade of a firm ends its name, else the given part comes first
                w = (words[comma] if comma < len(words) else "") if comma else words[-1 if organisation else 0]
                if len(w := w.strip(".")) > 1:
                    given[w] = given.get(w, 0) + 1
                if comma:
                    w = words[0].strip(".")
                    family[w] = family.get(w, 0) + 1
        every = list({**given, **family})
        yield pa.record_batch([pa.array(every, pa.string()), pa.array([given.get(w, 0) for w in every], pa.int64()), pa.array([family.get(w, 0) for w in every], pa.int64())], names=["word", "n", "f"])


def common_given(names: DataFrame, share: float = COMMON_SHARE, least: int = COMMON_LEAST) -> dict[str, int]:
    """The given parts that make up at least ``share`` of all names (at least ``least`` of them): at most 1 / share words."""
    total = names.count()
    counts = names.select("display_value").mapInArrow(_words, "word string, n long, f long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    floor = max(least, share * total)
    return {r["word"]: r["n"] for r in counts.where((F.col("n") >= floor) & (F.col("n") > 2 * F.col("f"))).collect()}


def short_forms(names: DataFrame, common: dict[str, int], scratch: Scratch) -> dict[str, str]:
    """short -> full form, of the common given parts. For each two of them: in how many (scope, family) both stand, against how many that
    would be by chance. At most as many rows as common parts come to the driver; a family of any size holds at most that many."""
    if not common:
        return {}
    read = scratch.put(names.mapInArrow(_read(common, {}), READ).where("how = 'exact' and given <> '' and family <> ''").select("scope", "family", "given").distinct())
    n = read.groupBy("given").agg(F.count("*").alias("n"))
    total = read.select("scope", "family").distinct().count()
    both = read.join(read.withColumnRenamed("given", "other"), ["scope", "family"]).where("given <> other").groupBy("given", "other").agg(F.count("*").alias("both"))
    both = both.join(n, "given").join(n.select(F.col("given").alias("other"), F.col("n").alias("n_other")), "other")
    lift = F.col("both") * total / (F.col("n") * F.col("n_other"))
    kept = both.where((F.col("both") >= SHORT_LEAST) & (F.col("both") >= SHORT_PART * F.col("n")) & (lift >= SHORT_LIFT) & (F.col("n_other") > SHORT_RARER * F.col("n")))
    best = kept.groupBy("given").agg(F.max_by("other", F.struct(F.col("both") / F.col("n"), "other")).alias("full")).collect()
    to = {r["given"]: r["full"] for r in best}
    # a form that is itself short stands for what that one stands for
    ends = {}
    for w in to:
        full, seen = to[w], {w}
        while full in to and full not in seen:
            seen.add(full)
            full = to[full]
        ends[w] = full
    return {w: f for w, f in ends.items() if w != f}


READ = "identifier_id long, scope string, family string, given string, how string, middle string"


def _read(common: dict[str, int], short: dict[str, str]):
    def run(batches):
        ch = Channel(common, short)
        for b in batches:
            got = [ch.read(t) for t in b.column(2).to_pylist()]
            keep = pa.array([g is not None for g in got])
            cols = [pa.array([g[i] for g in got if g is not None], pa.string()) for i in range(4)]
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep), *cols], names=["identifier_id", "scope", "family", "given", "how", "middle"])

    return run


def _deletion_keys(batches):
    for b in batches:
        node, scope, given, family, n, key = ([] for _ in range(6))
        for v, s, g, f, c in zip(*(x.to_pylist() for x in b.columns)):
            for k in sorted(deletions(f)) if len(f) > 1 else [f]:
                for col, x in zip((node, scope, given, family, n, key), (v, s, g, f, c, k)):
                    col.append(x)
        yield pa.record_batch([pa.array(node, pa.int64()), pa.array(scope, pa.string()), pa.array(given, pa.string()), pa.array(family, pa.string()), pa.array(n, pa.float64()), pa.array(key, pa.string())], names=["node", "scope", "given", "family", "n", "key"])


def _chance(word, errors):
    """Probability that a new name of the length of ``word`` lies within so many errors of a given one: its neighbours among all words, at
    least P_NEW."""
    n = F.length(word)
    return F.greatest(F.lit(P_NEW), F.pow(52 * n, errors) / F.pow(F.lit(26.0), n))


def _attached(met: DataFrame) -> DataFrame:
    """(a, b): each spelling a with the spelling b of largest posterior, from pairs (a, fa, na, b, fb, nb, errors) in both orders."""
    # a spelling's frequency is its own and part of that of the spellings it explains with one error
    explains = met.where("errors = 1").groupBy(F.col("b").alias("node")).agg((F.sum("na") * EXPLAINED).alias("more"))
    support = lambda df, v, out: df.join(explains.select(F.col("node").alias(v), "more"), v, "left").withColumn(out, F.col("n" + v) + F.coalesce("more", F.lit(0.0))).drop("more")
    ranked = support(support(met, "a", "sa"), "b", "sb").where("sb > sa or (sb = sa and fb < fa)")
    posterior = F.col("sb") * F.pow(F.lit(P_ERROR), F.col("errors")) / F.length("fb")
    return ranked.withColumn("p", posterior).where(F.col("p") > _chance("fa", F.col("errors")) * F.col("na")).groupBy("a").agg(F.max_by("b", F.struct("p", F.col("fb"))).alias("b"))


def _keyed(nodes: DataFrame, fixed: str, word: str) -> DataFrame:
    """(node, scope, fixed, word, n, key) for every one-deletion key of ``word``."""
    return nodes.select("node", "scope", F.col(fixed).alias("given"), F.col(word).alias("family"), "n").mapInArrow(_deletion_keys, "node long, scope string, given string, family string, n double, key string")


def _met(keyed: DataFrame) -> DataFrame:
    side = lambda v: keyed.select("scope", "given", "key", F.col("node").alias(v), F.col("family").alias("f" + v), F.col("n").alias("n" + v))
    met = side("a").join(side("b"), ["scope", "given", "key"]).where("a <> b").dropDuplicates(["a", "b"])
    return met.withColumn("errors", _distance_udf()("fa", "fb"))


def entities(identifiers: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """identifier_id, provider_scope, entity_name_id, family, given, how: one row per name row that names someone.

    entity_name_id is the least identifier_id of the rows that name the same person or organisation of the scope."""
    spark = identifiers.sparkSession
    scratch = scratch or Scratch(spark, "names")
    shown = F.when(F.trim("display_value") != "", F.col("display_value"))
    if "normalized_full_name" in identifiers.columns:
        shown = F.coalesce(shown, F.col("normalized_full_name"))
    names = identifiers.where(F.lower(F.trim(F.regexp_replace("identifier_type", r"[\s ]+", " "))) == "name").where("provider_scope is not null")
    names = names.select("identifier_id", F.col("provider_scope").alias("scope"), shown.alias("display_value")).where("display_value is not null")
    common = common_given(names)
    read = scratch.put(names.mapInArrow(_read(common, short_forms(names, common, scratch)), READ)).withColumn("node", F.xxhash64("scope", "family", "given"))
    # spellings without an error count in full, others little
    weight = F.when(F.col("how").isin("exact", "nickname", "short", "rare"), 1.0).otherwise(0.2)
    full = read.where("how <> 'initial'").groupBy("node", "scope", "given", "family").agg(F.sum(weight).alias("n"), F.max(F.col("how") == "rare").alias("rare"))
    # 1. family parts of one scope and given part
    keyed = scratch.put(_keyed(full, "given", "family"))
    edges = _attached(scratch.put(_met(keyed)))
    # 2. given parts that are no candidates, of one scope and family part; and names in the other order of such parts
    rare = full.where("rare and given <> ''")
    edges = edges.unionByName(_attached(scratch.put(_met(_keyed(rare, "family", "given")))))
    turned = rare.select("scope", F.col("given").alias("family"), F.regexp_replace("family", r"[^\w]", "").alias("given"), F.col("node").alias("a"), F.col("n").alias("na"))
    there = full.select("scope", "family", F.regexp_replace("given", r"[^\w]", "").alias("given"), F.col("node").alias("b"), F.col("n").alias("nb"))
    edges = edges.unionByName(turned.join(there, ["scope", "family", "given"]).where("nb > na or (nb = na and b < a)").select("a", "b"))
    # 3. initials: the most probable full name of the scope with that initial and the family, at most one error away
    short = read.where("how = 'initial'").groupBy("node", "scope", "given", "family").agg(F.count("*").cast("double").alias("n"))
    skey = _keyed(short, "given", "family").select("scope", F.col("given").alias("initial"), "key", F.col("node").alias("a"), F.col("family").alias("fa"))
    cand = keyed.where("given <> ''").select("scope", F.substring("given", 1, 1).alias("initial"), "key", F.col("node").alias("b"), F.col("family").alias("fb"), F.col("given").alias("gb"), F.col("n").alias("nb"))
    met = skey.join(cand, ["scope", "initial", "key"]).dropDuplicates(["a", "b"]).withColumn("errors", _distance_udf()("fa", "fb")).where("errors <= 1")
    likely = F.col("nb") * F.pow(F.lit(P_ERROR), F.col("errors"))
    near_enough = (F.col("errors") == 0) | (F.lit(P_ERROR) / F.length("fb") * F.col("nb") > _chance("fa", F.lit(1)))
    edges = edges.unionByName(met.where(near_enough).groupBy("a").agg(F.max_by("b", F.struct(likely, "gb", "fb")).alias("b")))
    roots = contract(edges, scratch)
    named = read.join(roots.select(F.col("v").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("scope", "root").agg(F.min("identifier_id").alias("entity_name_id"))
    return named.join(least, ["scope", "root"]).select("identifier_id", F.col("scope").alias("provider_scope"), "entity_name_id", "family", "given", "how")


def _distance_udf():
    @F.pandas_udf("int")
    def errors(a, b):
        import pandas as pd

        # candidates share a one-deletion neighbour, so whatever is not one error apart is two
        return pd.Series([0 if x == y else 1 if near(x, y) else 2 for x, y in zip(a, b)], dtype="int32")

    return errors


def found(identifiers: DataFrame) -> DataFrame:
    """left_identifier_id, right_identifier_id of all pairs of one entity: the case list asks for every pair."""
    scratch = Scratch(identifiers.sparkSession, "names")
    e = scratch.put(entities(identifiers, scratch).select("provider_scope", "entity_name_id", "identifier_id"))
    return pairs_within(e, ["provider_scope", "entity_name_id"], "identifier_id", "left_identifier_id", "right_identifier_id").select("left_identifier_id", "right_identifier_id")
