"""Texts cut off by a field limit or in transfer.

1. Near-copies: the heads of every text, of 12, 24, 48, ... words, are signed with min-hashes of their five-word shingles in bands. A cut text
   looks with the longest of its heads for longer texts: a text and the copy it was cut from agree in that head however early the cut
   came. A pair in SHARED bands that shares at least 0.8 of the text's shingles is verified and aligned at the text's last words: where the copy goes
   on in the same word or sentence, the text ends early. Equal texts are one candidate. All longer texts are tried, in rounds over parts of
   them, the first about PART texts of the largest band. Only a copy that goes on in the same word ends the search, since no other
   copy can change that result; so none depends on the order of the parts.
2. Field limits show as lengths at which several unlike texts of one source end without a sentence end, many more than at the lengths
   around (SPIKE times their mean), so ordinary lengths do not pass however many rows there are.
3. The rest is scored by the terminality of its closing: how its last line is closed, and how often, over all texts, the closing word
   ends a sentence or a line at all its occurrences. A word that never occurs in full elsewhere has none.

A text that ends in a full stop is cut only where a copy goes on in lower case, or goes on at all behind a short word that nearly
always has a stop (an abbreviation).

Defined results: null, empty and blank texts are no case, nor are texts that end with a full sentence, a list entry, a name, a
reference, a figure, an address or another closing form; a text under MIN_WORDS words is judged by its marks and its last word only.
Equal texts get equal results. Texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebolt.common import Scratch
from casebolt.llm.neardup import Shingler, _mix, only

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
#: Words of the shortest signed head and the growth from head to head; longer texts of a band in one part.
HEAD, GROWTH, PART = 12, 2.0, 64
#: Bands that a pair shares to be aligned: at a similarity of the heads of 0.8 it shares so many with a probability of 0.998, of 0.7 with 0.95.
SHARED = 2
MIN_WORDS = 6
#: Open closings of at most this terminality are cut: a full sentence without its stop is rare.
OPEN_AT_MOST = 0.9
#: A length is a limit of a source from so many different endings on. Trailing blanks lost in transfer make one character less.
#: It has at least SPIKE times the endings of the lengths up to AROUND characters away.
LIMIT_LEAST, SPIKE, AROUND = 3, 10, 50
#: Letters and terminality of a word with a stop that is taken for an abbreviation.
SHORT_WORD, ABBREVIATION = 4, 0.8
#: Occurrences that make a closing word a known one.
KNOWN_WORD = 4

_U = np.uint64
_END = re.compile(r"[.!?。！？](?:[\"'»”’)\]*_]|\s)*$")
_DOTS = re.compile(r"\.\.\.\s*$")
_MARK = re.compile(r"(?:…|\[\s*(?:\.\.\.|…|truncated|cut|more)\s*\]|\((?:truncated|cut off|continued)\)|<(?:truncated|snip)>|\ufffd)\s*$", re.I)
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_REF = r"[A-Z]{2,5}-?\d{2,}"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_NAME = rf"{_CAP}(?: (?:{_CAP}|de|von|van|der|la)){{1,3}}"
#: Closing forms without a full stop: whole last lines.
_CLOSERS = [
    re.compile(p)
    for p in (
        rf"^\W*(?:{_CAP} )?{_REF}\W*$",  # a reference, alone or after one word
        r"^[^\W\d_][\w ]{1,24}: ?[\d.,' ]*\d(?: ?(?:%|[A-Z€$£]{1,3}))?$",  # a figure with its label
        r"^(?:[-*•–]|\d{1,3}[.)]|[a-z][.)]) [\w'-]+(?: [\w'-]+)? " + _REF + "$",  # a list entry
        r"^\S*(?:https?://|www\.)\S+$|^<?\S+@\S+\.\w+>?$",  # an address
        r"^[(\[*].*[)\]*]$",  # bracketed or starred
        rf"^(?:[^\W\d_]{{1,12}}\.?: |\[\w+\] |/s/ |gez\. )?{_NAME}$",  # a name, signed or copied to
        rf"^{_NAME} \| {_CAP}(?: (?:of|de|für|and|und|et|y|{_CAP})){{0,4}}$",  # name and title
        r"^.*[:;8][-^]?[)(DP]$",  # a smiley
        r"^[^\W\d_]/[^\W\d_]$",
        rf"^{_CAP},$|^(?:{_CAP} )?(?:regards|wishes|thanks),?$",
    )
]
_LOG_ROW = re.compile(rf"^\W*{_REF} \| |^\[?\d{{4}}-\d\d-\d\d[ T]\d\d:\d\d")


def closing(text: str) -> tuple[str, str, str]:
    """(form, closing word, last line): form is 'mark', 'dots', 'sentence', 'closer' or 'open'."""
    t = text.rstrip()
    lines = re.split(r"[\r\n\u2028\u2029]+", t)
    last = lines[-1].strip()
    words = _WORD.findall(last)
    word = words[-1].lower() if words else ""
    if _MARK.search(t):
        return "mark", word, last
    if _DOTS.search(t):
        return "dots", word, last
    if _END.search(t) or re.search(r"[.!?]\s+(?:\([^()]{1,40}\)|[:;8][-^]?[)(DP])$", t):
        return "sentence", word, last
    # a row of a table or log whose further cells are missing is no closing form
    row = _LOG_ROW.match(last) or (len(lines) > 1 and _LOG_ROW.match(lines[-2].strip()) and re.match(rf"^{_REF}$|^{_REF} \|?\s*$", last))
    if not row and any(p.match(last) for p in _CLOSERS):
        return "closer", word, last
    return "open", word, last


def ends_early(text: str, copy: str) -> str:
    """How the text ends against a longer copy: 'word' or 'sentence' where the copy goes on; 'stop' and 'stop, new' where the text ends in
    a full stop and the copy goes on in the same line with a small letter, or with anything else; '' where it does not go on or no
    alignment is found."""
    a, b = text.rstrip().rstrip("\ufffd…"), copy
    wa, pb = re.findall(r"\S+", a), [(m.start(), m.end()) for m in re.finditer(r"\S+", b)]
    wb = [b[s:e] for s, e in pb]
    if len(wa) < 4:
        return ""
    tail = wa[-1]
    for k in (6, 4, 3):
        before = wa[-1 - k : -1]
        if len(before) < k:
            continue
        hits = [i for i in range(len(wb) - k) if wb[i] == before[0] and wb[i : i + k] == before]
        for i in sorted(hits, key=lambda i: abs(i - (len(wa) - 1 - k))):
            nxt = wb[i + k]
            if nxt != tail and nxt.startswith(tail):
                # only punctuation more: the same word, closed in the copy
                return "word" if any(c.isalnum() for c in nxt[len(tail) :]) else "sentence" if nxt[len(tail) :][:1] in ".!?" and i + k + 1 >= len(wb) else ""
            if nxt == tail and i + k + 1 < len(wb):
                gap, then = b[pb[i + k][1] : pb[i + k + 1][0]], wb[i + k + 1]
                if "\n" in gap or "\r" in gap:
                    return ""
                return ("stop" if then[0].islower() else "stop, new") if _END.search(tail) else "sentence"
    return ""


def head_sizes(words_: int) -> list[int]:
    """Words of the signed heads of a text: HEAD, growing by GROWTH."""
    out, n = [], float(HEAD)
    while int(n) <= words_:
        out.append(int(n))
        n *= GROWTH
    return out


def head_bands(ordered: list[np.ndarray | None]) -> list[list[int]]:
    """BANDS keys of every signed head of each text, given by its shingles in order, the shortest head first. A text under HEAD words has none."""
    ends = [[n - SHINGLE + 1 for n in head_sizes(len(o) + SHINGLE - 1)] if o is not None else [] for o in ordered]
    levels = np.array([len(e) for e in ends], np.int64)
    if not levels.any():
        return [[] for _ in ordered]
    tok = np.concatenate([o[: e[-1]] for o, e in zip(ordered, ends) if e])
    begins, sizes, at = [], [], 0
    for e in ends:
        if e:
            begins += [at, *(at + x for x in e[:-1])]
            sizes += e
            at += e[-1]
    begins, sizes, level = np.array(begins), np.array(sizes, _U), np.concatenate([np.arange(n) for n in levels])
    key = np.zeros((len(begins), BANDS), _U)
    deeper = [np.flatnonzero(level == k) for k in range(1, int(levels.max()))]
    with np.errstate(over="ignore"):
        low, high = tok.astype(np.uint32), (tok >> _U(32)).astype(np.uint32)
        for j in range(BANDS * ROWS):
            # the least of each part between two heads, then of each head
            least = np.minimum.reduceat((low * np.uint32(_FACTORS[j] & _U(0xFFFFFFFF)) ^ high) * np.uint32(_FACTORS[-1 - j] >> _U(32) | _U(1)), begins)
            for part in deeper:
                least[part] = np.minimum(least[part], least[part - 1])
            key[:, j // ROWS] = key[:, j // ROWS] * _U(0x9E3779B97F4A7C15) + least
        # a head meets heads of its own length and band only
        key = _mix(key + (sizes << _U(8))[:, None] + np.arange(BANDS, dtype=_U)[None, :])
    rows, out, at = key.view(np.int64), [], 0
    for n in levels.tolist():
        out.append(rows[at : at + n].ravel().tolist())
        at += n
    return out


_FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _features(batches):
    shingle = Shingler(SHINGLE, MIN_WORDS)
    for b in batches:
        rows, ordered = [], []
        for i, t, source in zip(*(c.to_pylist() for c in b.columns)):
            if t is None or not t.strip():
                continue
            form, word, last = closing(t)
            ordered.append(shingle.ordered(t))
            rows.append((i, form, word, _hash(last), _hash(t), len(t), source))
        bands, held = [], 0
        for k, o in enumerate(ordered):
            held += 0 if o is None else len(o)
            if held > 300_000 or k + 1 == len(ordered):
                bands += head_bands(ordered[len(bands) : k + 1])
                held = 0
        cols = [*(list(zip(*rows)) or [()] * 7)]
        cols.insert(6, bands)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "form", "word", "ending", "same", "size", "bands", "source"])


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _word_ends(batches):
    """word, times it ends a sentence or a line, times it occurs; counted per batch."""
    token = re.compile(r"([^\W_]+(?:[-'’][^\W_]+)*)([.!?:;)\"”»’]*(?=\s*[\r\n]|\s*\Z)|[.!?])?")
    for b in batches:
        ends: dict[str, int] = {}
        all_: dict[str, int] = {}
        for t in b.column(0).to_pylist():
            if t:
                # the last word of a text says nothing about itself
                found = token.findall(t.lower())
                for w, e in found[:-1]:
                    all_[w] = all_.get(w, 0) + 1
                    if e:
                        ends[w] = ends.get(w, 0) + 1
        yield pa.record_batch([pa.array(list(all_), pa.string()), pa.array([ends.get(w, 0) for w in all_], pa.int64()), pa.array(list(all_.values()), pa.int64())], names=["word", "ends", "n"])


def _align(batches):
    shingle = Shingler(SHINGLE, MIN_WORDS)
    for b in batches:
        ids, how = [], []
        for q, t, c in zip(*(x.to_pylist() for x in b.columns)):
            x, y = shingle(t), shingle(c)
            if x is None or y is None:
                continue
            if np.isin(x, y, assume_unique=True).sum() >= SIMILARITY * len(x):
                ids.append(q)
                how.append(ends_early(t, c))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(how, pa.string())], names=["same", "how"])


def aligned(feats: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """same, copies of the texts, by hash, with a verified longer copy: the different results of ends_early against all of them, or of some
    of them with 'word', which decides by itself."""
    spark = feats.sparkSession
    # equal texts are one, under the least id
    ones = feats.where("size(bands) > 0").groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    one = scratch.put(feats.select("doc_id", "size", "bands", "same").join(ones, ["same", "doc_id"], "left_semi"))
    keys = one.select("doc_id", "size", F.explode("bands").alias("band"))
    last = F.slice("bands", F.size("bands") - BANDS + 1, F.lit(BANDS))
    # bands in which some text can find a longer one
    sizes = keys.groupBy("band").agg(F.count("*").alias("n"), F.max("size").alias("longest")).where("n > 1")
    asked = scratch.put(one.select("same", "doc_id", "size", F.explode(last).alias("band")).join(sizes, "band").where("longest > size").select("same", "doc_id", "size", "band", "n"))
    most = asked.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], "same long, copies array<string>")
    wanted = scratch.put(asked.select("band").distinct())
    keys = scratch.put(only(keys, wanted, "left_semi", "band").select("band", F.col("doc_id").alias("copy_id"), F.col("size").alias("copy_size"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)).alias("place")))
    done, low, high = [], 0.0, min(1.0, PART / most)
    while True:
        part = keys.where((F.col("place") >= low) & (F.col("place") < high)).drop("place")
        pairs = asked.join(part, "band").where("copy_size > size").groupBy("same", "doc_id", "copy_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= SHARED)
        pairs = scratch.put(pairs.select("same", "doc_id", "copy_id"))
        ids = scratch.put(pairs.select(F.explode(F.array("doc_id", "copy_id")).alias("doc_id")).distinct())
        some = scratch.put(only(texts, ids, "left_semi", "doc_id"))
        both = pairs.join(some, "doc_id").join(some.select(F.col("doc_id").alias("copy_id"), F.col("text").alias("copy")), "copy_id")
        got = both.select("same", "text", "copy").mapInArrow(_align, "same long, how string")
        done.append(scratch.put(got.distinct()))
        scratch.drop(pairs, ids, some)
        if high >= 1.0:
            break
        low, high = high, min(1.0, high * 8)
        # the others go on with those whose result may still change
        asked = scratch.put(asked.join(done[-1].where("how = 'word'").select("same"), "same", "left_anti"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.groupBy("same").agg(F.collect_set("how").alias("copies"))


def field_limits(endings: DataFrame) -> DataFrame:
    """source, size, exact (false one character below a limit) from (source, size, ending) of texts that end open."""
    k = endings.where("source is not null").groupBy("source", "size").agg(F.countDistinct("ending").alias("k"))
    # one row per length of a source: the lengths around it are summed over a bounded range
    around = F.sum("k").over(W.partitionBy("source").orderBy("size").rangeBetween(-AROUND, AROUND)) - F.col("k")
    limits = k.withColumn("expected", around / (2 * AROUND)).where((F.col("k") >= LIMIT_LEAST) & (F.col("k") > SPIKE * F.col("expected"))).select("source", "size")
    near = F.explode(F.array(F.struct("size", F.lit(True).alias("exact")), F.struct((F.col("size") - 1).alias("size"), F.lit(False).alias("exact")))).alias("x")
    return limits.select("source", near).groupBy("source", F.col("x.size").alias("size")).agg(F.max("x.exact").alias("exact")).withColumn("at_limit", F.lit(True))


def judge(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, form, terminality, copy_goes_on (the first of 'word', 'sentence', 'stop', 'stop, new', '' that some copy shows; null without a verified copy), at_limit,
    truncated: one row per text with content. A null source has no field limit."""
    scratch = scratch or Scratch(docs.sparkSession, "truncation")
    texts = docs.select("doc_id", "text").where("text is not null")
    schema = "doc_id long, form string, word string, ending long, same long, size long, bands array<long>, source string"
    feats = scratch.put(docs.select("doc_id", "text", "source").where("text is not null").mapInArrow(_features, schema))
    limits = field_limits(feats.where("form in ('open', 'dots', 'mark')").select("source", "size", "ending"))
    copies = aligned(feats, texts, scratch)
    wanted = feats.where("word <> ''").select("word").distinct()
    stats = texts.select("text").mapInArrow(_word_ends, "word string, ends long, n long").join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    stats = stats.select("word", F.col("n").alias("occurs"), (F.col("ends") / (F.col("n") + 2)).alias("terminality"))
    j = feats.drop("bands").join(stats, "word", "left").join(copies, "same", "left").join(limits, ["source", "size"], "left")
    at_limit, known = F.coalesce("at_limit", F.lit(False)), F.coalesce("terminality", F.lit(0.0))
    # some copy goes on so
    some = lambda how: F.coalesce(F.array_contains("copies", how), F.lit(False))
    in_sentence = some("word") | some("sentence")
    goes_on = F.coalesce(*[F.when(some(how), how) for how in ("word", "sentence", "stop", "stop, new", "")])
    short = (F.length("word") <= SHORT_WORD) & (known >= ABBREVIATION) & (F.coalesce("occurs", F.lit(0)) >= KNOWN_WORD)
    cut = (
        F.when(F.col("form") == "mark", True)
        .when(F.col("form") == "sentence", some("word") | some("stop") | (some("stop, new") & short))
        # dots may close a sentence; a cut leaves them at a limit or behind a part of a word
        .when(F.col("form") == "dots", at_limit | in_sentence | (F.coalesce("occurs", F.lit(0)) < KNOWN_WORD))
        .when(F.col("form") == "closer", F.coalesce("exact", F.lit(False)) | some("word"))
        .when(at_limit | in_sentence, True)
        # a figure closes nothing by itself
        .otherwise(F.col("word").rlike("[0-9]") | (known <= OPEN_AT_MOST))
    )
    return j.select("doc_id", "form", known.alias("terminality"), goes_on.alias("copy_goes_on"), (at_limit & (F.col("form") != "sentence")).alias("at_limit"), cut.alias("truncated"))


def found(docs: DataFrame) -> DataFrame:
    return judge(docs).where("truncated").select("doc_id")


def rates(docs: DataFrame) -> DataFrame:
    """Per source (null is a source of its own): texts with content, truncated texts, their share."""
    j = docs.select("doc_id", "source").join(judge(docs).select("doc_id", "truncated"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("truncated").alias("n_truncated")).withColumn("rate", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
