"""Encoding of texts with a public byte-level BPE vocabulary.

Words (pre-tokens) are counted over the whole collection; the most frequent ones, with their ids, are compiled into a minimal
acyclic transducer that every worker maps into memory. Words the lexicon lacks are merged exactly by the vocabulary's ranks.
The ids equal those of the public tokenizer without special tokens. An empty text has the empty list, and so has a null text.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
import unicodedata
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebolt.common import shared_dir
from casebolt.llm.automaton import Lexicon, build

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Most words in the lexicon: the bound of what is collected to compile it.
LEXICON_WORDS = 60_000
#: Words a worker remembers before it starts again.
REMEMBERED = 400_000

# Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts without the characters in _SLOW, in the faster standard engine.
_FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@functools.cache
def _slow() -> tuple[re.Pattern, re.Pattern]:
    """Characters the two engines class differently: numbers that are no decimal digits, and separators that are no white space.
    Beyond the basic plane every character counts as one: a class of single characters is fast within it only."""
    odd = [chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("No", "Nl", "Cs")]
    return re.compile("[" + "".join(map(re.escape, odd)) + "\x1c-\x1f]"), re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _exact():
    import regex

    return regex.compile(PATTERN)


def words_of(text: str) -> list[str]:
    basic, beyond = _slow()
    return _exact().findall(text) if beyond.search(text) or basic.search(text) else _FAST.findall(text)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one word, always the lowest rank first."""
    if (whole := rank.get(word)) is not None:
        return [whole]
    if len(word) > 400:
        return _merge_long(word, rank)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


def _merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same for very long words, with a heap instead of a scan for each merge."""
    import heapq

    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = nxt[i]
        if part[i] is None or j >= n or part[i] + part[j] != pair:
            continue
        part[i], part[j], nxt[i] = pair, None, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for a in (prv[i], i):
            if 0 <= a and nxt[a] < n and (r := rank.get(part[a] + part[nxt[a]])) is not None:
                heapq.heappush(heap, (r, a, part[a] + part[nxt[a]]))
    return [rank[p] for p in part if p is not None]


def _count_batches(batches):
    for b in batches:
        c: Counter = Counter()
        for text in b.column(0).to_pylist():
            if text:
                c.update(words_of(text))
        # a word longer than 64 bytes is never frequent enough to be worth a path; it is merged when met
        kept = [(w, n) for w, n in c.items() if len(w) <= 64]
        yield pa.record_batch([pa.array([w.encode() for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word (UTF-8), n: over all texts; counted per batch before the shuffle."""
    return docs.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(_count_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, text_col: str, vocabulary: str = DEFAULT_VOCABULARY, max_words: int = LEXICON_WORDS) -> str:
    """Path of the lexicon file in the shared folder, of the ``max_words`` most frequent words (ties by the word itself)."""
    spark = docs.sparkSession
    top = word_counts(docs, text_col).orderBy(F.desc("n"), "word").limit(max_words).select("word").toArrow().column(0).to_pylist()
    rank = ranks(vocabulary)
    data = build(top, [merge(w, rank) for w in top])
    path = f"{shared_dir(spark)}/casebolt-lexicon-{uuid.uuid4().hex[:12]}.bin"
    if path.startswith("file:") or path.startswith("/"):
        with open(local(path), "wb") as f:
            f.write(data)
    else:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
        out.write(bytearray(data))
        out.close()
    return path


def local(uri: str) -> str:
    return re.sub(r"^file:/*", "/", uri)


@functools.cache
def open_lexicon(uri: str) -> Lexicon:
    if uri.startswith(("file:", "/")):
        return Lexicon.open(local(uri))
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        return Lexicon(f.read())


class Encoder:
    """Word -> ids with a memory in front of the transducer and of the exact merges."""

    def __init__(self, lexicon_uri: str | None, vocabulary: str):
        self.lexicon = open_lexicon(lexicon_uri) if lexicon_uri else None
        self.rank, self.known = ranks(vocabulary), {}

    def learn(self, words) -> None:
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(words)
        raw = [w.encode("utf-8", "replace") for w in fresh]
        numbers = self.lexicon.numbers(raw).tolist() if self.lexicon else [-1] * len(raw)
        for w, b, k in zip(fresh, raw, numbers):
            self.known[w] = self.lexicon.ids(k) if k >= 0 else merge(b, self.rank)

    def encode(self, text: str) -> list[int]:
        words = words_of(text)
        known, out = self.known, []
        try:
            for w in words:
                out += known[w]
        except KeyError:
            self.learn(set(words))
            known, out = self.known, []
            for w in words:
                out += known[w]
        return out


def _encode(lexicon: str | None, vocabulary: str, counts: bool):
    def run(batches):
        enc = Encoder(lexicon, vocabulary)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            ids = [enc.encode(t) if t else [] for t in texts.to_pylist()]
            col = pa.array(list(map(len, ids)), pa.int64()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], col], names=[*b.schema.names[:-1], "n_tokens" if counts else "ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, max_words: int = LEXICON_WORDS) -> DataFrame:
    """One row per document: ``id_col``, ids (array<int>). Other columns of the input are ignored."""
    lexicon = compile_lexicon(docs, text_col, vocabulary, max_words)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(_encode(lexicon, vocabulary, False), f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, max_words: int = LEXICON_WORDS) -> DataFrame:
    """The columns ``keep`` and n_tokens (0 for an empty or null text)."""
    lexicon = compile_lexicon(docs, text_col, vocabulary, max_words)
    kinds = dict(docs.dtypes)
    return docs.select(*keep, text_col).mapInArrow(_encode(lexicon, vocabulary, True), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")
