"""Groups of texts whose word-shingle sets have a Jaccard similarity of at least a threshold.

Universe-partition pigeonhole. Sizes fall into bands (each band's largest size is 1/threshold times the one before), and every band
has its own number of segments m. A hash spreads the shingle universe over the m segments of a band, so a set becomes m subsets.
Two sets that reach the threshold differ in at most H = (1-t)/(1+t) * (|X|+|Y|) shingles, and each differing shingle spoils at most
one segment. With more than H non-empty segments some segment is the same in both, whatever the hash does; as the hash spreads the
differences at random, fewer segments leave one too, except with a probability that ``miss`` gives. The subsets of the non-empty segments
are the signatures; a set signs in its own band and, if it can have a larger partner there, in the next one. A leading share of the
segments may also get the one-deletion neighbourhoods of its subsets; such a segment is spoiled by two differing shingles only, so
fewer and larger segments do.

``options`` lists the (m, share) that keep the guarantee: a pair at the threshold is missed with a probability of MISS at most. Which one a band uses is decided by cost over all sets: one segment in SLICE
(at least one) is signed under every option, and the signatures and the pairs they would bring together are counted (``measure``). Where
pairs are dear against signatures, larger segments with neighbourhoods win; else the fewest exact segments do.

Equal sets are signed once. Signatures travel as packed bytes: per chunk of sets and bucket 4-byte signatures with 2-byte places, and for
each set with a signature there 23 bytes: its distance from the chunk's first number, its size on a logarithmic scale and the first
FIRST_BITS of its sketch. So a signature costs 6 bytes, and 29 at most however many buckets there are. A bucket finds equal signatures
by sorting and drops pairs whose sizes or sketches cannot reach the threshold. Those of up to GROUP_MAX sets give all their pairs. Larger groups are hot and give none; a set with so many hot signatures that a pair
could be missed with more than MISS_HOT for want of others (``spare``) is signed once more, by single shingles, the rarest first: two sets at the threshold share at least ``t * n`` of the n shingles of either, so in any one order of all shingles their
first common one is among the first ``n - ceil(t * n) + 1`` of both. The order is by counts over all these sets, in SLOTS counters, so
the shingles of common passages come last and are signatures only of texts that consist of them for the most part. Groups of more than
TOGETHER sets are worked off in blocks of BLOCK sets against BLOCK sets, spread over the executors. No group is thinned, so every pair at
the threshold is a candidate.

Candidates of all buckets, each once, are screened by their whole sketches of SKETCH_BITS one-bit min-hashes. Each screening
drops a pair that agrees in fewer bits than a pair at the threshold does but in SKETCH_LOSS of the cases. The rest is verified exactly on the full shingle sets
(40-bit hashes), and the links and equal sets are contracted into groups.

Texts with fewer than ``min_words`` words, empty and null ones take no part. Equal texts have similarity 1.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebolt.common import Scratch, release
from casebolt.llm.groups import contract, pairs_within

THRESHOLD, SHINGLE, MIN_WORDS = 0.55, 3, 20
#: Largest group of one signature that gives its pairs in the first signing; the sets of larger ones are signed again.
GROUP_MAX = 128
#: Groups of the second signing up to this size give their pairs in their bucket, larger ones in blocks of so many sets.
TOGETHER, BLOCK = 128, 2_000
#: Candidates held before repeated ones are removed.
HELD = 4_000_000
#: Counters of the order by frequency.
SLOTS = 1 << 20
#: Bits of the sketch that screens candidates (a multiple of 64) and of its part in the buckets (half a multiple more), and the part of pairs at the threshold that
#: each screening may lose.
SKETCH_BITS, FIRST_BITS, SKETCH_LOSS = 256, 160, 5e-7
#: Base of the logarithmic scale of sizes in the buckets.
SIZE_BASE = 1.08
#: Signatures a bucket should hold: sets the number of buckets from the amount of text. A bucket is worked off in ranges of
#: signatures of at most AT_ONCE, so its working memory does not grow with it.
PER_BUCKET, AT_ONCE = 8_000_000, 2_000_000
#: Shingles handled at once by a worker; sets a chunk can number.
CHUNK, CHUNK_SETS = 1_000_000, 65_536
#: Probability of missing a pair at the threshold, without and with its hot signatures left out, and standard deviations to spare where
#: it must hold in the worst case.
MISS, MISS_HOT, SCARCE = 1e-8, 1e-6, 4.0
#: One segment in so many is measured for each option; the cost of a candidate pair in signatures.
SLICE, PAIR_COST = 64, 0.5
#: Set numbers that are broadcast at most (8 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Equal sets a worker remembers.
REMEMBERED = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_MASK = _U((1 << 40) - 1)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Text -> sorted distinct 64-bit shingle hashes; word hashes are remembered."""

    def __init__(self, k: int, min_words: int):
        self.k, self.min_words, self.known = k, min_words, {}

    def __call__(self, text: str | None) -> np.ndarray | None:
        s = self.ordered(text)
        return None if s is None else np.unique(s)

    def ordered(self, text: str | None) -> np.ndarray | None:
        """The hashes in the order of the text, repeated ones included."""
        if not text:
            return None
        w = words(text)
        if len(w) < max(self.min_words, self.k):
            return None
        known = self.known
        try:
            h = np.array([known[x] for x in w], _U)
        except KeyError:
            if len(known) > 1_000_000:
                known.clear()
            for x in w:
                if x not in known:
                    known[x] = xxhash.xxh3_64_intdigest(x)
            h = np.array([known[x] for x in w], _U)
        n = len(h) - self.k + 1
        s = np.zeros(n, _U)
        with np.errstate(over="ignore"):
            for j in range(self.k):
                s = s * _U(0x9E3779B97F4A7C15) + h[j : j + n]
                s ^= s >> _U(29)
            return _mix(s)


# ---- packed sets
def packed(shingles: np.ndarray) -> bytes:
    """Sorted distinct 40-bit values, five bytes each."""
    return shingles.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view(_U).ravel()


# ---- bands and allocation
def bands(threshold: float, largest: int) -> list[int]:
    """Upper sizes of the bands, up to one that holds ``largest``."""
    out = [24]
    while out[-1] < largest:
        out.append(int(math.floor(out[-1] / threshold)))
    return out


def miss(top: int, m: int, share: float, threshold: float, hot: int = 0) -> float:
    """The greatest probability that a pair at the threshold, both of whose sets sign in the band with largest size ``top``, shares no
    signature of m segments, ``share`` of them with neighbourhoods, other than ``hot`` ones (which hold common shingles only).

    A hash puts c common and d differing shingles, c = threshold * (c + d), into the segments; a segment brings the pair together if it
    has a common shingle and no differing one, or with neighbourhoods at most one (one of each side would do as well; all on one side
    is the harder case). The unions of such pairs have threshold to 2 / (1 + threshold) times ``top`` shingles."""
    worst = 0.0
    for step in range(9):
        union = top * (threshold + (2 / (1 + threshold) - threshold) * step / 8)
        c = threshold * union / m
        left, common = m - hot, threshold * union - hot * c / (1 - math.exp(-c))
        if left <= 0 or common <= 0:
            return 1.0
        mu, some = (1 - threshold) * union / left, 1 - math.exp(-common / left)
        exact, near = some * math.exp(-mu), some * math.exp(-mu) * (1 + mu)
        worst = max(worst, (1 - exact) ** (left * (1 - share)) * (1 - near) ** (left * share))
    return worst


@functools.cache
def spare(top: int, m: int, share: float, threshold: float) -> int:
    """How many of a set's signatures may be hot while the others keep a miss under MISS_HOT."""
    h = 0
    while miss(top, m, share, threshold, h + 1) <= MISS_HOT:
        h += 1
    return h


@functools.cache
def options(top: int, threshold: float) -> list[tuple[int, float]]:
    """(m, share): numbers of segments of the band with largest size ``top``, each with the least share of segments with one-deletion
    neighbourhoods that keeps the guarantee, the last one without any.

    The guarantee: a pair at the threshold is missed with a probability of MISS at most. Sets too small for that get so many segments
    that the pigeonhole holds in the worst case: the non-empty ones exceed H by SCARCE standard deviations, at the top of the band."""
    out = []
    for k in range(60):
        m = int(top * 0.08 * 1.09**k)
        if m < 8:
            continue
        shares = [x / 4 for x in range(5) if miss(top, m, x / 4, threshold) <= MISS]
        if shares and (not out or shares[0] < out[-1][1]):
            out.append((m, shares[0]))
        if shares and shares[0] == 0:
            return out
    need = (1 - threshold) / (1 + threshold) * 2 * top + 1
    for step in range(8, 80):
        m = max(8, int(top * step / 8))
        lam = top / m
        spread = math.sqrt(m * math.exp(-lam) * (1 - (1 + lam) * math.exp(-lam)))  # of occupied cells
        if m * (1 - math.exp(-lam)) - SCARCE * spread >= need:
            return [*out, (m, 0.0)]
    raise ValueError(f"no segments for sets of {top}")


def _place(sets: list[np.ndarray], threshold: float):
    n = np.array([len(s) for s in sets], np.int64)
    tops = np.array(bands(threshold, int(math.floor(n.max() / threshold)) + 1), np.int64)
    tok = np.concatenate(sets)
    return n, tops, np.searchsorted(tops, n), np.repeat(np.arange(len(sets)), n), _mix(tok + _U(0x51)), _mix(tok + _U(0xA7))


def _segments(row, place, value, m, two, g, limit=None):
    """(signature, row) of the segments of each row's m, those below ``two`` with neighbourhoods; of the first ``limit`` segments only,
    if given."""
    seg = ((place >> _U(32)) * m[row].astype(_U) >> _U(32)).astype(np.int64)
    if limit is not None:
        keep = seg < limit[row]
        row, seg, value = row[keep], seg[keep], value[keep]
        width = limit
    else:
        width = m
    start = np.concatenate([[0], np.cumsum(width)])
    at = start[row] + seg
    total = np.zeros(start[-1], _U)
    np.add.at(total, at, value)
    count = np.bincount(at, minlength=int(start[-1]))
    full = np.flatnonzero(count)
    seg_row = np.repeat(np.arange(len(m)), width)[full]
    salt = lambda segs, rows: segs.astype(_U) * _U(0xD6E8FEB86659FD93) + (g[rows].astype(_U) << _U(40))
    sig, who = [_mix(total[full] + salt(full - start[seg_row], seg_row))], [seg_row]
    d = (seg < two[row]) & (count[at] > 1)
    if d.any():
        sig.append(_mix(total[at[d]] - value[d] + salt(seg[d], row[d])))
        who.append(row[d])
    return np.concatenate(sig), np.concatenate(who)


def signatures(sets: list[np.ndarray], threshold: float, plan: dict[int, tuple[int, float]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets under the plan {top of a band: (m, share)}; bands without one use their last option."""
    n, tops, band, row_of, place, value = _place(sets, threshold)
    plan = plan or {}
    spec = [plan.get(t) or options(t, threshold)[-1] for t in tops.tolist()]
    of_m, of_two = np.array([s[0] for s in spec]), np.array([s[0] * s[1] for s in spec])
    sig, row = [], []
    for up in (0, 1):
        g = band + up
        # a larger partner in the next band exists only if n / threshold reaches beyond this band's top
        take = np.ones(len(n), bool) if up == 0 else np.floor(n / threshold) > tops[band]
        g = np.where(take, g, 0)
        use = take[row_of]
        x, y = _segments(row_of[use], place[use], value[use], np.where(take, of_m[g], 0), of_two[g], g)
        sig.append(x)
        row.append(y)
    return np.concatenate(sig), np.concatenate(row)


def _measured(threshold: float):
    """(top, choice, signature, n): in how many sets of a chunk a signature of the measured segments is, for every option of their bands."""

    def count(sets):
        n, tops, band, row_of, place, value = _place(sets, threshold)
        choices = [options(t, threshold) for t in tops.tolist()]
        out = []
        for up in (0, 1):
            take = np.ones(len(n), bool) if up == 0 else np.floor(n / threshold) > tops[band]
            g = np.where(take, band + up, 0)
            most = np.array([max(max(1, m // SLICE) / m for m, _ in c) for c in choices])
            near = take[row_of] & (place >> _U(32) < ((most[g] * 2**32).astype(_U) + _U(2))[row_of])
            row, p, v = row_of[near], place[near], value[near]
            for k in range(max(map(len, choices))):
                m = np.array([c[k][0] if k < len(c) else 0 for c in choices])
                two = np.array([c[k][0] * c[k][1] if k < len(c) else 0 for c in choices])
                limit = np.where(take & (m[g] > 0), np.maximum(1, m[g] // SLICE), 0)
                sig, who = _segments(row, p, v, m[g], two[g], g, limit)
                out.append((g[who], np.full(len(sig), k), sig, who))
        g, k, sig, who = (np.concatenate(x) for x in zip(*out))
        # a set counts once for a signature
        _, first = np.unique(_mix(sig + k.astype(_U)) * _U(0x9E3779B97F4A7C15) + who.astype(_U), return_index=True)
        key, at, c = np.unique(sig[first] ^ _mix(k[first].astype(_U) + _U(1)), return_index=True, return_counts=True)
        return pa.record_batch([pa.array(tops[g[first][at]], pa.int32()), pa.array(k[first][at], pa.int32()), pa.array(key.view(np.int64)), pa.array(c, pa.int64())], names=["top", "choice", "signature", "n"])

    def run(batches):
        with np.errstate(over="ignore"):
            for sets in _chunks(batches):
                yield count(sets[1])

    return run


def _chunks(batches):
    """(numbers, sets, further columns) of rows (n, shingles, ...), up to CHUNK shingles, with numbers that rise and span less than CHUNK_SETS."""
    ids, sets, more, size = [], [], [], 0
    for b in batches:
        rest = list(zip(*(c.to_pylist() for c in b.columns[2:]))) or [()] * b.num_rows
        for v, s, x in zip(b.column(0).to_pylist(), b.column(1), rest):
            if ids and (size > CHUNK or not ids[-1] < v < ids[0] + CHUNK_SETS):
                yield ids, sets, more
                ids, sets, more, size = [], [], [], 0
            ids.append(v)
            sets.append(unpacked(s.as_buffer()))
            more.append(x)
            size += len(sets[-1])
    if ids:
        yield ids, sets, more


def measure(sets: DataFrame, threshold: float = THRESHOLD, pair_cost: float = PAIR_COST) -> dict[int, tuple[int, float]]:
    """{top of a band: (m, share)}: the options of least cost over all ``sets`` (n, shingles).

    Cost: signatures, and ``pair_cost`` for every pair that a signature brings together; beyond GROUP_MAX a set of a group costs as much as in
    one of GROUP_MAX. What comes to the driver are two sums for each option of a band."""
    counted = sets.select("n", "shingles").mapInArrow(_measured(threshold), "top int, choice int, signature long, n long").groupBy("top", "choice", "signature").agg(F.sum("n").alias("n"))
    pairs = F.col("n") * F.least(F.col("n") - 1, F.lit(GROUP_MAX)) / 2
    cost: dict[int, dict[int, float]] = {}
    for top, choice, n, met in counted.groupBy("top", "choice").agg(F.sum("n"), F.sum(pairs)).collect():
        m = options(top, threshold)[choice][0]
        cost.setdefault(top, {})[choice] = (n + pair_cost * met) * m / max(1, m // SLICE)
    return {top: options(top, threshold)[min(c, key=lambda k: (c[k], k))] for top, c in cost.items()}


def rarest_first(sets: list[np.ndarray], threshold: float, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the first n - ceil(threshold * n) + 1 shingles of all sets (sorted ones) in the order of their counters in
    ``often``, then hash."""
    n = np.array([len(s) for s in sets], np.int64)
    tok, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    count = often[_slot(tok)].astype(_U)
    # stable: of equal keys the lesser shingle comes first in every set
    order = np.argsort(row.astype(_U) << _U(48) | count << _U(32) | tok & _U(0xFFFFFFFF), kind="stable")
    place = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
    first = order[place < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)]
    return _mix(tok[first] + _U(0x3B)), row[first]


def _slot(tok: np.ndarray) -> np.ndarray:
    return (_mix(tok + _U(0x77)) & _U(SLOTS - 1)).astype(np.int64)


def _counters(batches):
    """block, counts: the counters of this task's shingles in blocks of 65,536."""
    total = np.zeros(SLOTS, np.int64)
    with np.errstate(over="ignore"):
        for _, sets, _ in _chunks(batches):
            total += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS)
    for k, part in enumerate(total.reshape(-1, 65_536)):
        if part.any():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])


def _added(block: pa.Table) -> pa.Table:
    total = np.zeros(65_536, np.int64)
    for c in block.column("counts"):
        total += np.frombuffer(c.as_buffer(), np.int64)
    return pa.table({"block": block.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def frequencies(sets: DataFrame) -> np.ndarray:
    """Counters of the shingles of all ``sets`` on a logarithmic scale (one byte each, SLOTS of them)."""
    # two steps, so that no task gets the counters of all others
    parts = sets.select("n", "shingles").mapInArrow(_counters, "block int, counts binary").withColumn("salt", F.floor(F.rand(1) * 16).cast("int"))
    once = parts.groupBy("block", "salt").applyInArrow(lambda t: _added(t), "block int, counts binary")
    out = np.zeros((SLOTS // 65_536, 65_536), np.int64)
    for k, c in once.groupBy("block").applyInArrow(lambda t: _added(t), "block int, counts binary").collect():
        out[k] = np.frombuffer(c, np.int64)
    return np.minimum(255, np.log2(1 + out.ravel()) * 8).astype(np.uint8)


# ---- signing and matching
_PARTS = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_FIRST = _PARTS[: FIRST_BITS // 64 + 1]
_RECORD = np.dtype([("sketch", np.uint64, len(_FIRST) - 1), ("half", np.uint32), ("away", np.uint16), ("size", np.uint8)])


def _size_code(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.log(np.maximum(1, n)) / math.log(SIZE_BASE)).astype(np.uint8)


def _sign(signer, buckets: int):
    """Packs the signatures of sets(n, shingles, first parts of the sketch): bucket, blob."""
    bits = buckets.bit_length() - 1

    def pack(ids: list[int], sets: list[np.ndarray], sketch: list[tuple]):
        with np.errstate(over="ignore"):
            sig, row = signer(sets)
        record = np.zeros(len(ids), _RECORD)
        parts = np.array(sketch, np.int64).view(_U).reshape(len(ids), len(_FIRST))
        record["sketch"], record["half"] = parts[:, :-1], parts[:, -1] & _U(0xFFFFFFFF)
        record["away"] = np.array(ids, np.int64) - ids[0]
        record["size"] = _size_code(np.array([len(s) for s in sets]))
        bucket = (sig >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)
        # by bucket, then set: the sets of a bucket are numbered as they come
        order = np.argsort(bucket << 16 | row, kind="stable")
        bucket, low, row = bucket[order], sig[order].astype(np.uint32), row[order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        edge = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
        used, first = record[row[new]], np.array([ids[0]], np.int64).tobytes()
        keep = [i for i in range(buckets) if edge[i + 1] > edge[i]]
        blobs = []
        for i in keep:
            a, b = edge[i], edge[i + 1]
            x, y = number[a], number[b - 1] + 1
            blobs.append(first + np.array([y - x], np.int32).tobytes() + used[x:y].tobytes() + low[a:b].tobytes() + (number[a:b] - x).astype(np.uint16).tobytes())
        return pa.record_batch([pa.array(keep, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches):
        for ids, sets, more in _chunks(batches):
            yield pack(ids, sets, more)

    return run


class _Sieve:
    """Pairs that sizes and sketches allow the threshold."""

    def __init__(self, records: np.ndarray, threshold: float):
        sketch = records["sketch"]
        self.parts = [*[np.ascontiguousarray(sketch[:, w]) for w in range(sketch.shape[1])], np.ascontiguousarray(records["half"])]
        self.size, self.most = records["size"].astype(np.int16), FIRST_BITS - least_agreement(threshold, FIRST_BITS)
        self.apart = math.ceil(math.log(1 / threshold) / math.log(SIZE_BASE)) + 1

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.abs(self.size[x] - self.size[y]) <= self.apart
        x, y = x[ok], y[ok]
        differ = np.zeros(len(x), np.uint16)
        for p in self.parts:
            differ += np.bitwise_count(p[x] ^ p[y])
        ok = differ <= self.most
        x, y = x[ok], y[ok]
        return np.minimum(x, y) << 32 | np.maximum(x, y)

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(p[x] ^ p[y]).astype(np.int32) for p in self.parts)


def _pairs(low: np.ndarray, rec: np.ndarray, sieve: _Sieve, most_sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a << 32 | b, a < b) of the groups of up to ``most_sets`` members, and (signature, member) of larger ones."""
    key = low.astype(_U) << _U(32) | rec.astype(_U)
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    low, rec = (key >> _U(32)).astype(np.uint32), (key & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(low)))
    held, n_held = [], 0
    small = (length > 1) & (length <= most_sets)
    if small.any():
        n_small, b_small = length[small], begin[small]
        left = np.repeat(n_small, n_small)  # places from here to the group's end
        first = np.repeat(np.cumsum(n_small) - n_small, n_small)
        at = np.arange(len(left)) - first
        i, left = np.repeat(b_small, n_small) + at, left - at
        for d in range(1, int(n_small.max())):
            ok = left > d
            i, left = i[ok], left[ok]
            held.append(sieve(rec[i], rec[i + d]))
            n_held += len(held[-1])
            if n_held > HELD:
                held = [np.unique(np.concatenate(held))]
                n_held = len(held[0]) // 2  # so that many different pairs are not sorted again at every step
    large = np.repeat(length > most_sets, length)
    return np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64), low[large], rec[large]


def _match(threshold: float, most_sets: int, again: bool):
    """(kind, a, b, d): kind 0 is a candidate pair of set numbers with its differing sketch bits; of groups above ``most_sets`` kind 1 with the set's number and its hot
    signatures in this bucket where sets are signed again, else kind 2 with the group and the set's number."""

    def bucket(k, blobs):
        low, rec, numbers, records, n_records = [], [], [], [], 0
        for blob in blobs:
            u = int(np.frombuffer(blob, np.int32, 1, 8)[0])
            at = 12 + u * _RECORD.itemsize
            n = (len(blob) - at) // 6
            records.append(np.frombuffer(blob, _RECORD, u, 12))
            numbers.append(records[-1]["away"].astype(np.int64) + np.frombuffer(blob, np.int64, 1)[0])
            low.append(np.frombuffer(blob, np.uint32, n, at))
            rec.append(np.frombuffer(blob, np.uint16, n, at + 4 * n).astype(np.uint32) + np.uint32(n_records))
            n_records += u
        blobs.clear()
        low, rec, ids, records = np.concatenate(low), np.concatenate(rec), np.concatenate(numbers), np.concatenate(records)
        # every set is in one chunk, so each has one record here; in the order of numbers a pair has its lesser number first
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.uint32)
        place[order] = np.arange(len(ids))
        ids, records, rec = ids[order], records[order], place[rec]
        sieve = _Sieve(records, threshold)
        bits = max(0, math.ceil(math.log2(max(1, len(low)) / AT_ONCE)))
        of = (low >> np.uint32(32 - bits)).astype(np.uint16) if bits else None
        found, groups_, members = [], [], []
        for x in range(1 << bits):
            here = slice(None) if of is None else np.flatnonzero(of == x)
            pairs, group, member = _pairs(low[here], rec[here], sieve, most_sets)
            found.append(pairs)
            groups_.append(group)
            members.append(member)
        found, members = np.unique(np.concatenate(found)), np.concatenate(members)
        if again:
            a, b = np.unique(members, return_counts=True)
            a, kind = ids[a], 1
        else:
            a, b, kind = np.concatenate(groups_).astype(np.int64) | (k << 32), ids[members], 2
        x, y = found >> 32, found & 0xFFFFFFFF
        d = np.concatenate([sieve.differing(x, y), np.zeros(len(a), np.int32)])
        a, b = np.concatenate([ids[x], a]), np.concatenate([ids[y], b])
        return pa.record_batch([pa.array(np.repeat([0, kind], [len(found), len(a) - len(found)]), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], names=["kind", "a", "b", "d"])

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(k, []).append(blob.as_py())
        for k in sorted(held):
            yield bucket(k, held.pop(k))

    return run


def _candidates(sets: DataFrame, signer, n_signatures: float, threshold: float, most_sets: int, again: bool) -> DataFrame:
    buckets = 1 << max(3, math.ceil(math.log2(max(1, n_signatures / PER_BUCKET))))
    signed = sets.select("n", "shingles", *_FIRST).mapInArrow(_sign(signer, buckets), "bucket int, blob binary")
    return signed.repartitionById(buckets, F.col("bucket")).mapInArrow(_match(threshold, most_sets, again), "kind int, a long, b long, d int")


# ---- screening
def sketches(sets: list[np.ndarray], bits: int = SKETCH_BITS) -> np.ndarray:
    """One row of bits / 32 words a set: of each of so many hash orders, one bit of the first shingle."""
    tok = _mix(np.concatenate(sets))
    low, high = tok.astype(np.uint32), (tok >> _U(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), bits // 32), np.uint32)
    factor = _mix(np.arange(1, bits + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
    work = np.empty_like(low)
    for j in range(bits):
        np.multiply(low, factor[j], out=work)
        np.bitwise_xor(work, high, out=work)
        np.multiply(work, factor[-1 - j], out=work)
        first = np.minimum.reduceat(work, starts)
        out[:, j // 32] |= ((first * factor[j] >> np.uint32(13)) & np.uint32(1)) << np.uint32(j % 32)
    return out


@functools.cache
def least_agreement(threshold: float, bits: int = SKETCH_BITS) -> int:
    """Agreeing bits that a pair at the threshold reaches except in SKETCH_LOSS of the cases: bits agree with (1 + t) / 2."""
    p, n, mass = (1 + threshold) / 2, bits, 0.0
    for k in range(n + 1):
        mass += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if mass > SKETCH_LOSS:
            return k
    return n


_LAST = _PARTS[len(_FIRST) - 1 :]


def _screen(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs (a, b) of those (a, b, d) screened in their buckets whose other sketch bits, with the d differing ones of the first,
    allow the threshold too."""
    of = lambda end: sketch.select(F.col("n").alias(end), *[F.col(p).alias(f"{end}_{p}") for p in _LAST])
    # one shuffle by a serves the removal of repeated pairs and the first join
    both = pairs.repartition("a").distinct().join(of("a"), "a").join(of("b"), "b")
    differ = [F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}")) for p in _LAST]
    differ = [F.bit_count(F.shiftrightunsigned(differ[0], 32)), *map(F.bit_count, differ[1:])]
    return both.where(F.col("d") + sum(differ[1:], differ[0]) <= SKETCH_BITS - least_agreement(threshold)).select("a", "b")


def _block_pairs(threshold: float):
    most = SKETCH_BITS - least_agreement(threshold)

    def run(block: pa.Table) -> pa.Table:
        n, size, side = (block.column(c).to_numpy() for c in ("n", "size", "side"))
        parts = [block.column(p).to_numpy().view(_U) for p in _PARTS]
        x, y = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # 0: both sides are one block
        out = [np.zeros((2, 0), np.int64)]
        for k in range(0, len(x), 256):
            i = x[k : k + 256]
            differ = np.zeros((len(i), len(y)), np.uint16)
            for p in parts:
                differ += np.bitwise_count(p[i][:, None] ^ p[y][None, :])
            ok = (differ <= most) & (np.minimum(size[i][:, None], size[y][None, :]) >= threshold * np.maximum(size[i][:, None], size[y][None, :]) - 1e-9)
            a, b = np.nonzero(ok)
            a, b = n[i[a]], n[y[b]]
            keep = a != b if len(x) != len(n) else a < b
            out.append(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _in_blocks(members: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Screened pairs of the members (group, n) of large groups: every block of a group against itself and every other one."""
    blocks = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    m = members.join(blocks, "group").join(sketch, "n").withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    m = m.select("*", other).withColumn("side", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2))
    m = m.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "side", "n", "size", *_PARTS)
    run = _block_pairs(threshold)
    return m.groupBy("group", "i", "j").applyInArrow(lambda t: run(t), "a long, b long")


# ---- sets and verification
def _sets(k: int, min_words: int):
    def run(batches):
        shingle, seen = Shingler(k, min_words), set()
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            v, n, same, size, data, fresh = [], [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (s := shingle(text)) is None:
                    continue
                s = np.unique(s & _MASK)
                raw = packed(s)
                h = xxhash.xxh3_64_intdigest(raw)
                if len(seen) > REMEMBERED:
                    seen.clear()
                v.append(i)
                n.append(number)
                same.append(h - (1 << 64) if h >> 63 else h)
                size.append(len(s))
                # the sets of repeated texts are written once
                data.append(None if h in seen else raw)
                if h not in seen:
                    fresh.append(s)
                    seen.add(h)
                number += 1
            parts = np.zeros((len(v), len(_PARTS)), np.int64)
            if fresh:
                with np.errstate(over="ignore"):
                    parts[[x is not None for x in data]] = sketches(fresh).view(np.int64)
            yield pa.record_batch([pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(same, pa.int64()), pa.array(size, pa.int32()), *[pa.array(np.ascontiguousarray(parts[:, i])) for i in range(len(_PARTS))], pa.array(data, pa.binary())], names=["v", "n", "same", "size", *_PARTS, "shingles"])

    return run


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = _common(p, q)
                keep.append(both / max(1, len(p) + len(q) - both))
            sim = np.array(keep, np.float64)
            ok = pa.array(sim >= threshold - 1e-12)
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(sim).filter(ok)], names=["a", "b", "similarity"])

    return run


def _common(p: np.ndarray, q: np.ndarray) -> int:
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int((q[at] == p).sum())


def only(rows: DataFrame, ids: DataFrame, how: str, key: str = "n") -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) among the written ``ids``: they are broadcast up to BROADCAST_IDS of them."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def _spare(plan: dict[int, tuple[int, float]], threshold: float):
    """The hot signatures a set of ``size`` may have in its own band and the next one."""
    tops = bands(threshold, int(max(plan, default=24) / threshold) + 1)
    out = F.lit(0)
    for top, up in reversed(list(zip(tops[:-1], tops[1:]))):
        most = min(spare(t, *(plan.get(t) or options(t, threshold)[-1]), threshold) for t in (top, up))
        out = F.when(F.col("size") <= top, most).otherwise(out)
    return out


def links(texts: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, k: int = SHINGLE, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """From texts(v long, text): (a, b, similarity) of all verified pairs of different sets, each set under one v that has it; and
    (v, one), that v, of every text that takes part."""
    spark = texts.sparkSession
    texts = texts.where(F.char_length("text") >= 2 * min_words - 1).select("v", "text")
    every = scratch.put(texts.mapInArrow(_sets(k, min_words), f"v long, n long, same long, size int, {', '.join(f'{p} long' for p in _PARTS)}, shingles binary"))
    written = every.where("shingles is not null")
    ones = scratch.put(written.groupBy("same").agg(F.min(F.struct("n", "v")).alias("x"), F.count("*").alias("c")).select("same", F.col("x.n").alias("one_n"), F.col("x.v").alias("one"), "c"))
    repeated = scratch.put(written.select("n", "same").join(ones.where("c > 1"), "same").where("n <> one_n").select("n"))
    copies = scratch.put(every.select("v", "same").join(ones.select("same", "one"), "same").select("v", "one"))
    sets = only(written.select("n", "size", "shingles", *_FIRST), repeated, "left_anti")
    n_shingles = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    plan = measure(sets, threshold)
    release(spark)
    per_shingle = max([m / top * (1 + 4 * share) for top, (m, share) in plan.items()] or [1.0]) * 1.5
    first = scratch.put(_candidates(sets, functools.partial(signatures, threshold=threshold, plan=plan), n_shingles * per_shingle, threshold, GROUP_MAX, True))
    release(spark)
    pairs = first.where("kind = 0").select("a", "b", "d")
    hot = first.where("kind = 1").groupBy(F.col("a").alias("n")).agg(F.sum("b").alias("hot"))
    hot = scratch.put(hot.join(written.select("n", "size"), "n").where(F.col("hot") > _spare(plan, threshold)).select("n"))
    members = None
    if not hot.isEmpty():
        some = scratch.put(only(sets, hot, "left_semi"))
        often = frequencies(some)
        signer = functools.partial(rarest_first, threshold=threshold, often=often)
        n_hot = some.agg(F.sum("size")).first()[0]
        second = scratch.put(_candidates(some, signer, n_hot * (1 - threshold), threshold, TOGETHER, False))
        release(spark)
        pairs = pairs.unionByName(second.where("kind = 0").select("a", "b", "d"))
        members = second.where("kind = 2").select(F.col("a").alias("group"), F.col("b").alias("n"))
        scratch.drop(some)
    sketch = written.select("n", "size", *_PARTS)
    screened = _screen(pairs, sketch, threshold)
    if members is not None and not members.isEmpty():
        screened = screened.unionByName(_in_blocks(members, sketch, threshold)).distinct()
    screened = scratch.put(screened)
    scratch.drop(first, hot, *([] if members is None else [second]))
    release(spark)
    ends = scratch.put(screened.select(F.explode(F.array("a", "b")).alias("n")).distinct())
    some = scratch.put(only(written.select("n", "v", "shingles"), ends, "left_semi"))
    scratch.drop(every, ones, repeated)
    of = lambda end: some.select(F.col("n").alias(end), F.col("v").alias("v" + end), F.col("shingles").alias("shingles" + end))
    both = screened.join(of("a"), "a").join(of("b"), "b").select("va", "vb", "shinglesa", "shinglesb")
    out = scratch.put(both.mapInArrow(_verify(threshold), "a long, b long, similarity double"))
    scratch.drop(screened, ends, some)
    release(spark)
    return out, copies


def groups(texts: DataFrame, scratch: Scratch, **kw) -> DataFrame:
    """(v, root, links) of every text with a partner: its group and how many texts it is linked to directly, copies of one set
    included."""
    return _grouped(*links(texts, scratch, **kw), scratch)


def _grouped(got: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    edges = got.select("a", "b").unionByName(copies.where("v <> one").select(F.col("one").alias("a"), F.col("v").alias("b")))
    weight = copies.groupBy("one").agg(F.count("*").alias("n"))
    both = got.select("a", "b").unionByName(got.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(weight.withColumnRenamed("one", "b"), "b").groupBy(F.col("a").alias("one")).agg(F.sum("n").alias("others"))
    degree = copies.join(weight.join(others, "one", "left").select("one", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")), "one")
    return contract(edges, scratch).join(degree.select("v", "links"), "v")


def _both_kinds(documents: DataFrame, mail: DataFrame) -> tuple[DataFrame, DataFrame]:
    return documents.select((F.col("doc_id") * 2).alias("v"), "text"), mail.select((F.col("mail_id") * 2 + 1).alias("v"), F.col("text_body").alias("text"))


def _named(c: str):
    return F.when(F.col(c).bitwiseAND(1) == 0, "document").otherwise("mail"), F.shiftright(c, 1)


def membership(documents: DataFrame, mail: DataFrame, scratch: Scratch | None = None, **kw) -> DataFrame:
    """record_kind, record_id, group_id (smallest id of the group), links (number of records at the threshold or above, equal ones
    included): one row per record that has a partner of its kind."""
    scratch = scratch or Scratch(documents.sparkSession, "neardup")
    (d, d_copies), (m, m_copies) = (links(x, scratch, **kw) for x in _both_kinds(documents, mail))
    roots = scratch.put(_grouped(d.unionByName(m), d_copies.unionByName(m_copies), scratch))
    low = roots.groupBy("root").agg(F.min("v").alias("low"))
    kind, rid = _named("v")
    return roots.join(low, "root").select(kind.alias("record_kind"), rid.alias("record_id"), F.shiftright("low", 1).alias("group_id"), "links")


def found(documents: DataFrame, mail: DataFrame) -> DataFrame:
    """record_kind, left_id, right_id of every pair in one group. Expands groups into pairs, as the case list asks."""
    scratch = Scratch(documents.sparkSession, "neardup")
    g = scratch.put(membership(documents, mail, scratch).select("record_kind", "group_id", "record_id"))
    return pairs_within(g, ["record_kind", "group_id"], "record_id", "left_id", "right_id").select("record_kind", "left_id", "right_id")
