"""Runs of periodic words, by the tandem-repeat method of Gusfield and Stoye, and texts with their repetitions collapsed.

A run is a stretch of consecutive words with smallest period q, of at least max(LEAST, EXPONENT * q) words, that no neighbouring word extends.  The method:

1. Lempel-Ziv blocks: from each start, the longest stretch that also begins further left.
2. Per block, the squares that cover the leftmost occurrence of every square: those centred in the block that begin in it (periods up to the block's length)
   or before it (up to its and the next block's length), each found by one extension forwards and one backwards.  Squares with a periodic half go.
3. Walks by suffix links: a square's first word moves to its end as long as that is a square again, at most a period long; so all rotations of the covering
   squares, which are all squares that occur, get their locus in the suffix tree; a locus that several walks meet stays once.
4. Below each locus lie all occurrences of its square; those at consecutive places with one period merge into a run.

The suffix tree is held as sorted suffixes with common prefixes: a locus is an interval of suffixes, found by jumps over the least common prefix of 2^j neighbours.
Extensions use ranks of all stretches of 2^j words, which the sort makes anyway.  All steps work on arrays, for many documents in one string whose
parts are divided by words that occur once.  Walks are taken at once, not one after another, so the bound is O(n log n) (primitive squares at a place), not O(n).

Before that, words that can't lie in any run are left out, exactly: as a run has six words and four periods, each of its words lies in a stretch of five words
that occurs twice in it.

Defined cases: a null text has no words; a null doc_id has no planted period; equal rows give equal rows; an empty table gives no rows; other columns are ignored.
Words are compared as they are, byte for byte.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

EXPONENT, LEAST = 4, 6
#: Words of the stretches that must occur twice.
GRAM = 5
#: Words that are worked on at once (more only where one document has more).
BATCH_WORDS = 400_000


@dataclass(frozen=True)
class Extensions:
    """Ranks of all stretches of 2^j words of a string, j = 0, 1, ..., until all are different; suffixes in order, and where they stand."""

    ranks: list[np.ndarray]
    order: np.ndarray

    @classmethod
    def of(cls, s: np.ndarray) -> Extensions:
        """s must not be empty.  Stretches that run over the end are different from all others."""
        n = len(s)
        ranks = [np.unique(s, return_inverse=True)[1].astype(np.int64) + 1]
        while ranks[-1].max() < n:
            step, last = 1 << (len(ranks) - 1), ranks[-1]
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = last[step:]
            ranks.append(np.unique(last * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1)
        order = np.empty(n, np.int64)
        order[ranks[-1] - 1] = np.arange(n)
        return cls([np.append(r, 0).astype(np.int32) for r in ranks], order)

    @property
    def place(self) -> np.ndarray:
        return self.ranks[-1][:-1].astype(np.int64) - 1

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on (a != b); a place behind the end agrees with nothing."""
        n, out = len(self.order), np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 2, -1, -1):
            r = self.ranks[j]
            x, y = np.minimum(a + out, n), np.minimum(b + out, n)
            out += ((r[x] == r[y]) & (x < n) & (y < n)).astype(np.int64) << j
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b backwards (a != b), both included; a place before the start agrees with nothing."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 2, -1, -1):
            r = self.ranks[j]
            x, y = a - out - (1 << j) + 1, b - out - (1 << j) + 1
            out += ((x >= 0) & (y >= 0) & (r[np.maximum(x, 0)] == r[np.maximum(y, 0)])).astype(np.int64) << j
        return out


def blocks(e: Extensions) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end."""
    n = len(e.order)
    before, after = [-1] * n, [-1] * n  # nearest suffixes in order that start further left
    stack: list[int] = []
    for p in e.order.tolist():
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        before[p] = stack[-1] if stack else -1
        stack.append(p)
    every = np.arange(n)
    longest = np.zeros(n, np.int64)
    for near in (np.array(before), np.array(after)):
        known = np.flatnonzero(near >= 0)
        longest[known] = np.maximum(longest[known], e.forward(every[known], near[known]))
    lengths, starts, at = longest.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += max(1, lengths[at])
    return np.array([*starts, n])


def counted(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, lengths[i] times i; and 0, 1, ... within each."""
    who = np.repeat(np.arange(len(lengths)), lengths)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def covering_squares(e: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of squares that cover the leftmost occurrence of each square."""
    bounds = blocks(e)
    h, stop = bounds[:-1], bounds[1:]
    size = stop - h
    behind = np.append(size[1:], 0)
    who, k = counted(size)  # begin and centre in the block
    k += 1
    end, q = stop[who], stop[who] - k
    ahead, back = e.forward(end, q), e.backward(end - 1, q - 1)
    good = (ahead + back >= k) & (ahead > 0)
    start = np.maximum(q - back, q - k + 1)
    found = [(start[good], k[good])]
    who, k = counted(size + behind)  # begin before the block, centre in it
    k += 1
    begin = h[who]
    q = begin + k
    fits = q < len(e.order)
    begin, k, q, end = begin[fits], k[fits], q[fits], stop[who][fits]
    ahead, back = e.forward(begin, q), e.backward(begin - 1, q - 1)
    start = np.maximum(begin - back, begin - k + 1)
    good = (ahead + back >= k) & (ahead > 0) & (back > 0) & (start + k <= end)
    found.append((start[good], k[good]))
    return np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])


def least_factors(n: int) -> np.ndarray:
    """The least prime factor of each number up to n."""
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            out[p * p :: p] = np.minimum(out[p * p :: p], p)
    return out


def primitive(e: Extensions, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the square at start has no smaller period that divides its half."""
    good, rest = np.ones(len(start), bool), period.copy()
    factors = least_factors(int(period.max(initial=1)))
    while len(open_ := np.flatnonzero(good & (rest > 1))):
        p = factors[rest[open_]]
        d = period[open_] // p
        good[open_] = e.forward(start[open_], start[open_] + d) < 2 * period[open_] - d
        rest[open_] //= p
    return good


class Loci:
    """Intervals of sorted suffixes that share a prefix."""

    def __init__(self, e: Extensions) -> None:
        n = len(e.order)
        shared = np.zeros(n + 1, np.int64)  # of a suffix and the one before it; 0 at both ends
        shared[1:n] = e.forward(e.order[:-1], e.order[1:])
        self.least = [shared.astype(np.int32)]  # least of 2^j neighbours, from each place on
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def interval(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the sorted suffixes that share `length` words with the one at place."""
        first, last = place.copy(), place.copy()
        for j in range(len(self.least) - 1, -1, -1):
            least, step = self.least[j], 1 << j
            at = first - step + 1  # shared[first - step + 1 .. first]
            first -= np.where((at >= 0) & (least[np.clip(at, 0, len(least) - 1)] >= length), step, 0)
            at = last + 1
            last += np.where((at < len(least)) & (least[np.minimum(at, len(least) - 1)] >= length), step, 0)
        return first, last


def all_runs(s: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of the runs of s, in no order."""
    none = (np.zeros(0, np.int64),) * 3
    if len(s) < least:
        return none
    e = Extensions.of(s)
    start, period = covering_squares(e)
    keep = primitive(e, start, period)
    start, period = start[keep], period[keep]
    # Squares of one stretch and period start one walk, from the stretch's left end.
    start = start - e.backward(start - 1, start + period - 1)
    both = np.unique(np.stack((start, period), axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    start, period = both[:, 0], both[:, 1]
    more = np.minimum(e.forward(start, start + period) - period, period - 1)  # rotations behind the first square
    who, turn = counted(more + 1)
    if not len(who):
        return none
    period = period[who]
    first, last = Loci(e).interval(e.place[start[who] + turn], 2 * period)
    locus = np.unique(np.stack((period, first, last), axis=1), axis=0)
    period, first, last = locus.T
    who, k = counted(last - first + 1)
    n = len(s)
    found = np.sort(period[who] * (2 * n) + e.order[first[who] + k])
    breaks = np.flatnonzero(np.diff(found) != 1)
    left, right = found[np.append(0, breaks + 1)], found[np.append(breaks, len(found) - 1)]
    period, start, length = left // (2 * n), left % (2 * n), right - left + 2 * (left // (2 * n))
    long = length >= np.maximum(least, exponent * period)
    return start[long], length[long], period[long]


def runs_of_documents(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, length, period) of all runs, by document, start and period; words are numbers, document by document."""
    n = len(words)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    offsets = np.cumsum(lengths) - lengths
    in_run = np.zeros(n + 1, np.int64)
    if n >= GRAM:
        h = owner[: n - GRAM + 1].astype(np.uint64)  # equal stretches of one document have equal numbers; a chance meeting only keeps more words
        for j in range(GRAM):
            h = (h ^ (words[j : n - GRAM + 1 + j].astype(np.uint64) + np.uint64(j + 1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = np.flatnonzero(owner[: n - GRAM + 1] == owner[GRAM - 1 :])
        order = np.argsort(h[whole], kind="stable")
        same = np.diff(h[whole][order]) == 0
        twice = whole[order[np.append(same, False) | np.append(False, same)]] if len(whole) else whole
        np.add.at(in_run, twice, 1)
        np.add.at(in_run, twice + GRAM, -1)
    inside = np.flatnonzero(np.cumsum(in_run)[:n] > 0)
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4
    new = np.append(True, (np.diff(inside) != 1) | (np.diff(owner[inside]) != 0))
    part = np.cumsum(new) - 1
    # Parts in one string, a word of its own behind each.
    s = np.empty(len(inside) + part[-1] + 1, np.int64)
    at = np.arange(len(inside)) + part
    s[:] = -1
    s[at] = words[inside]
    gaps = np.flatnonzero(s < 0)
    s[gaps] = words.max() + 1 + np.arange(len(gaps))
    where = np.zeros(len(s), np.int64)
    where[at] = inside
    start, length, period = all_runs(s)
    start = where[start]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return owner[start], start - offsets[owner[start]], length, period


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For ids whose CRC-32 ends in 0: the original number of each of n words, periodic from a place on; else None."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    """RESULT of a document from its runs (start, length, period) by start and period."""
    best = None
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    kept = words if not runs else [words[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    first = dict(zip(NAMES[1:5], (*best, 1000 * best[1] // best[2]), strict=True)) if best else dict.fromkeys(NAMES[1:5])
    return {"n_runs": len(runs), **first, "runs_sha256": digest(listed.encode()), "collapsed_sha256": digest(b" ".join(kept))}


def collapsed(batch: list[tuple[int | None, list[bytes]]]) -> list[dict]:
    """RESULT of each of the batch's (doc_id, words)."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__  # a new word gets the next number
    texts, ids = [], []
    for doc_id, words in batch:
        each = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        at = planted(doc_id, len(words))
        texts.append(words if at is None else [words[i] for i in at.tolist()])
        ids.append(each if at is None else each[at])
    owner, *columns = runs_of_documents(np.concatenate(ids), np.array([len(x) for x in ids]))
    first = np.searchsorted(owner, np.arange(len(batch) + 1)).tolist()
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    return [summary(texts[i], rows[first[i] : first[i + 1]]) for i in range(len(batch))]


def with_runs(docs: DataFrame, batch_words: int = BATCH_WORDS) -> DataFrame:
    """(doc_id, columns of RESULT) of every row of docs(doc_id, text)."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: pa.Schema | None = None
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"doc_id": d, **r} for (d, _), r in zip(held, collapsed(held), strict=True)], schema)

        for b in batches:
            schema = pa.schema([pa.field("doc_id", b.schema.field(0).type)] + [pa.field(c, pa.string() if c.endswith("256") else pa.int64()) for c in NAMES])
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                held.append((doc_id.as_py(), (text.as_py() or "").encode().split()))
                size += len(held[-1][1])
                if size >= batch_words:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return source.mapInArrow(run, f"doc_id {kind}, {RESULT}")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: one row per document."""
    return with_runs(table(spark, sf_dir, "documents"))
