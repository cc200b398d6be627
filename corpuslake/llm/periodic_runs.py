"""Periodic runs of words, found by internal pattern matching.

The words of a slice of documents are ranked by prefix doubling: `levels[k]` ranks the block of 2^k words at each place,
equal for equal blocks of one document, and the last order is the suffix array. A wavelet matrix over the suffix array
answers, for all blocks of a level at once, how many occurrences of a block lie below a place and which is the next one.

A run of period q holds a block of m = 2^k words (m <= q < 2m) that begins at a multiple of m and occurs again q words on.
So each such block asks for its occurrences that begin m to 2m - 1 words later. These form one arithmetic progression: one
or two occurrences are candidate distances as they stand; three or more have the block's own period d as their difference,
and the only candidate is then the distance between the ends of the two stretches of period d. Periods of 1 ask with m = 2.
Common prefixes of the levels extend each candidate to both sides; the least period of equal stretches is the run's.

Everything is done by numpy over slices of whole documents in one narrow pass: no shuffle, memory in proportion to a
slice, or to the longest text.

Defined results. Null and empty texts and texts without words: no words, no runs, four nulls, hashes of the empty string. A
null id is not damaged. Repeated rows give repeated rows. Texts of any length are used whole. Other columns are not read
by the query; `runs` takes any key column.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.shared import parts_of

LEAST_LENGTH, LEAST_POWER = 6, 4
SLICE_BYTES = 2 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, offsets of each text's words): words are what lies between the characters 0x20 and 0x09 to 0x0D."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    ends = lists.offsets.to_numpy().astype(np.int64)
    return flat.filter(pa.array(real)), before[ends - ends[0]]


class Matcher:
    """Ranks of blocks by level, suffix array and wavelet matrix over documents of words given as numbers."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        n = self.n = len(words)
        sizes = np.diff(offsets)
        self.document = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.end = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
        key = self.document * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = _starts(key[order], np.arange(n))
        self.levels = [rank]
        slots = _shared(rank[order], np.arange(n))  # places of the suffix array that hold repeated blocks
        self.slots = slots
        size = 1
        while len(slots):
            at = order[slots]
            far = at + size
            second = np.where(far < self.end[at], rank[np.minimum(far, n - 1)] + 1, 0)
            both = rank[at] * (n + 1) + second
            deal = np.argsort(both, kind="stable")
            order[slots] = at = at[deal]
            rank = rank.copy()
            rank[at] = _starts(both[deal], slots)
            self.levels.append(rank)
            slots = _shared(rank[at], slots)
            if size == 1:
                self.slots = slots  # only blocks of two words and more are asked for
            size *= 2
        held = np.zeros(n + 1, np.int64)
        held[self.slots] = 1
        self.dense = np.concatenate([[0], np.cumsum(held[:-1])])  # place of the suffix array -> place among repeated ones
        self._wavelet(order[self.slots])

    def _wavelet(self, values: np.ndarray) -> None:
        self.bits = max(1, int(self.n).bit_length())
        self.zeros = []
        for b in reversed(range(self.bits)):
            one = (values >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are less than bound (at most n)."""
        out = np.zeros(len(lo), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros):
            lo0, hi0 = zeros[lo], zeros[hi]
            one = (bound >> b) & 1 == 1
            out += np.where(one, hi0 - lo0, 0)
            lo = np.where(one, zeros[-1] + lo - lo0, lo0)
            hi = np.where(one, zeros[-1] + hi - hi0, hi0)
        return out

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value that k others in [lo, hi) are less than; with k = below(bound) the range successor of bound."""
        out = np.zeros(len(lo), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros):
            lo0, hi0 = zeros[lo], zeros[hi]
            one = k >= hi0 - lo0
            k = np.where(one, k - (hi0 - lo0), k)
            out |= np.where(one, 1 << b, 0)
            lo = np.where(one, zeros[-1] + lo - lo0, lo0)
            hi = np.where(one, zeros[-1] + hi - hi0, hi0)
        return out

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that are equal from a and from b > a on; b may be the end of its document."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = a + out, b + out
            same = (y < self.n) & (self.levels[k][x] == self.levels[k][np.minimum(y, self.n - 1)])
            out += np.where(same, 1 << k, 0)
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that are equal before a and before b > a."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = a - out - (1 << k), b - out - (1 << k)
            same = (x >= 0) & (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)])
            out += np.where(same, 1 << k, 0)
        return out

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period): each run's period stands beside a place from which it goes on for a block at least."""
        found = []
        for k in range(1, len(self.levels)):
            m, rank = 1 << k, self.levels[k]
            count = np.bincount(rank, minlength=self.n)
            at = np.flatnonzero(count[rank] > 1)
            at = at[(at - self.first[at]) % m == 0]
            if not len(at):
                continue
            lo = self.dense[rank[at]]
            hi = self.dense[rank[at] + count[rank[at]]]
            if k == 1:
                near = rank[at] == rank[np.minimum(at + 1, self.n - 1)]
                found.append((at[near & (at + 1 < self.n)], np.ones(int((near & (at + 1 < self.n)).sum()), np.int64)))
            low = self.below(lo, hi, np.minimum(at + m, self.n))
            many = self.below(lo, hi, np.minimum(at + 2 * m, self.n)) - low
            some = many > 0
            at, lo, hi, low, many = at[some], lo[some], hi[some], low[some], many[some]
            one = self.nth(lo, hi, low)
            found.append((at[many < 3], (one - at)[many < 3]))
            pair = many > 1
            at, lo, hi, low, many, one = at[pair], lo[pair], hi[pair], low[pair], many[pair], one[pair]
            two = self.nth(lo, hi, low + 1)
            found.append((at[many == 2], (two - at)[many == 2]))
            more = many > 2
            at, one, own = at[more], one[more], (two - one)[more]
            stretch = self.ahead(at + m - own, at + m), self.ahead(one + m - own, one + m)
            found.append((at, one + stretch[1] - at - stretch[0]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([q for _, q in found])

    def runs(self) -> np.ndarray:
        """Rows (document, start, end, period), starts and ends as places of all words, by start and then period."""
        at, period = self.candidates()
        inside = (period > 0) & (at + period < self.end[at])
        at, period = at[inside], period[inside]
        start = at - self.behind(at, at + period)
        end = at + period + self.ahead(at, at + period)
        held = end - start >= np.maximum(LEAST_LENGTH, LEAST_POWER * period)
        start, end, period = start[held], end[held], period[held]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        return np.column_stack([self.document[start[order]], start[order], end[order], period[order]])


def _starts(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted keys: the place of the first of each one's equals."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return places[new][np.cumsum(new) - 1]


def _shared(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places whose rank, in order, stands more than once."""
    same = np.zeros(len(ranks), bool)
    same[1:] = ranks[1:] == ranks[:-1]
    same[:-1] |= same[1:]
    return places[same]


def damage(key, n: int) -> tuple[int, int] | None:
    """(a, p) of the rule that makes a tenth of the documents periodic, for the decimal id and a number of words."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start: long, length: long, period: long>>"


def _digest(runs: list[tuple[int, int, int]]) -> tuple:
    if not runs:
        return None, None, None, None
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:  # by start and then period already, so the first of equals stays
            best = r
    return *best, 1000 * best[1] // best[2]


def _found(part: pa.RecordBatch, rule: Callable | None, full: bool) -> list[pa.Array]:
    flat, offsets = split_words(part.column(1))
    source = np.arange(len(flat))
    if rule:
        for i, key in enumerate(part.column(0).to_pylist()):
            change = rule(key, int(offsets[i + 1] - offsets[i]))
            if change:
                low = offsets[i] + change[0]
                source[low : offsets[i + 1]] = low + np.arange(offsets[i + 1] - low) % change[1]
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[source]
    matcher = Matcher(codes, offsets)
    table = matcher.runs()
    drop = np.zeros(len(flat) + 1, np.int64)
    np.add.at(drop, table[:, 1] + table[:, 3], 1)
    np.add.at(drop, table[:, 2], -1)
    kept = np.cumsum(drop[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(source[kept]))), pa.scalar(" ", pa.large_string()))
    lists: list[list] = [[] for _ in range(part.num_rows)]
    for d, s, e, q in table.tolist():
        lists[d].append((s - int(offsets[d]), e - s, q))
    best = [_digest(r) for r in lists]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = [pa.array([len(r) for r in lists], pa.int64())]
    out += [pa.array([b[k] for b in best], pa.int64()) for k in range(4)]
    out += [pa.array([sha("".join(f"{s},{n},{q}\n" for s, n, q in r)) for r in lists], pa.string())]
    out += [pa.array([hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in texts], pa.string())]
    if full:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        out += [texts.cast(pa.string()), pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in lists], kind)]
    return out


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Callable | None = None, full: bool = True) -> DataFrame:
    """(key, number of runs, the run of greatest length by period, digests); with `full` also the collapsed text, in which
    each run keeps its first period, and all runs. rule: (key, number of words) -> (a, p) lets word i >= a become word
    a + (i - a) % p first, or None."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {RESULT if full else RESULT.rsplit(', collapsed string', 1)[0]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, SLICE_BYTES):
                columns = _found(part, rule, full)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, *[c.split(" ")[0] for c in NAMES[: len(columns)]]])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", "runs")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rule=damage, full=False)
