"""Burrows-Wheeler transforms of sets of short byte strings and their merge by interleave refinement.

The alphabet is blocks of eight bytes: a string is read as eight interleaved strings, one for each residue of the
position, so that every byte position starts a suffix and 25 symbols compare 200 bytes. Strings belong to groups;
a suffix is only ever compared with suffixes of its own group.

`Shard` holds one shard's transform: rows are the shard's suffixes in sorted order, `bwt` the symbol before each
suffix, `lf` the row of the suffix that starts with that symbol, `twin` whether the suffix shares DEPTH symbols
with another suffix of the shard (from the common prefixes found while the shard was sorted).

`merge` interleaves the rows of all shards. Round h turns the interleave that is right for the first h - 1
symbols into the one for h symbols: the rows are read in their present order and dealt stably by their `bwt`
symbol to the rows that `lf` names. Rows whose h-symbol prefix occurs in one shard only are settled - the shard's
own transform answers for them - and leave the round, so no suffix is sorted again. What is left after DEPTH rounds
are the repeated intervals that cross shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANE = 8
DEPTH = 25
SPAN = LANE * DEPTH


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    n = len(data) - LANE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for o in range(min(LANE, n)):
        count = (n - o + LANE - 1) // LANE
        out[o::LANE] = data[o : o + LANE * count].view(np.uint64)
    return out


def dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 0 of the values, equal for equal values, and how many there are."""
    if not len(key):
        return np.zeros(0, np.int64), 0
    bits = np.uint64(int(len(key)).bit_length())
    if int(key.max()) >> (64 - int(bits)) == 0:  # value and place fit in one word, which sorts faster than by index
        packed = (key.astype(np.uint64) << bits) | np.arange(len(key), dtype=np.uint64)
        packed.sort()
        order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        at = packed >> bits
    else:
        order = np.argsort(key)
        at = key[order]
    step = np.zeros(len(key), np.int64)
    np.cumsum(at[1:] != at[:-1], out=step[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return rank, int(step[-1]) + 1


@dataclass
class Shard:
    sa: np.ndarray  # row -> suffix: position in the concatenated strings, one more than the bytes for each string
    bwt: np.ndarray  # row -> rank of the symbol before it; -1 at the start of a string
    lf: np.ndarray  # row -> row of the suffix one symbol longer; -1 likewise
    depth: np.ndarray  # row -> whole symbols from there to the end of its string, at most DEPTH
    group: np.ndarray  # row -> group
    twin: np.ndarray  # row -> does another row share DEPTH symbols


def suffix_places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings of these sizes, with a suffix at each position and at the end: string and offset of each suffix."""
    rows = sizes + 1
    string = np.repeat(np.arange(len(sizes)), rows)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(rows) - rows, rows)
    return string, offset


def build(symbols: np.ndarray, sizes: np.ndarray, groups: np.ndarray, n_symbols: int) -> Shard:
    """Transform of one shard. symbols: rank of the eight bytes at each suffix (any value where fewer are left)."""
    string, offset = suffix_places(sizes)
    left = (sizes[string] - offset) // LANE
    n = len(string)
    group = groups[string]
    rank, _ = dense(group * (n_symbols + 1) + np.where(left > 0, symbols + 1, 0))
    have, known = 1, {1: rank}

    def joined(a: np.ndarray, size: int, b: np.ndarray) -> np.ndarray:
        far = np.arange(n) + LANE * size
        inside = offset + LANE * size <= sizes[string]
        tail = np.zeros(n, np.int64)
        tail[inside] = b[far[inside]] + 1
        return dense(a * (n + 2) + tail)[0]

    while have * 2 <= DEPTH:
        rank = joined(rank, have, rank)
        have *= 2
        known[have] = rank
    for size in sorted(known, reverse=True):
        if have + size <= DEPTH:
            rank = joined(rank, have, known[size])
            have += size
    sa = np.argsort(rank, kind="stable")
    sorted_rank = rank[sa]
    same = sorted_rank[1:] == sorted_rank[:-1]
    twin = np.zeros(n, bool)
    twin[1:] |= same
    twin[:-1] |= same
    row_of = np.empty(n, np.int64)
    row_of[sa] = np.arange(n)
    first = offset[sa] < LANE
    before = np.where(first, 0, sa - LANE)
    bwt = np.where(first, -1, symbols[before])
    lf = np.where(first, -1, row_of[before])
    return Shard(sa, bwt, lf, np.minimum(left[sa], DEPTH), group[sa], twin & (left[sa] >= DEPTH))


def merge(shards: list[Shard]) -> list[np.ndarray]:
    """For each shard: which of its rows share DEPTH symbols with a row of another shard."""
    base = np.cumsum([0] + [len(s.sa) for s in shards])
    owner = np.repeat(np.arange(len(shards), dtype=np.int8), np.diff(base))
    bwt = np.concatenate([s.bwt for s in shards]).astype(np.int32)
    lf = np.concatenate([np.where(s.lf < 0, -1, s.lf + b) for s, b in zip(shards, base)]).astype(np.int32)
    # symbols from the row's longer suffix to the end of its string; 0 where there is none
    reach = np.concatenate([np.where(s.lf < 0, 0, s.depth[s.lf]) for s in shards]).astype(np.int8)
    group = np.concatenate([s.group for s in shards]).astype(np.int32)

    rows = np.argsort(group, kind="stable").astype(np.int32)  # no symbol compared yet: groups, then shards, then each shard's order
    rows, block = _crossing(rows, group[rows], owner)
    low = np.uint64(0xFFFFFFFF)
    for h in range(1, DEPTH + 1):
        going = reach[rows] >= h
        rows, block = rows[going], block[going]
        if not len(rows):
            break
        packed = (bwt[rows].astype(np.uint64) << np.uint64(32)) | np.arange(len(rows), dtype=np.uint64)
        packed.sort()
        deal = (packed & low).astype(np.int32)
        packed >>= np.uint64(32)
        block = block[deal]
        new = np.ones(len(rows), bool)
        new[1:] = (packed[1:] != packed[:-1]) | (block[1:] != block[:-1])
        rows, block = _crossing(lf[rows[deal]], np.cumsum(new, dtype=np.int32), owner)
    found = np.zeros(base[-1], bool)
    found[rows] = True
    return [found[a:b] for a, b in zip(base[:-1], base[1:])]


def _crossing(rows: np.ndarray, block: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of blocks that hold rows of two or more shards."""
    if not len(rows):
        return rows, block
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    own = owner[rows]
    cross = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
    keep = np.repeat(cross, np.diff(np.append(starts, len(rows))))
    return rows[keep], block[keep]


def repeated_starts(strings: list[bytes], groups: np.ndarray, starts: np.ndarray, shard_of: np.ndarray) -> list[np.ndarray]:
    """For strings with starts[i] windows each (string i has starts[i] + SPAN - 1 bytes): which windows occur in
    another place of the same group. Transforms are built shard by shard and then merged."""
    out: list[np.ndarray] = [np.zeros(k, bool) for k in starts]
    shards, members = [], []
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)  # one more place a string, as suffix_places has
    sizes = np.array([len(s) for s in strings], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols, n_symbols = dense(np.append(lanes(data), np.zeros(min(LANE - 1, len(data)), np.uint64)))
    for k in np.unique(shard_of):
        ids = np.flatnonzero(shard_of == k)
        own = np.concatenate([symbols[at[i] : at[i + 1]] for i in ids])
        shards.append(build(own, sizes[ids], groups[ids], n_symbols))
        members.append(ids)
    for shard, crossing, ids in zip(shards, merge(shards), members):
        hit = np.zeros(len(shard.sa), bool)
        hit[shard.sa] = shard.twin | crossing
        place = 0
        for i in ids:
            out[i] = hit[place : place + starts[i]].copy()
            place += sizes[i] + 1
    return out
