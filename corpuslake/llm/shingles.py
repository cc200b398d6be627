"""Word shingles of texts as numbers, and MinHash signatures of their sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x2545F4914F6CDD1D
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(CHUNK + 1, base, np.uint64), np.full(CHUNK + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers()
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_hashes(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of a body of at most CHUNK bytes."""
    space = _IS_SPACE[body]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_OF_BYTE[body] * _UP[: len(body)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64) * _M1)


def _long_word_hashes(body: np.ndarray) -> np.ndarray:
    """Hashes of the words of a longer body: cut at spaces; a word that is longer than a chunk is hashed by parts."""
    out, at = [], 0
    while at < len(body):
        end = min(len(body), at + CHUNK)
        if end < len(body):
            spaces = np.flatnonzero(_IS_SPACE[body[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # inside a word that fills the chunk
                rest = np.flatnonzero(_IS_SPACE[body[end:]])
                stop = end + int(rest[0]) if len(rest) else len(body)
                part = np.uint64(0)
                for i in range(at, stop, CHUNK):
                    part = mix(np.array([part]) * _M1 + _word_hashes(body[i : min(stop, i + CHUNK)])[1])[0]
                out.append(np.array([part]))
                at = stop
                continue
        out.append(_word_hashes(body[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words_by_text(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text, A-Z lower-cased; short texts are hashed many at a time."""
    sizes = np.diff(offsets)
    row = 0
    while row < len(sizes):
        if sizes[row] >= CHUNK:
            yield row, _long_word_hashes(_LOWER[data[offsets[row] : offsets[row + 1]]])
            row += 1
            continue
        stop, full = row, 0
        while stop < len(sizes) and full + sizes[stop] + 1 <= CHUNK:
            full += int(sizes[stop]) + 1
            stop += 1
        body = np.full(full, 0x20, np.uint8)
        begin = np.zeros(stop - row + 1, np.int64)
        begin[1:] = np.cumsum(sizes[row:stop] + 1)
        for i in range(row, stop):
            body[begin[i - row] : begin[i - row] + sizes[i]] = data[offsets[i] : offsets[i + 1]]
        start, hashes = _word_hashes(_LOWER[body])
        cut = np.searchsorted(start, begin)
        for i in range(row, stop):
            yield i, hashes[cut[i - row] : cut[i - row + 1]]
        row = stop


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of `size` words, sorted; fewer words are one shingle; none, none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    acc = words[:n].copy()
    for k in range(1, min(size, len(words))):
        acc = mix(acc * _M1 + words[k : k + n])
    if len(words) < size:  # never equal to a shingle of `size` words
        acc = mix(acc * _M3 + np.uint64(len(words)))
    return np.unique(acc)


class Permutations:
    """Random affine maps of 64-bit numbers, fixed by the seed."""

    def __init__(self, n: int, seed: int = 20240501):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """For each map the least image, its upper 32 bits."""
        least = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(shingles), 2048):
            part = shingles[i : i + 2048]
            np.minimum(least, (part[:, None] * self.a + self.b).min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)
