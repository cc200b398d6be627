"""The pieces of a SentencePiece model as sorted hash keys, and the Viterbi step that both segmenters share.

A state is the last token of the best segmentation of a prefix, its summed score and its tokens. For a unigram model
the best is the largest sum of piece scores. A merge (BPE) model gives its pieces scores too, by which neighbours are
merged first; its result is the segmentation whose neighbouring tokens stay apart under those merges, so a pair that would
have merged across its border scores minus infinity. Whether a pair stays apart follows from the scores alone (`apart`): the
merges that made both tokens are undone from the latest on, and no merge across the border may come before the one undone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corpuslake.llm.shared import byte_column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LITERAL = "\ud800"  # no text holds this surrogate; stands for a literal U+2581, which is spelled in bytes
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BITS = 20  # of a hash, which lead to its place among the sorted keys
_SLOT_BITS = 22
UNKNOWN, START = 0, -1
LONG = 1000  # characters from which a word is stepped by itself
CELLS = 150_000  # word characters that advance together
NEVER = np.iinfo(np.int32).max
UNKNOWN_PENALTY = 10.0  # a character that is no piece costs so much more than the worst piece


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct units, unit numbers, first unit of each text and the end, bytes of the spaced texts, where each begins).

    A text is read with a space before it and cut at each run of spaces, which goes with what follows it; no piece spans
    two units. Null and empty texts have none."""
    data, offsets = byte_column(texts)
    sizes = np.diff(offsets)
    begin = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
    first = begin[:-1][sizes > 0]
    out = np.full(begin[-1], 0x20, np.uint8)
    own = np.ones(len(out), bool)
    own[first] = False
    out[own] = data[offsets[0] : offsets[-1]]
    space = out == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[first] = True
    bounds = np.append(np.flatnonzero(cut), len(out)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(bounds[:-1], begin), out, begin


def characters(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all units, how many each has); spaces as U+2581, a literal U+2581 as LITERAL."""
    strings = [k.decode("utf-8", "surrogateescape") for k in keys]
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[codes == ord(SPACE)] = ord(LITERAL)
    codes[codes == 0x20] = ord(SPACE)
    return codes, sizes


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """For rows of code points, the hash of each prefix; column 0 is the empty prefix."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    terms = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + terms[:, j]
    return out


def code_points(strings: list[str], width: int) -> np.ndarray:
    """A row for each string, filled up with zeros."""
    return np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(len(strings), width)


class Pieces:
    def __init__(self, model: str = MODEL, merges: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.n = sp.vocab_size()
        self.merges = merges
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        usual = np.array([i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))], np.int64)
        self.unknown_score = self.score[usual].min() - UNKNOWN_PENALTY
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.width = int(self.size[usual].max())
        self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.width, _BASE)]))
        self.hash = np.zeros(n, np.uint64)
        words = [self.text[i] for i in usual]
        prefixes = prefix_hashes(code_points(words, self.width))
        self.hash[usual] = prefixes[np.arange(len(words)), self.size[usual]]
        self._sort(usual)
        if merges:
            self._undo(usual, prefixes)
        self.id_of = {self.text[i]: i for i in self.ids.tolist()}
        raw = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def _sort(self, ids: np.ndarray) -> None:
        order = np.argsort(self.hash[ids])
        self.ids, self.keys = ids[order], np.append(self.hash[ids][order], np.uint64(0))
        top = (self.keys[:-1] >> np.uint64(64 - _BITS)).astype(np.int64)
        count = np.bincount(top, minlength=1 << _BITS)
        self.most = int(count.max(initial=0))
        self.first = np.where(count > 0, np.cumsum(count) - count, -1).astype(np.int32)
        if (self.keys[1:-1] == self.keys[:-2]).any():
            raise ValueError("piece hashes collide")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids) of the hashes that are pieces: the upper bits lead to the first of the sorted keys with them."""
        first = self.first[(hashes >> np.uint64(64 - _BITS)).view(np.int64)]
        place = np.flatnonzero(first >= 0)
        at, wanted = first[place], hashes[place]
        hit = self.keys[at] == wanted
        for k in range(1, self.most):
            more = np.flatnonzero(~hit & (self.keys[np.minimum(at + k, len(self.ids))] == wanted))
            at[more] += k
            hit[more] = True
        return place[hit], self.ids[at[hit]]

    def _undo(self, usual: np.ndarray, prefixes: np.ndarray) -> None:
        """For each piece the two tokens of its last merge, shorter pieces first. A piece that its own characters never
        merge into is no key."""
        single = self.size == 1
        _, order = np.unique(-self.score[usual], return_inverse=True)
        self.rank = np.full(self.n, NEVER, np.int64)
        self.rank[usual] = order + 1
        self.rank[single] = 0
        self.left, self.right = np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)
        self.slot = np.zeros(1 << _SLOT_BITS, np.uint32 if 2 * self.n * self.n + 1 < 1 << 32 else np.uint64)
        row = np.full(self.n, -1, np.int64)
        row[usual] = np.arange(len(usual))
        reached = single.copy()
        for size in range(2, self.width + 1):
            own = usual[self.size[usual] == size]
            h = prefixes[row[own]]
            for cut in range(1, size):
                left, right = np.full(len(own), -1), np.full(len(own), -1)
                place, left_id = self.find(h[:, cut])
                left[place] = left_id
                place, right_id = self.find(h[:, size] - h[:, cut] * self.powers[size - cut])
                right[place] = right_id
                fit = np.flatnonzero((left >= 0) & (right >= 0))
                fit = fit[reached[left[fit]] & reached[right[fit]]]
                limit = self.rank[own[fit]]
                fit = fit[(self.rank[left[fit]] < limit) & (self.rank[right[fit]] < limit)]
                fit = fit[self._walk(left[fit], right[fit], self.rank[own[fit]])]
                self.left[own[fit]], self.right[own[fit]] = left[fit], right[fit]
                reached[own[fit]] = True
        self._sort(usual[reached[usual]])

    def _walk(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Do tokens keep apart: at no time does a merge across their border come before `limit`, the next merge."""
        out = np.zeros(len(left), bool)
        live = np.arange(len(left))
        while len(live):
            size = self.size[left] + self.size[right]
            place, joined = self.find(np.where(size <= self.width, self.hash[left] * self.powers[np.minimum(self.size[right], self.width)] + self.hash[right], np.uint64(0)))
            go = np.ones(len(live), bool)
            go[place] = self.rank[joined] >= limit[place]
            ends = go & (self.rank[left] == 0) & (self.rank[right] == 0)
            out[live[ends]] = True
            go &= ~ends
            live, left, right = live[go], left[go], right[go]
            of_left = self.rank[left] > self.rank[right]  # the later merge is undone; of equal ones the right one
            limit = np.where(of_left, self.rank[left], self.rank[right] + 1)  # an equal merge further left comes first
            left, right = np.where(of_left, self.right[left], left), np.where(of_left, right, self.left[right])
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Do the pairs stay apart under the merges; pairs with a start or an unknown character do. Answers are
        remembered in a table of fixed size."""
        code = np.maximum(left, 0) * self.n + right
        at = ((code.astype(np.uint64) * _BASE) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)
        kept = self.slot[at]
        out = (kept & self.slot.dtype.type(1)).astype(bool)
        known = (kept >> self.slot.dtype.type(1)) == code.astype(self.slot.dtype)
        free = left <= UNKNOWN
        out[free] = True
        new = np.flatnonzero(~(known | free))
        if len(new):
            asked, inverse = np.unique(code[new], return_inverse=True)
            answer = self._walk(asked // self.n, asked % self.n, np.full(len(asked), NEVER))
            out[new] = answer[inverse]
            self.slot[at[new]] = code[new].astype(self.slot.dtype) * self.slot.dtype.type(2) + out[new]
        return out

    def step(self, hashes: np.ndarray, states: np.ndarray, last: np.ndarray, score: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """States one position on: token, its length, score, tokens. Row i has the prefix hashes of the positions up to
        the new one and the numbers of its states before it; last, score and count are by number."""
        n, j = states.shape
        reach = min(self.width, j)
        starts = hashes[:, j - reach : j] * self.powers[reach:0:-1]
        place, piece = self.find((hashes[:, j : j + 1] - starts).ravel())
        row, far = np.divmod(place, reach)
        state = states[row, j - reach + far]
        gain = score[state] + self.score[piece]
        if self.merges:
            keep = self.apart(last[state], piece)
            row, far, piece, state, gain = row[keep], far[keep], piece[keep], state[keep], gain[keep]
        before = states[:, j - 1]
        token, size = np.full(n, UNKNOWN, np.int64), np.ones(n, np.int64)
        best, total = score[before] + self.unknown_score, count[before] + 1
        if len(row):
            group = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            top = np.maximum.reduceat(gain, group)
            spread = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(row))))
            won = np.flatnonzero(gain == top[spread])
            won = won[np.concatenate([[True], spread[won][1:] != spread[won][:-1]])]  # of equal sums the longest piece
            if not self.merges:
                won = won[gain[won] > best[row[won]]]
            at = row[won]
            token[at], size[at], best[at], total[at] = piece[won], reach - far[won], gain[won], count[state[won]] + 1
        return token, size, best, total

    def long_word(self, word: str) -> list[int]:
        """Tokens of one long word (unknown characters as UNKNOWN): the same recurrence, a position at a time, which
        for a single row is cheaper than arrays of one."""
        n = len(word)
        last, size, score = [START] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        known: dict[tuple[int, int], bool] = {}
        for j in range(1, n + 1):
            best = None
            for length in range(min(self.width, j), 0, -1):
                piece = self.id_of.get(word[j - length : j])
                if piece is not None:
                    pair = (last[j - length], piece)
                    if self.merges and pair not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[pair] = bool(self.apart(np.array(pair[:1]), np.array(pair[1:]))[0])
                    gain = score[j - length] + self.score[piece]
                    if (not self.merges or known[pair]) and (best is None or gain > best):
                        best, last[j], size[j] = gain, piece, length
            unknown = score[j - 1] + self.unknown_score
            if best is None or not self.merges and unknown >= best:
                best, last[j], size[j] = unknown, UNKNOWN, 1
            score[j] = best
        out, j = [], n
        while j:
            out.append(last[j])
            j -= size[j]
        return out[::-1]

    def spelled(self, character: str) -> list[int]:
        raw = SPACE.encode() if character == LITERAL else character.encode("utf-8", "surrogateescape")
        return [self.byte_id[b] for b in raw]

    def raw_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids' bytes, one after another; where each id's end)."""
        sizes = self.raw_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.raw[np.arange(total) + np.repeat(self.raw_at[ids] - (ends - sizes), sizes)], ends
