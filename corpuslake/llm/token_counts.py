"""Token counts by trie-shared dynamic programming: the distinct pre-tokens of a batch form a trie, forward scores are
computed once for each shared prefix, level by level, and a pre-token's count stands at its last node.

The trie is two arrays over the sorted pre-tokens: the length of the prefix that a row shares with the row before says
at which depths it starts new nodes. A level's nodes advance together and read the states of the levels above it.

Defined results. Null or empty text: no pre-tokens, no tokens. The counts are those of the model's library (a literal
U+2581 counts its three byte pieces). Pre-tokens longer than `LONG` share no level; they are stepped by themselves.
A column of docs that is named like the result stays as `<name>_input`. Narrow: no shuffle, no state beyond the remembered
pre-tokens, so hot texts and repeats cost what their batch costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.pieces import MODEL, START, UNKNOWN, Pieces, characters, prefix_hashes, units
from corpuslake.llm.shared import parts_of, set_aside

LONG = 48
REMEMBERED = 600_000
NODES = 60_000  # pre-tokens of one trie


class TrieCounter:
    def __init__(self, model: str = MODEL, merges: bool = True):
        self.pieces = Pieces(model, merges)
        self.known: dict[bytes, int] = {}
        self.extra: dict[int, int] = {}

    def _spelling(self, character: int) -> int:
        """Byte pieces beyond one that a character takes if it is no piece."""
        if character not in self.extra:
            self.extra[character] = len(self.pieces.spelled(chr(character))) - 1
        return self.extra[character]

    def trie_counts(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts of distinct pre-tokens in sorted order, a row of code points each, filled up with zeros."""
        n, width = codes.shape
        hashes = prefix_hashes(codes)
        differs = np.concatenate([codes[1:] != codes[:-1], np.ones((n - 1, 1), bool)], axis=1)
        shared = np.concatenate([[0], np.minimum(np.argmax(differs, axis=1), np.minimum(sizes[1:], sizes[:-1]))])
        node = np.zeros((n, width + 1), np.int64)  # row, depth -> number of its node; node 0 is the root
        starts = (sizes[:, None] > np.arange(width)) & (shared[:, None] <= np.arange(width))  # does the row start a node
        ends = np.cumsum(starts.sum(axis=0))
        nodes = 1 + int(ends[-1])
        last, score, count = np.full(nodes, START, np.int64), np.zeros(nodes), np.zeros(nodes, np.int64)
        out = np.zeros(n, np.int64)
        for depth in range(1, width + 1):
            base = 1 + (int(ends[depth - 2]) if depth > 1 else 0)
            first = np.flatnonzero(starts[:, depth - 1])  # the rows that start this level's nodes
            node[:, depth] = base - 1 + np.cumsum(starts[:, depth - 1])
            token, size, best, total = self.pieces.step(hashes[first, : depth + 1], node[first, :depth], last, score, count)
            for k in np.flatnonzero(token == UNKNOWN):
                total[k] += self._spelling(int(codes[first[k], depth - 1]))
            to = slice(base, base + len(first))
            last[to], score[to], count[to] = token, best, total
            done = np.flatnonzero(sizes == depth)
            out[done] = count[node[done, depth]]
        return out

    def _long(self, word: str) -> int:
        tokens = self.pieces.long_word(word)
        at = np.cumsum([0] + [1 if t == UNKNOWN else int(self.pieces.size[t]) for t in tokens])
        return len(tokens) + sum(self._spelling(ord(word[i])) for t, i in zip(tokens, at) if t == UNKNOWN)

    def learn(self, words: list[bytes]) -> None:
        """UTF-8 sorts as its code points do, so sorted bytes are a trie's order."""
        words = sorted(words)
        codes, sizes = characters(words)
        begin = np.cumsum(sizes) - sizes
        short = np.flatnonzero(sizes <= LONG)
        for i in range(0, len(short), NODES):
            part = short[i : i + NODES]
            at = np.arange(int(sizes[part].max()))[None, :]
            own = codes[np.minimum(begin[part][:, None] + at, len(codes) - 1)]
            own[at >= sizes[part][:, None]] = 0
            self.known.update(zip(map(words.__getitem__, part.tolist()), self.trie_counts(own, sizes[part]).tolist()))
        for k in np.flatnonzero(sizes > LONG).tolist():
            self.known[words[k]] = self._long("".join(map(chr, codes[begin[k] : begin[k] + sizes[k]].tolist())))

    def count(self, texts: pa.Array) -> np.ndarray:
        distinct, number, begin, _, _ = units(texts)
        words = distinct.to_pylist()
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        if new:
            self.learn(new)
        each = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[number]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[begin])


@lru_cache(maxsize=2)
def of_worker(model: str = MODEL, merges: bool = True) -> TrieCounter:
    """One counter for each Python worker, which remembers pre-tokens from task to task."""
    return TrieCounter(model, merges)


def _count_task(model: str, merges: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = of_worker(model, merges)
        for batch in batches:
            at = batch.num_columns - 1
            counts = np.concatenate([np.zeros(0, np.int64), *[counter.count(part.column(at)) for part in parts_of(batch, at)]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], schema=pa.schema([*list(batch.schema)[:-1], pa.field("n_tokens", pa.int64())]))

    return count


def with_token_counts(docs: DataFrame, text: str = "text", count_as: str = "n_tokens", model: str = MODEL, merges: bool = True) -> DataFrame:
    """docs with the number of tokens of each text."""
    docs, (text,) = set_aside(docs, (count_as,), (text,))
    others = [f"c{i}" for i in range(len(docs.columns))]
    read = docs.toDF(*others).withColumn("body", F.col(others[docs.columns.index(text)]))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    return read.mapInArrow(_count_task(model, merges), schema).toDF(*docs.columns, count_as)


def totals(counted: DataFrame, by: str, count: str = "n_tokens") -> DataFrame:
    """Tokens and documents of each group; added up in each task before the shuffle."""
    return counted.groupBy(by).agg(F.sum(count).alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "n_tokens")
