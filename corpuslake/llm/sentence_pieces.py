"""SentencePiece encoding and decoding by a batched numpy Viterbi: words of equal length advance together, substring
hashes probe the sorted piece keys, and vectorised maxima store the backpointers.

A word is a run of spaces with the characters after it; no piece spans two words, so a text's tokens are the
concatenation of its words' tokens, and a word is encoded once for as long as a worker remembers it. The ids are those
of the model's own library, which is not asked; decode(encode(text)) gives the text back, byte for byte.

Defined results. Null or empty text: no ids. Characters that are no piece are spelled in byte pieces; so is a literal
U+2581, which the library would turn into a space. Very long words take one step a character. Rows are answered by
themselves, so repeats do not matter. A column of docs that is named like a result stays as `<name>_input`. The model's
path is a parameter; every executor needs the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.pieces import CELLS, LONG, MODEL, START, UNKNOWN, Pieces, characters, prefix_hashes, units
from corpuslake.llm.shared import give_back, parts_of, set_aside

REMEMBERED = 1_200_000


class Growing:
    """An array that takes more at its end; its room doubles."""

    def __init__(self, dtype, *first):
        self.room, self.n = np.zeros(1 << 16, dtype), 0
        self.add(np.array(first, dtype))

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(max(len(self.room), len(more)), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    def __init__(self, model: str = MODEL, merges: bool = True):
        self.pieces = Pieces(model, merges)
        self.forget()

    def forget(self) -> None:
        """Word -> place; the word at a place has its ids in flat[start[place] : start[place + 1]]."""
        self.place: dict[bytes, int] = {}
        self.start, self.flat = Growing(np.int64, 0), Growing(np.int32)

    def _equal(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each has) of words of one length, a row of code points each."""
        n, size = codes.shape
        if size >= LONG:
            rows = [self._spelled(w, np.array(self.pieces.long_word("".join(map(chr, w.tolist()))), np.int64)) for w in codes]
            return np.concatenate(rows), np.array([len(x) for x in rows])
        hashes = prefix_hashes(codes)
        # state j * n + i: word i up to its character j
        last, score, count = np.full((size + 1) * n, START, np.int64), np.zeros((size + 1) * n), np.zeros((size + 1) * n, np.int64)
        lengths = np.zeros((size + 1) * n, np.int64)
        numbers = np.arange(n)[:, None] + np.arange(size)[None, :] * n
        for j in range(1, size + 1):
            to = slice(j * n, (j + 1) * n)
            last[to], lengths[to], score[to], count[to] = self.pieces.step(hashes[:, : j + 1], numbers[:, :j], last, score, count)
        total = count[size * n :]
        out = np.full((n, size), -1, np.int32)
        at, live, spot = np.full(n, size), np.arange(n), total.copy()
        while len(live):
            state = at[live] * n + live
            spot[live] -= 1
            out[live, spot[live]] = last[state]
            at[live] -= lengths[state]
            live = live[at[live] > 0]
        odd = np.flatnonzero((out == UNKNOWN).any(axis=1))
        if not len(odd):
            return out[out >= 0], total
        rows = [x[x >= 0] for x in out]
        for i in odd:
            rows[i] = self._spelled(codes[i], rows[i])
        return np.concatenate(rows), np.array([len(x) for x in rows])

    def _spelled(self, word: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        ids, at = [], 0
        for t in tokens.tolist():
            if t == UNKNOWN:
                ids += self.pieces.spelled(chr(word[at]))
                at += 1
            else:
                ids.append(t)
                at += int(self.pieces.size[t])
        return np.array(ids, np.int32)

    def learn(self, words: list[bytes]) -> None:
        codes, sizes = characters(words)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(sizes[order])) + 1, [len(order)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            size = int(sizes[order[a]])
            for i in range(a, b, max(1, CELLS // size)):
                same = order[i : min(b, i + max(1, CELLS // size))]
                ids, count = self._equal(codes[begin[same][:, None] + np.arange(size)[None, :]])
                place = len(self.place)
                self.place.update(zip(map(words.__getitem__, same.tolist()), range(place, place + len(same))))
                self.start.add(self.flat.n + np.cumsum(count))
                self.flat.add(ids)

    def encode_flat(self, texts: pa.Array, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where each text's begin, and the end; do they decode to the text)."""
        distinct, number, begin, body, at = units(texts)
        words = distinct.to_pylist()
        if len(self.place) + len(words) > remembered:
            self.forget()
        new = [w for w in words if w not in self.place]
        if new:
            self.learn(new)
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[number]
        sizes = self.start.room[place + 1] - self.start.room[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat.room[np.arange(ends[-1]) + np.repeat(self.start.room[place] - ends[:-1], sizes)]
        first = ends[begin]
        return ids, first, self._gives(ids, first, body, at)

    def _gives(self, ids: np.ndarray, first: np.ndarray, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Are the ids' bytes those of the spaced texts."""
        raw, ends = self.pieces.raw_bytes(ids)
        own = np.concatenate([[0], ends])[first]
        if np.array_equal(own, at) and np.array_equal(raw, body):
            return np.ones(len(at) - 1, bool)
        return np.array([np.array_equal(raw[a:b], body[c:d]) for a, b, c, d in zip(own[:-1], own[1:], at[:-1], at[1:])], bool)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, begin, _ = self.encode_flat(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(begin[:-1], begin[1:])]

    def decode(self, ids) -> str:
        raw = self.pieces.raw_bytes(np.asarray(ids, np.int64))[0].tobytes()
        return raw[1:].decode("utf-8", "surrogateescape")


@lru_cache(maxsize=2)
def of_worker(model: str = MODEL, merges: bool = True) -> Encoder:
    """One encoder for each Python worker, which remembers words from task to task."""
    return Encoder(model, merges)


def _encode_task(model: str, merges: bool, remembered: int, keep: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_worker(model, merges)
        for batch in batches:
            schema = pa.schema([*list(batch.schema)[:-1], pa.field("ids", pa.list_(pa.int32())), pa.field("round_trip", pa.bool_())])
            for part in parts_of(batch, batch.num_columns - 1):
                ids, begin, same = coder.encode_flat(part.column(part.num_columns - 1), remembered)
                column = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column, pa.array(same, pa.bool_())], schema=schema)
        if not keep:
            coder.forget()
            give_back()

    return encode


def encoded(docs: DataFrame, text: str = "text", ids_as: str = "ids", check_as: str = "round_trip", model: str = MODEL, merges: bool = True, remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """The columns of docs, the token ids, and whether decoding them gives the text back. Narrow.

    `remembered` bounds the words that a worker holds; without `keep` it lets go of them when its task ends, for jobs
    whose workers have other stages to serve."""
    docs, (text,) = set_aside(docs, (ids_as, check_as), (text,))
    others = [f"c{i}" for i in range(len(docs.columns))]
    read = docs.toDF(*others).withColumn("body", F.col(others[docs.columns.index(text)]))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return read.mapInArrow(_encode_task(model, merges, remembered, keep), schema).toDF(*docs.columns, ids_as, check_as)


def decoder(model: str = MODEL):
    """A column function: array of ids -> text."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = of_worker(model)
        for series in batches:
            yield pd.Series([None if x is None else coder.decode(list(x)) for x in series], dtype=object)

    return decode


def decoded(tokens: DataFrame, ids: str = "ids", text_as: str = "text", model: str = MODEL) -> DataFrame:
    tokens, (ids,) = set_aside(tokens, (text_as,), (ids,))
    column: Column = decoder(model)(F.col(f"`{ids}`"))
    return tokens.withColumn(text_as, column)


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
