"""Product-quantised index (V4): a query reads codes of its lists, and exact vectors of its best codes only.

Coarse centroids and, for each of `parts` subspaces, a codebook of at most 256 entries over the residuals are fitted on a
bounded sample. Every row with a vector is a code of `parts` bytes in the list of its nearest centroid. The inner product of a query
with a row is that with the centroid plus one entry of the query's distance table for each byte. The rows with the best sums
are scored again on their exact vectors.

How many lists are probed and how many rows are scored again is measured for the wanted recall: at most ASKED sample rows, on which
nothing was fitted, against the exact search over all rows. The index is a Parquet table, dealt by list; long lists are split.
A list's codes pass to a task once and the queries that ask for it follow; what the sample shows to be too far for a query is not passed on.
Rows and queries without a vector are in no result. Equal distances go by the least id. Without rows nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.search import ASKED, _unit, held_out, nearest, with_vectors
from corpuslake.sources.tables import new_path

CODE_BLOCK = 16_384  # codes a block
QUERY_PART = 128  # queries in one table of sums
SAMPLE = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    """List column -> unit vectors."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False), len(column)) if len(column) else np.zeros((0, 1))


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row, the centre at least Euclidean distance; rows in pieces of bounded size."""
    half = 0.5 * (centres**2).sum(axis=1)
    step = max(1, (1 << 22) // max(1, len(centres)))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, n: int, rounds: int) -> np.ndarray:
    centres = x[:n].copy()
    for _ in range(rounds):
        near = _near(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centres))
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


class Quantiser:
    """Centroids, codebooks and what they cost in recall, from sample vectors."""

    def __init__(self, x: np.ndarray, n_rows: int, parts: int, recall: float, k: int, rounds: int = 8):
        self.width = x.shape[1]
        self.parts = min(parts, self.width)
        self.cuts = np.linspace(0, self.width, self.parts + 1).astype(int)
        fitted = x[min(ASKED, len(x) // 4) :]  # the others measure
        self.centres = _means(fitted, max(1, min(int(4 * n_rows**0.5), len(fitted) // 32)), rounds)
        self.books: list[np.ndarray] = []
        rest = fitted - self.centres[_near(fitted, self.centres)]
        for a, b in zip(self.cuts, self.cuts[1:]):
            self.books.append(_means(np.ascontiguousarray(rest[:, a:b]), min(256, len(fitted)), rounds))
        self._measure(x, recall, k)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _near(x, self.centres)
        rest = x - self.centres[lists]
        return lists, np.column_stack([_near(np.ascontiguousarray(rest[:, a:b]), book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]).astype(np.uint8).reshape(len(x), self.parts)

    def sums(self, q: np.ndarray, lists: np.ndarray | int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries by rows: a distance table for each query and subspace, looked up by the codes."""
        out = np.broadcast_to((q @ self.centres.T)[:, np.broadcast_to(lists, len(codes))], (len(q), len(codes))).astype(np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            table = (q[:, a:b] @ book.T).astype(np.float32)
            out += table[:, codes[:, m]]
        return out

    def _measure(self, x: np.ndarray, recall: float, k: int) -> None:
        """Lists to probe and share of rows to score again, on the sample. Each loses half of what the recall leaves."""
        asked = x[: min(ASKED, len(x) // 4) or len(x)]
        exact = np.round(asked @ x.T, 9)  # equal vectors stay in one order, whatever the last bits of their products
        top = np.argsort(-exact, axis=1, kind="stable")[:, : min(k, len(x))]
        self.listed, self.codes = lists, codes = self.encode(x)
        self.keep = 1 - (1 - recall) / 2
        self.probes = self.quantile(np.take_along_axis(self.places(asked), lists[top], axis=1)) + 1
        approximate = self.sums(asked, lists, codes)
        place = np.argsort(np.argsort(-approximate, axis=1, kind="stable"), axis=1)
        self.share = (self.quantile(np.take_along_axis(place, top, axis=1)) + 1) / len(x)

    def quantile(self, v: np.ndarray) -> int:
        return int(np.sort(v.ravel())[min(v.size - 1, int(np.ceil(self.keep * v.size)))])

    def places(self, q: np.ndarray) -> np.ndarray:
        """Queries by lists: the list's place among the nearest."""
        return np.argsort(np.argsort(-(q @ self.centres.T), axis=1, kind="stable"), axis=1)

    def cut(self, q: np.ndarray, again: int, n_rows: int) -> np.ndarray:
        """Of each query, a sum that more than `again` of the n_rows reach, by the sample's codes: well above what is needed."""
        mean = again * len(self.codes) / max(1, n_rows)
        place = int(np.ceil(mean + 4 * mean**0.5)) + 4
        if place >= len(self.codes):
            return np.full(len(q), -np.inf)
        return np.concatenate([np.partition(-self.sums(q[i : i + QUERY_PART], self.listed, self.codes), place, axis=1)[:, place] for i in range(0, len(q), QUERY_PART)] or [np.zeros(0)]).astype(np.float64) * -1 - 2e-5


class QuantisedIndex:
    def __init__(self, chunks: DataFrame, doc_id: str = "doc_id", vector: str = "embedding", parts: int = 16, recall: float = 0.94, k: int = 15, sample: int = SAMPLE):
        self.doc_id, self.vector, self.k = doc_id, vector, k
        self.vectors = with_vectors(chunks, doc_id, vector)
        self.spark = chunks.sparkSession
        self.n = self.vectors.count()
        rows = self._sample(sample)
        if not rows:
            self.model = None
            return
        self.model = Quantiser(_unit(np.array([r["v"] for r in rows]), len(rows)), self.n, parts, recall, k)
        kind = self.vectors.schema["k"].dataType.simpleString()
        model = self.model

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, codes = model.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["k", "list", "code"])

        path = new_path(self.spark, "quantised")
        coded = self.vectors.mapInArrow(encode, f"k {kind}, list int, code binary")
        coded.hint("rebalance", "list").sortWithinPartitions("list").write.parquet(path)
        self.codes = self.spark.read.schema(coded.schema).parquet(path)
        self._measure(held_out(rows)[0])

    def _measure(self, asked: list) -> None:
        """Lists to probe and rows to score again, by the exact neighbours of the asked among all rows: counts, no shares, so that
        they do not grow as the table does."""
        model = self.model
        exact = nearest(self.spark.createDataFrame(asked, self.vectors.schema), self.vectors, self.k, "k", "k", "v")
        found = exact.join(self.codes.select(F.col("k").alias("doc_id"), "list", "code"), "doc_id").select("query_id", "list", "code").collect()  # k rows a query of at most ASKED
        q, of = _unit(np.array([r["v"] for r in asked]), len(asked)), {r["k"]: i for i, r in enumerate(asked)}
        row = np.array([of[r["query_id"]] for r in found])
        lists, codes = np.array([r["list"] for r in found]), np.frombuffer(b"".join(r["code"] for r in found), np.uint8).reshape(len(found), model.parts)
        model.probes = model.quantile(model.places(q)[row, lists]) + 1
        reached = model.sums(q, lists, codes)[row, np.arange(len(row))] + 1e-5

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(row), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    part = batch.slice(i, 4096)
                    stored = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, model.parts)
                    ordered = np.sort(model.sums(q, part.column(0).to_numpy(), stored), axis=1)
                    for j in range(len(q)):
                        of_query = row == j
                        n[of_query] += part.num_rows - np.searchsorted(ordered[j], reached[of_query], "right")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["i", "n"])

        counted = self.codes.select("list", "code").mapInArrow(above, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
        self.again = max(4 * self.k, model.quantile(np.array([r["n"] for r in counted])) + self.k)

    def _sample(self, most: int) -> list:
        """Rows of least id hash: a cut by hash first, so that no more than some multiple of the sample is sorted."""
        share = min(1.0, 4 * most / max(1, self.n))
        few = self.vectors if share == 1.0 else self.vectors.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        path = new_path(self.spark, "quantised-sample")  # cut in a task; then at most `most` rows come back
        few.orderBy(F.xxhash64("k"), "k").limit(most).write.parquet(path)
        return self.spark.read.schema(few.schema).parquet(path).orderBy(F.xxhash64("k"), "k").collect()

    def _asked(self, queries: DataFrame, query_id: str, cuts: bool = False) -> DataFrame:
        """(k, v, list, cut): each query at its nearest lists, and the sum that its candidates reach."""
        model, again, n = self.model, self.again, self.n

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, QUERY_PART):
                    part = batch.slice(i, QUERY_PART)
                    q = _matrix(part.column(1))
                    order = np.argsort(-(q @ model.centres.T), axis=1, kind="stable")[:, : model.probes]
                    at = pa.array(np.repeat(np.arange(len(q)), order.shape[1]))
                    cut = pa.array(model.cut(q, again, n) if cuts else np.zeros(len(q)), pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(order.ravel(), pa.int32()), cut.take(at)], names=["k", "v", "list", "cut"])

        rows = with_vectors(queries, query_id, self.vector)
        return rows.mapInArrow(lists, f"k {rows.schema['k'].dataType.simpleString()}, v {rows.schema['v'].dataType.simpleString()}, list int, cut double")

    def candidates(self, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
        """(query_id, doc_id): the rows with the best sums, `again` a query, from codes alone."""
        model, again = self.model, self.again
        asked = self._asked(queries, query_id, True)
        kinds = asked.schema["k"].dataType, self.codes.schema["k"].dataType
        sizes = F.broadcast(self.codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CODE_BLOCK).cast("int").alias("rbs")))  # one row a list
        rows = self.codes.join(sizes, "list").select("list", F.pmod(F.xxhash64("k"), F.col("rbs")).cast("int").alias("rb"), F.col("k").alias("rk"), "code", F.lit(None).cast(kinds[0]).alias("qk"), F.lit(None).cast(asked.schema["v"].dataType).alias("v"), F.lit(None).cast("double").alias("cut"))
        asked = asked.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)).alias("rb"), F.lit(None).cast(kinds[1]).alias("rk"), F.lit(None).cast("binary").alias("code"), F.col("k").alias("qk"), "v", "cut")
        met = rows.union(asked).repartition("list", "rb").sortWithinPartitions("list", "rb", F.col("rk").asc_nulls_last(), "qk")  # a block's rows, then its queries

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, keys, codes = None, [], []
            for batch in batches:
                lists, rbs, is_row = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
                edges = np.flatnonzero((np.diff(lists) != 0) | (np.diff(rbs) != 0) | np.diff(is_row)) + 1
                for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                    part = batch.slice(a, b - a)
                    if (lists[a], rbs[a]) != block:
                        block, keys, codes = (lists[a], rbs[a]), [], []
                    if is_row[a]:
                        keys.append(part.column(2))
                        codes.append(np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(part), model.parts))
                    elif keys:
                        keys, codes = [pa.concat_arrays(keys)], [np.concatenate(codes)]
                        for i in range(0, len(part), QUERY_PART):
                            some = part.slice(i, QUERY_PART)
                            near = np.round(model.sums(_matrix(some.column(5)), int(block[0]), codes[0]), 5)
                            kept = near >= some.column(6).to_numpy()[:, None]
                            for j in np.flatnonzero(kept.sum(axis=1) > again):
                                kept[j] = False
                                kept[j, np.argsort(-near[j], kind="stable")[:again]] = True
                            row, col = np.nonzero(kept)
                            yield pa.RecordBatch.from_arrays([some.column(4).take(pa.array(row)), keys[0].take(pa.array(col)), pa.array(-near[row, col].astype(np.float64))], names=["query_id", "doc_id", "distance"])

        found = met.mapInArrow(best, f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, distance double")
        w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
        return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= again).select("query_id", "doc_id")

    def search(self, queries: DataFrame, k: int | None = None, query_id: str = "query_id") -> DataFrame:
        """(query_id, doc_id, distance): the k nearest of each query's candidates by exact cosine distance."""
        k = k or self.k
        asked = with_vectors(queries, query_id, self.vector)
        if self.model is None:
            return asked.select(F.col("k").alias("query_id"), F.lit(None).cast(self.vectors.schema["k"].dataType).alias("doc_id"), F.lit(0.0).alias("distance")).limit(0)

        @F.pandas_udf("double")
        def distance(a, b):
            import pandas as pd

            if not len(a):
                return pd.Series([], dtype=float)
            x, y = (_unit(np.concatenate(s.to_numpy()), len(s)) for s in (a, b))
            return pd.Series(np.clip(1 - (x * y).sum(axis=1), 0, 2))

        near = self.candidates(queries, query_id).join(self.vectors.toDF("doc_id", "rv"), "doc_id").join(asked.toDF("query_id", "qv"), "query_id")
        scored = near.select("query_id", "doc_id", distance("qv", "rv").alias("distance"))
        w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id")
        return scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")

    def bytes_share(self, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
        """(query_id, share): bytes of codes in a query's lists and of the vectors that it scores again, by those of all vectors."""
        m = self.model
        sizes = self.codes.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        codes = self._asked(queries, query_id).join(F.broadcast(sizes), "list").groupBy(F.col("k").alias("query_id")).agg(F.sum("n").alias("n"))
        vectors = F.least(F.col("n"), F.lit(self.again)) * (4 * m.width)
        return codes.select("query_id", ((F.col("n") * m.parts + vectors) / F.lit(max(1, self.n) * 4 * m.width)).alias("share"))
