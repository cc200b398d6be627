"""Near repeats of vectors by a radius join (J6, R7): which rows have an earlier row within an angle, and the nearest such.

Pivots are fitted on a bounded sample; every row is listed at its nearest pivot with its angle to it. For a query at angle t from a
pivot and a radius r, the triangle inequality on angles rules out a whole list if the query's angle to its own nearest pivot is
less than t - 2r, or if no row of the list has an angle from t - r to t + r; and in a list that is left, every row outside these
angles. The rest is compared exactly, so no repeat is lost. Neighbouring lists share a block of bounded size and a long list has several:
one list may hold any number of copies. A query goes once to each block that has a list left for it, however many these are, and
gets one row back from it. A block's rows pass to a task first and its queries follow, so a task holds one block.

Rows without a key or with a null, empty or partly null vector are no repeats and repeat nothing. Rounded to six places, a similarity of
`least` counts. Equally near rows go by the least key. Zero vectors are similar to nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators.quantised import _means
from corpuslake.operators.search import _unit, with_vectors
from corpuslake.sources.tables import written

SAMPLE = 20_000
BLOCK = 16_384  # rows in one block
PARALLEL = 8, 64  # blocks at least, and tasks at least: below that, a block's queries are dealt in parts
STEP = 2_048  # rows whose angles to all pivots are held at once
GROUP = 32  # queries of like angles that share one matrix product
SLACK = 1e-6  # radians, for the last bits of an angle


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False), len(column)) if len(column) else np.zeros((0, 1))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows by pivots; without pivots all are at one, and nothing is ruled out."""
    return np.arccos(np.clip(x @ pivots.T, -1, 1)) if len(pivots) else np.zeros((len(x), 1))


def fit_pivots(rows: DataFrame, key: str = "doc_id", vector: str = "embedding", most: int = 512, sample: int = SAMPLE) -> np.ndarray:
    """At most `most` unit vectors, about the square root of the rows, from `sample` rows; none without rows."""
    vectors = with_vectors(rows, key, vector)
    n = vectors.count()
    share = min(1.0, 4 * sample / max(1, n))
    few = vectors if share == 1.0 else vectors.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found = written(few.orderBy(F.xxhash64("k"), "k").limit(sample), "pivot-sample").orderBy(F.xxhash64("k"), "k").collect()
    if not found:
        return np.zeros((0, 0))
    x = _unit(np.array([r["v"] for r in found]), len(found))
    x = np.unique(x, axis=0)  # copies are one
    x = x[np.random.default_rng(0).permutation(len(x))]
    centres = _means(x, max(1, min(most, int(n**0.5), len(x))), 8)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)


def placed(rows: DataFrame, pivots: np.ndarray, at: str, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(k, at, v, list, angle): each row at its nearest pivot. `at` is a long that orders rows by time; equal ones go by key."""
    named = rows.select(F.col(key).alias("k"), F.coalesce(F.col(at).cast("long"), F.lit(-(2**63))).alias("at"), F.col(vector).alias("v"))
    chosen = named.filter(F.col("k").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                angles = _angles(_matrix(part.column(2)), pivots)
                lists = np.argmin(angles, axis=1) if len(angles) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.int32()), pa.array(angles[np.arange(len(lists)), lists])], names=["k", "at", "v", "list", "angle"])

    return chosen.mapInArrow(place, f"k {chosen.schema['k'].dataType.simpleString()}, at long, v {chosen.schema['v'].dataType.simpleString()}, list int, angle double")


def _cells(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first list, first block, blocks) of each run of lists that share blocks, from the rows of each list."""
    size = min(BLOCK, -(-int(n.sum()) // PARALLEL[0]))
    start, held = [], size + 1
    for i, rows in enumerate(n):
        if held + rows > size:
            start.append(i)
            held = 0
        held += int(rows)
    blocks = -(-np.add.reduceat(n, start) // size)  # more than one for a single long list only
    return np.array(start), np.cumsum(blocks) - blocks, blocks


def _asked(queries: DataFrame, pivots: np.ndarray, lists: np.ndarray, least_angle: np.ndarray, most_angle: np.ndarray, radius: float, cells: tuple) -> DataFrame:
    """(k, at, v, list, angle, block): each placed query at every block with a list that the bounds leave."""
    start, first, blocks = cells

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                angles = _angles(_matrix(part.column(2)), pivots)
                open_ = angles[:, lists] <= angles.min(axis=1, initial=np.inf)[:, None] + 2 * radius
                open_ &= (angles[:, lists] - radius <= most_angle) & (angles[:, lists] + radius >= least_angle)
                row, cell = np.nonzero(np.logical_or.reduceat(open_, start, axis=1))
                each = blocks[cell]
                block = np.repeat(first[cell] - np.cumsum(each) + each, each) + np.arange(each.sum())
                at = np.repeat(row, each)
                for j in range(0, len(at), 4 * STEP):
                    some = pa.array(at[j : j + 4 * STEP])
                    yield pa.RecordBatch.from_arrays([*[c.take(some) for c in part.columns], pa.array(block[j : j + 4 * STEP], pa.int32())], names=["k", "at", "v", "list", "angle", "block"])

    return queries.mapInArrow(reach, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema) + ", block int")


class _Block:
    """Rows of some lists, by list and angle."""

    def __init__(self, batches: list[pa.RecordBatch], pivots: np.ndarray):
        rows = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        self.keys, self.unit = column("rk"), _matrix(column("v"))
        self.at = column("at").to_numpy()
        self.lists, at = np.unique(column("list").to_numpy(), return_inverse=True)
        self.order = 10.0 * at + column("angle").to_numpy()  # angles are below 4
        self.pivots = pivots[self.lists] if len(pivots) else pivots

    def spans(self, x: np.ndarray, own: np.ndarray, radius: float) -> list[list[int]]:
        """Ranges of rows that the bounds leave for any of these queries; ranges that nearly touch are one."""
        angles, i = _angles(x, self.pivots), 10.0 * np.arange(len(self.lists))
        out = angles > own[:, None] + 2 * radius
        low = np.where(out, 9.0, np.maximum(angles - radius, 0)).min(axis=0)
        high = np.where(out, -1.0, np.minimum(angles + radius, 4)).max(axis=0)
        spans: list[list[int]] = []
        for a, b in zip(np.searchsorted(self.order, i + low, "left").tolist(), np.searchsorted(self.order, i + high, "right").tolist()):
            if a < b and spans and a - spans[-1][1] < GROUP:
                spans[-1][1] = b
            elif a < b:
                spans.append([a, b])
        return spans

    def nearest(self, q: pa.RecordBatch, radius: float, least: float) -> pa.RecordBatch:
        """(query_id, doc_id, similarity, compared), a row for each query."""
        x, qt, own = _matrix(q.column("v")), q.column("at").to_numpy(), q.column("angle").to_numpy()
        rank = np.unique(np.concatenate([c.to_numpy(zero_copy_only=False) for c in (self.keys, q.column("qk"))]), return_inverse=True)[1]
        ro, qo = rank[: len(self.keys)], rank[len(self.keys) :]
        best, score, compared = np.full(len(q), -1), np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
        for a in range(0, len(q), GROUP):
            s = slice(a, min(a + GROUP, len(q)))
            for lo, hi in self.spans(x[s], own[s], radius):
                compared[s] += hi - lo
                near = x[s] @ self.unit[lo:hi].T
                col = np.flatnonzero(near.max(axis=0) >= least - 1e-6)
                if not len(col):
                    continue
                near, col = np.round(near[:, col], 6), col + lo
                earlier = (self.at[col] < qt[s, None]) | ((self.at[col] == qt[s, None]) & (ro[col] < qo[s, None]))
                near[~earlier | (near < least)] = -np.inf
                top = near.max(axis=1)
                first = col[np.where(near == top[:, None], ro[col], np.iinfo(np.int64).max).argmin(axis=1)]
                better = (top > score[s]) | (np.isfinite(top) & (top == score[s]) & (ro[first] < ro[best[s]]))
                best[s], score[s] = np.where(better, first, best[s]), np.where(better, top, score[s])
        return pa.RecordBatch.from_arrays([q.column("qk"), self.keys.take(pa.array(best, mask=best < 0)), pa.array(score, mask=best < 0), pa.array(compared)], names=["query_id", "doc_id", "similarity", "compared"])


def _block_nearest(pivots: np.ndarray, radius: float, least: float):
    """A block's rows and then its queries, block after block -> a row for each query."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            cell, is_row = batch.column("block").to_numpy() * 1024 + batch.column("part").to_numpy(), batch.column("rk").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(cell) != 0) | np.diff(is_row)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if cell[a] != here:
                    here, held, block = cell[a], [], None
                if is_row[a]:
                    held.append(batch.slice(a, b - a))
                elif held or block:
                    block, held = block or _Block(held, pivots), []
                    yield block.nearest(batch.slice(a, b - a), radius, least)

    return nearest


def repeats(queries: DataFrame, rows: DataFrame, pivots: np.ndarray, least: float = 0.95) -> DataFrame:
    """(query_id, doc_id, similarity, compared) of each placed query: its nearest earlier row of similarity `least` or
    more, null if there is none, and the number of rows it was compared with. A query may be a row too."""
    radius = float(np.arccos(np.clip(least - 5e-7, -1, 1))) + SLACK
    bounds = rows.groupBy("list").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("list").collect()  # a row a pivot
    kind, doc_kind = queries.schema["k"].dataType, rows.schema["k"].dataType
    none = queries.select(F.col("k").alias("query_id"), F.lit(None).cast(doc_kind).alias("doc_id"), F.lit(None).cast("double").alias("similarity"), F.lit(0).cast("long").alias("compared"))
    if not len(bounds):
        return none
    lists, low, high, n = (np.array([b[c] for b in bounds]) for c in ("list", "low", "high", "n"))
    start, first, blocks = cells = _cells(n)
    parts = max(1, PARALLEL[1] // int(blocks.sum()))
    of = np.searchsorted(start, np.arange(len(lists)), "right") - 1
    homes = [(int(l), int(first[i]), int(blocks[i])) for l, i in zip(lists, of)]
    homes = F.broadcast(queries.sparkSession.createDataFrame(homes, "list int, first int, blocks int"))  # a row a pivot
    asked = _asked(queries, pivots, lists.astype(int), low, high, radius, cells)
    place = lambda n: F.pmod(F.xxhash64("k"), F.lit(n) if isinstance(n, int) else F.col(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    kept = rows.join(homes, "list").select((F.col("first") + place("blocks")).alias("block"), every, F.col("k").alias("rk"), F.lit(None).cast(kind).alias("qk"), "list", "angle", "at", "v")
    asked = asked.select("block", place(parts).alias("part"), F.lit(None).cast(doc_kind).alias("rk"), F.col("k").alias("qk"), "list", "angle", "at", "v")
    met = kept.union(asked).repartition("block", "part").sortWithinPartitions("block", "part", F.col("rk").isNull(), "list", "angle", "rk", "qk")  # like queries are neighbours
    found = met.mapInArrow(_block_nearest(pivots, radius, least), f"query_id {kind.simpleString()}, doc_id {doc_kind.simpleString()}, similarity double, compared long").union(none)
    hit = F.when(F.col("doc_id").isNotNull(), F.struct((-F.col("similarity")).alias("s"), "doc_id"))
    best = found.groupBy("query_id").agg(F.min(hit).alias("x"), F.sum("compared").alias("compared"))
    return best.select("query_id", "x.doc_id", (-F.col("x.s")).alias("similarity"), "compared")


class RepeatStore:
    """Placed vectors of all batches in a folder, one folder a batch; a batch that comes again replaces only itself."""

    def __init__(self, spark: SparkSession, path: str, pivots: np.ndarray, least: float = 0.95, key: str = "doc_id", vector: str = "embedding"):
        self.spark, self.path, self.pivots, self.least, self.key, self.vector = spark, path, pivots, least, key, vector

    def add(self, rows: DataFrame, batch: int) -> None:
        """Judges a batch's rows against those of earlier batches and against its own of lesser key, and keeps both."""
        here = f"{self.path}/vectors/batch={batch}"
        fresh = placed(rows.withColumn("__at", F.lit(batch)), self.pivots, "__at", self.key, self.vector)
        fresh.write.mode("overwrite").parquet(here)
        fresh = self.spark.read.schema(fresh.schema).parquet(here)
        known = self.spark.read.schema(fresh.schema).option("basePath", f"{self.path}/vectors").parquet(f"{self.path}/vectors").filter(F.col("at") <= batch)
        repeats(fresh, known, self.pivots, self.least).write.mode("overwrite").parquet(f"{self.path}/judged/batch={batch}")

    def judged(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/judged").select("query_id", "doc_id", "similarity", "compared", F.col("batch").cast("int").alias("batch"))
