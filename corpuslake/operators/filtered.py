"""Filtered nearest-chunk search (J1 with F1): each query has its own filter, its own number of results and a tenant.

The index is a Parquet table of blocks, a folder a tenant: the keys and vectors of at most ROW_BLOCK rows and, for each
filter value that occurs in them, a bitmap of its rows. A bitmap is the shorter of the rows' numbers in four bytes each and
one bit a row. Tenants of any size are cut into blocks by the hash of the id, so a large one is many tasks. A query meets the blocks
of its tenant only; its conditions' bitmaps are intersected inside the kernel before distances are compared, so a filter
never costs results: the n nearest are those of the rows that pass. Equal distances go by the least id.

Rows without a vector are in no block; a null tenant is a tenant of its own. Queries without conditions see all rows of
their tenant; those whose conditions no row meets, whose tenant is unknown or whose n is below 1 find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.operators.search import QUERY_BLOCK, ROW_BLOCK, _unit
from corpuslake.options import ALL_TYPES

LISTED_TENANTS = 1000  # with so many tenants asked for at most, the folders are named in the plan


def row_values() -> Column:
    """What a chunk's row offers to filters: its directory, type, file type, importance and tags."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), c))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag="), t))
    return F.array_distinct(F.array_compact(F.concat(F.array(*map(one, ("directory", "type", "vault_type", "importance"))), tags)))


def wanted_values(directory: Column, kind: Column, importance: Column, tags: Column) -> Column:
    """A query's conditions in the same words; empty and null ones are ignored, as in metadata_filter."""
    said = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(name, F.lit("="), c))
    of_kind = F.when(kind.isin(*ALL_TYPES), "type").otherwise("vault_type")
    each = F.array(said(directory, F.lit("directory")), said(kind, of_kind), said(importance, F.lit("importance")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(each, F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag="), t))))))


def bitmap(rows: np.ndarray, n: int) -> bytes:
    """Row numbers below n, in order: a mark and their numbers, or a mark and n bits."""
    if 4 * len(rows) < (n + 7) // 8:
        return b"\x00" + rows.astype("<u4").tobytes()
    bits = np.zeros(n, bool)
    bits[rows] = True
    return b"\x01" + np.packbits(bits).tobytes()


def mask(raw: bytes | None, n: int) -> np.ndarray:
    if raw is None:
        return np.zeros(n, bool)
    if raw[:1] == b"\x01":
        return np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=n).astype(bool)
    out = np.zeros(n, bool)
    out[np.frombuffer(raw, "<u4", offset=1)] = True
    return out


def _tenant(c: Column) -> Column:
    """Folder names: a null is told from the text 'null'."""
    return F.when(c.isNull(), "none").otherwise(F.concat(F.lit("t:"), c.cast("string")))


def write_index(rows: DataFrame, path: str, values: Column, tenant: str = "tenant_id", doc_id: str = "doc_id", vector: str = "embedding") -> None:
    """Blocks of rows with bitmaps, dealt by tenant and block."""
    named = rows.select(_tenant(F.col(tenant)).alias("tenant"), F.col(doc_id).alias("k"), F.col(vector).alias("v"), values.alias("values"))
    real = named.filter(F.col("k").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    sizes = real.groupBy("tenant").agg(F.ceil(F.count(F.lit(1)) / (ROW_BLOCK // 2)).cast("int").alias("blocks"))  # half full on average, so that none is much over
    placed = real.join(sizes, "tenant").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    packed = placed.groupBy("tenant", "block").agg(F.array_sort(F.collect_list(F.struct("k", "v", "values"))).alias("rows"))
    kind, of = real.schema["k"].dataType.simpleString(), real.schema["v"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(2)[i].values
                said = rows.field(2)
                at = np.repeat(np.arange(len(rows)), np.diff(said.offsets.to_numpy()))
                codes = said.flatten().dictionary_encode()
                numbers = codes.indices.to_numpy(zero_copy_only=False)
                maps = [(name, bitmap(at[numbers == j], len(rows))) for j, name in enumerate(codes.dictionary.to_pylist())]
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                columns = [batch.column(0).slice(i, 1), one(rows.field(0)), one(rows.field(1).flatten()), pa.array([maps], pa.map_(pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["tenant", "rb_keys", "rb_vectors", "maps"])

    blocks = packed.select("tenant", "block", "rows").mapInArrow(build, f"tenant string, rb_keys array<{kind}>, rb_vectors {of}, maps map<string, binary>")
    blocks.write.partitionBy("tenant").parquet(path)


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(queries of a tenant, a block of its rows) -> each query's n nearest rows that its conditions let through."""
    for batch in batches:
        for i in range(batch.num_rows):
            q, keys, flat = batch.column(0)[i].values, batch.column(1)[i].values, batch.column(2)[i].values
            maps, n = dict(batch.column(3)[i].as_py()), len(batch.column(1)[i].values)
            x = _unit(q.field(1).flatten().to_numpy(zero_copy_only=False), len(q))
            near = np.clip(1.0 - x @ _unit(flat.to_numpy(zero_copy_only=False), n).T, 0.0, 2.0)
            rounded = np.round(near, 9)
            passes: dict[tuple, np.ndarray] = {}
            rows, cols = [], []
            for j, (most, conditions) in enumerate(zip(q.field(2).to_pylist(), q.field(3).to_pylist())):
                key = tuple(conditions)
                if key not in passes:
                    passes[key] = np.flatnonzero(np.logical_and.reduce([mask(maps.get(c), n) for c in key])) if key else np.arange(n)
                at = passes[key]
                if len(at) and most > 0:
                    best = at[np.argsort(rounded[j, at], kind="stable")[:most]]  # rows stand in order of id
                    rows += [j] * len(best)
                    cols += best.tolist()
            yield pa.RecordBatch.from_arrays([q.field(0).take(pa.array(rows, pa.int64())), keys.take(pa.array(cols, pa.int64())), pa.array(near[rows, cols] if rows else [], pa.float64()), q.field(2).take(pa.array(rows, pa.int64()))], names=["query_id", "doc_id", "distance", "n"])


def filtered_nearest(spark: SparkSession, queries: DataFrame, path: str, query_id: str = "query_id", tenant: str = "tenant_id", vector: str = "embedding", n: str = "n", wanted: str = "wanted") -> DataFrame:
    """(query_id, doc_id, distance) of queries with columns for id, tenant, vector, number of results and conditions."""
    asked = queries.select(_tenant(F.col(tenant)).alias("tenant"), F.col(query_id).alias("k"), F.col(vector).alias("v"), F.col(n).cast("int").alias("n"), F.coalesce(wanted, F.array().cast("array<string>")).alias("wanted"))
    asked = asked.filter(F.col("k").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    sizes = asked.groupBy("tenant").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    packed = asked.join(sizes, "tenant").groupBy("tenant", F.pmod(F.xxhash64("k"), F.col("blocks")).alias("qb")).agg(F.array_sort(F.collect_list(F.struct("k", "v", "n", "wanted"))).alias("q"))
    blocks = spark.read.parquet(path)
    few = [r[0] for r in asked.select("tenant").distinct().limit(LISTED_TENANTS + 1).collect()]
    if len(few) <= LISTED_TENANTS:
        blocks = blocks.filter(F.col("tenant").isin(few))
    kinds = asked.schema["k"].dataType.simpleString(), blocks.schema["rb_keys"].dataType.elementType.simpleString()
    met = packed.join(blocks, "tenant").select("q", "rb_keys", "rb_vectors", "maps")
    found = met.mapInArrow(_kernel, f"query_id {kinds[0]}, doc_id {kinds[1]}, distance double, n int")
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.col("n")).select("query_id", "doc_id", "distance")
