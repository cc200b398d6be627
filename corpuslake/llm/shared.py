"""What several of these operators need: tables in the shared folder, byte access to Arrow text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where it is unset and the session is
    local, a temporary folder, which becomes the setting. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it again.

    A lost executor then costs only the tasks in flight, not the jobs before this point."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def small(df: DataFrame, name: str) -> DataFrame:
    """A table of keys, written and counted; broadcast if it has at most BROADCAST_ROWS rows, else left to the join."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of an Arrow string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, for the JVM beside it and the next stage's workers."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def parts_of(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `most` bytes together; a longer text is a slice of its own."""
    _, offsets = byte_column(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def set_aside(docs: DataFrame, results: Sequence[str], reads: Sequence[str] = ()) -> tuple[DataFrame, tuple[str, ...]]:
    """docs without columns that are named like a result (in any case): they are kept as `<name>_input`, with more
    underscores if that is taken. Also gives the names that the columns to read have now."""
    taken = {c.lower() for c in (*docs.columns, *results)}
    wanted = {c.lower() for c in results}
    names = {}
    for c in docs.columns:
        name = c
        if c.lower() in wanted:
            name = f"{c}_input"
            while name.lower() in taken:
                name = name.replace("_input", "__input")
            taken.add(name.lower())
        names[c] = name
    return (docs.toDF(*names.values()) if any(a != b for a, b in names.items()) else docs), tuple(names.get(c, c) for c in reads)
