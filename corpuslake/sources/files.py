"""Data sources for files that Spark's own do not cover: transcripts read by byte range with an offset for each session
(S3, R1), and one file for each row, committed together (S10).

Both work on any store that Arrow's file systems open by its URI (local, HDFS, S3, GCS). Register once a session:
`register(spark)`, then `spark.read.format("transcripts")`, `spark.readStream.format("transcripts")` and
`df.write.format("row_files")`.

Transcripts. A file `<session>.jsonl` is a session. Rows are (session_id, start_byte, range_start, raw), a line each; `start_byte`
orders a session's lines and never changes while the file grows. A range is `range_bytes` long at most; a line belongs to the range in which it
begins, so files of any size are many tasks and none reads what another emits;
short files share a task. A stream's offset has, for each session, the end
of its last whole line; a line without its end waits. `start` is a JSON object session -> byte where reading begins, which an earlier
run's `next_bytes` gives. A file that got shorter gives nothing until it is longer again. Missing folders are empty.

Row files. Rows are (path, document). A task writes its rows below `_staging/<job>/`; commit moves them to their paths,
abort drops them, so a failed job leaves no file. Paths are relative and inside the folder, else the job fails; a null document is an empty
file; of equal paths in one job one file is left, so paths should be keys. Commit is a rename a file, some at once.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
ENDING = ".jsonl"
LINES = pa.schema([("session_id", pa.string()), ("start_byte", pa.int64()), ("range_start", pa.int64()), ("raw", pa.string())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Range:
    session: str
    path: str
    first: int  # reading begins at this byte, which begins a line
    start: int
    end: int
    limit: int  # no line reaches beyond it


@dataclass
class Bundle(InputPartition):
    """Ranges that one task reads: one of full length, or several short ones."""

    ranges: list[Range]


def _bundled(ranges: list[Range], most: int) -> list[InputPartition]:
    out: list[Bundle] = []
    held = most
    for r in ranges:
        size = r.end - r.start
        if held + size > most:
            out.append(Bundle([]))
            held = 0
        out[-1].ranges.append(r)
        held += size
    return out or [Bundle([])]


def _last_line_end(fs: pafs.FileSystem, path: str, low: int, size: int) -> int:
    """The byte after the last line end in [low, size), or low; the tail is read in steps."""
    with fs.open_input_file(path) as f:
        at = size
        while at > low:
            step = max(low, at - READ_BYTES)
            f.seek(step)
            found = f.read(at - step).rfind(b"\n")
            if found >= 0:
                return step + found + 1
            at = step
    return low


class _Transcripts:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.start = {k: int(v) for k, v in json.loads(options.get("start", "{}")).items()}
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def sizes(self) -> dict[str, tuple[str, int]]:
        fs, root = opened(self.root)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
        return {f.base_name[: -len(ENDING)]: (f.path, f.size) for f in files if f.is_file and f.base_name.endswith(ENDING)}

    def ranges(self, session: str, path: str, first: int, limit: int) -> list[Range]:
        return [Range(session, path, first, s, min(s + self.range_bytes, limit), limit) for s in range(first, limit, self.range_bytes)]

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        with fs.open_input_file(part.path) as f:
            at = part.start
            if part.start > part.first:  # the line that began before belongs to the range before
                f.seek(part.start - 1)
                at = _after_line(f, part.start - 1, part.limit)
            f.seek(at)
            rest, starts, rows = b"", [], []
            begin, held = at, 0
            while begin < part.end:
                block = f.read(min(READ_BYTES, part.limit - begin - len(rest)))
                data = rest + block
                pieces = data.split(b"\n")
                rest = pieces.pop()
                if not block and rest:
                    pieces, rest = [*pieces, rest], b""  # the last line of a file that ends without a line end
                for piece in pieces:
                    if begin >= part.end:
                        break
                    starts.append(begin)
                    rows.append(piece.decode("utf-8", "replace"))
                    begin, held = begin + len(piece) + 1, held + len(piece)
                if held > 4 * READ_BYTES:
                    yield self._batch(part, starts, rows)
                    starts, rows, held = [], [], 0
                if not block:
                    break
            if rows:
                yield self._batch(part, starts, rows)

    def _batch(self, part: Range, starts: list[int], rows: list[str]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([part.session] * n, pa.string()), pa.array(starts, pa.int64()), pa.array([part.start] * n, pa.int64()), pa.array(rows, pa.string())], schema=LINES)


def _after_line(f, at: int, limit: int) -> int:
    while at < limit:
        block = f.read(min(READ_BYTES, limit - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not block:
            break
        at += len(block)
    return limit


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.of = _Transcripts(options)

    def partitions(self) -> list[InputPartition]:
        return _bundled([r for s, (path, size) in sorted(self.of.sizes().items()) for r in self.of.ranges(s, path, self.of.start.get(s, 0), size)], self.of.range_bytes)

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from self.of.lines(part)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.of = _Transcripts(options)
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return dict(self.of.start)

    def latestOffset(self) -> dict:
        fs, _ = opened(self.of.root)
        for session, (path, size) in self.of.sizes().items():
            known = self.last.get(session, self.of.start.get(session, 0))
            if size > known:
                self.last[session] = _last_line_end(fs, path, known, size)
        return {k: v for k, v in sorted(self.last.items()) if v}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        _, root = opened(self.of.root)
        first = {s: start.get(s, self.of.start.get(s, 0)) for s in end}  # a session that no offset has named yet
        return _bundled([r for s, limit in sorted(end.items()) if limit > first[s] for r in self.of.ranges(s, posixpath.join(root, s + ENDING), first[s], limit)], self.of.range_bytes)

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from self.of.lines(part)


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "session_id string, start_byte long, range_start long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    n: int


class _RowFileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator) -> Staged:
        fs, root = opened(self.root)
        folder, n = f"{root}/_staging/{self.job}/{uuid.uuid4().hex}", 0
        made: set[str] = set()
        for row in iterator:
            path = posixpath.normpath(row["path"])
            if path.startswith(("/", "..")) or path in (".", ""):
                raise ValueError(f"not a path inside the folder: {row['path']!r}")
            above = posixpath.dirname(f"{folder}/{path}")
            if above not in made:
                fs.create_dir(above, recursive=True)
                made.add(above)
            with fs.open_output_stream(f"{folder}/{path}") as out:
                out.write((row["document"] or "").encode("utf-8", "surrogatepass"))
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.root)

        def move(item: tuple[str, str]) -> None:
            fs.move(item[0], f"{root}/{item[1]}")

        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is None or not m.n:
                    continue
                files = [f.path for f in fs.get_file_info(pafs.FileSelector(m.folder, recursive=True)) if f.is_file]
                names = [(f, f[len(m.folder) + 1 :]) for f in files]
                for above in {posixpath.dirname(f"{root}/{name}") for _, name in names}:
                    fs.create_dir(above, recursive=True)
                list(pool.map(move, names))
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = opened(self.root)
        if fs.get_file_info(f"{root}/_staging/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_staging/{self.job}")
        if fs.get_file_info(f"{root}/_staging").type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(f"{root}/_staging")):
            fs.delete_dir(f"{root}/_staging")


class RowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "path string, document string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("row_files only adds files")
        return _RowFileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (Transcripts, RowFiles):
        spark.dataSource.register(source)


def write_row_files(rows: DataFrame, path: str, name: Column | str = "path", document: Column | str = "document") -> None:
    register(rows.sparkSession)
    rows.select((F.col(name) if isinstance(name, str) else name).alias("path"), (F.col(document) if isinstance(document, str) else document).alias("document")).write.format("row_files").mode("append").save(path)


def transcript_lines(spark: SparkSession, path: str, start: dict[str, int] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(session_id, start_byte, range_start, raw) of all transcripts from the given bytes on."""
    register(spark)
    return spark.read.format("transcripts").option("start", json.dumps(start or {})).option("range_bytes", range_bytes).load(path)


def transcript_stream(spark: SparkSession, path: str, start: dict[str, int] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    register(spark)
    return spark.readStream.format("transcripts").option("start", json.dumps(start or {})).option("range_bytes", range_bytes).load(path)


def numbered(lines: DataFrame) -> DataFrame:
    """(session_id, line_idx, start_byte, raw): lines numbered from 0 in their session. Counts by range come first, so that only a
    range's lines are ordered together."""
    counts = lines.groupBy("session_id", "range_start").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("session_id").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("session_id", "range_start", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("session_id", "range_start").orderBy("start_byte")) - 1
    return lines.withColumn("own", own).join(base, ["session_id", "range_start"]).select("session_id", (F.col("base") + F.col("own")).alias("line_idx"), "start_byte", "raw")


def next_bytes(lines: DataFrame) -> dict[str, int]:
    """Where each session's next line begins, for `start`: a number a session."""
    ends = lines.groupBy("session_id").agg(F.max(F.col("start_byte") + F.octet_length("raw") + 1).alias("at"))
    return {r["session_id"]: r["at"] for r in ends.collect()}
