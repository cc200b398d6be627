"""Suffix-array dedup: bytes inside any 200-byte string that also starts elsewhere are removed.

How it works at scale, without ever sorting all suffixes of the corpus:

1. Anchors. In each stretch of 161 positions the 40-byte gram with the least hash is the anchor; each 200-byte window
   belongs to the anchor of the positions it holds. Equal windows choose equal anchors, so a window whose anchor gram
   occurs once in the corpus cannot repeat. Only the anchors' hashes are shuffled (one for about 80 bytes), and
   copies are added up in each task first.
2. Pieces. The windows of one anchor in one text form a piece (at most 360 bytes); the pieces of a gram are a group.
   Identical pieces collapse into one with a weight. A group with a single piece needs no comparison.
3. Transforms. The pieces of the other groups are fetched once each, dealt to tasks by group, and within a task to
   shards by the text they come from. Every shard gets its Burrows-Wheeler transform, and the transforms are merged
   by interleave refinement (bwt.py), which yields the repeated 200-byte intervals.
4. Removal. Repeated windows become byte intervals of their texts, joined and cut out.

A gram shared by very many different pieces (a passage in a third of all texts, each with other words around it)
is split before step 3: its windows are dealt by the offset of the anchor and by the bytes that all windows of that
offset range have in common, first in ranges of 16, then of 1, so no task gets more than `MAX_GROUP` pieces of a
group that still differ.

Defined results. Null text: empty, nothing removed. Texts under 200 bytes keep every byte. Repeated rows and
copies: each is a repeat of the other, all their windows go (also in the kept copy: "occurs elsewhere" is judged on
the input). Matches never cross documents. Rows are told apart by id and text hash; rows that agree in both count
as separate occurrences. A column named like the result stays as `<name>_input`. Removing bytes may split a character: `kept` is binary, and `cut_text` drops torn characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.bwt import LANE, SPAN, lanes, repeated_starts
from corpuslake.llm.shared import byte_column, set_aside, written

GRAM = 40
STRETCH = SPAN - GRAM + 1
CHUNK_BITS = 17
CHUNK = 1 << CHUNK_BITS
MAX_GROUP = 20_000
MERGE_BYTES = 1 << 20
SHARDS = 4
FINE = 16

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(CHUNK + 1, base, np.uint64), np.full(CHUNK + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers()
_OF_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _M1)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * _UP[: len(data)], out=out[1:])
    return out


def _slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of slices of the data that `sums` is of; equal bytes, equal hash."""
    return _mix((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64) * _M1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    lane = _mix(lanes(data) * _M1 + _M2)
    n = len(data) - GRAM + 1
    out = lane[:n].copy()
    for o in range(LANE, GRAM, LANE):
        out *= _M1
        out ^= lane[o : o + n]
        out ^= out >> np.uint64(29)
    return out * _M2


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each part, place of each part in its text, first byte of each part): parts of at most CHUNK
    bytes together; a longer text is cut into parts that overlap by SPAN - 1, so each window is in one part."""
    rows, places, sizes = [], [], []
    sizes_all = np.diff(offsets)
    full = 0
    parts: list[np.ndarray] = []

    def out():
        starts = np.cumsum([0] + sizes[:-1])
        return np.concatenate(parts), np.array(rows), np.array(places), starts, np.array(sizes)

    for row in np.flatnonzero(sizes_all >= SPAN):
        begin, size = int(offsets[row]), int(sizes_all[row])
        for place in range(0, size - SPAN + 1, CHUNK - SPAN + 1):
            part = data[begin + place : begin + min(size, place + CHUNK)]
            if full + len(part) > CHUNK:
                yield out()
                rows, places, sizes, parts, full = [], [], [], [], 0
            rows.append(row)
            places.append(place)
            sizes.append(len(part))
            parts.append(part)
            full += len(part)
    if parts:
        yield out()


def _anchors(data: np.ndarray, offsets: np.ndarray, with_pieces: bool):
    """For each piece: row, first window, anchor offset in the piece, windows, gram hash, hash of the piece."""
    for body, rows, places, starts, sizes in _chunks(data, offsets):
        grams = _gram_hashes(body)
        least = (grams & ~np.uint64(CHUNK - 1)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= STRETCH:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (STRETCH - span)], least[STRETCH - span :])
        inside = np.zeros(len(body) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + sizes - SPAN + 1, -1)
        window = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
        anchor = (least[window] & np.uint64(CHUNK - 1)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        first, anchor = window[cut], anchor[cut]
        count = np.diff(np.append(cut, len(window)))
        part = np.searchsorted(starts, first, side="right") - 1
        key = grams[anchor].view(np.int64)
        if not with_pieces:
            yield key
            continue
        end = first + count + SPAN - 1
        piece = _mix(_slice_hash(_sums(body), first, end) ^ ((anchor - first).astype(np.uint64) * _M3)).view(np.int64)
        yield rows[part], places[part] + first - starts[part], anchor - first, count, key, piece


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_anchors(*byte_column(batch.column(0)), False))
        if found:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "n"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = batch.column(1), batch.column(2)
        for row, start, anchor, count, key, piece in _anchors(*byte_column(batch.column(0)), True):
            at = (start << 16) | (anchor << 8) | (count - 1)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(piece), ids.take(take), hashes.take(take), pa.array(at)], names=["key", "piece", "id", "text_hash", "at"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the wanted pieces out of each text."""
    names = ["key", "piece", "weight", "shard", "anchor", "windows", "body"]
    for batch in batches:
        for text, wanted, shard in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            out = [[], [], [], [], [], [], []]
            for w in wanted.as_py():
                start, anchor, windows = w["at"] >> 16, (w["at"] >> 8) & 255, (w["at"] & 255) + 1
                for column, value in zip(out, (w["key"], w["piece"], w["weight"], shard, anchor, windows, data[start : start + windows + SPAN - 1])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32()), pa.array(out[6], pa.binary())], names=names)


FETCHED = "key long, piece long, weight long, shard int, anchor int, windows int, body binary"
REPEATS = "key long, piece long, ranges array<struct<a:int,b:int>>"


def _ranges(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads pieces sorted by group; whole groups are gathered up to MERGE_BYTES, transformed by shards and merged."""
    group_of: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()
    held: list[tuple] = []
    size = 0

    def solve() -> pa.RecordBatch:
        keys = np.array([h[0] for h in held], np.int64)
        _, groups = np.unique(keys, return_inverse=True)
        hits = repeated_starts([h[6] for h in held], groups, np.array([h[5] for h in held]), np.array([h[3] for h in held]))
        rows = []
        for h, hit in zip(held, hits):
            if h[2] > 1:  # copies of the piece: every window occurs in each of them
                hit[:] = True
            if hit.any():
                rows.append({"key": h[0], "piece": h[1], "ranges": _ranges(hit)})
        return pa.RecordBatch.from_pylist(rows, schema=_REPEATS_ARROW)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if row[0] not in group_of:
                if size >= MERGE_BYTES:
                    yield solve()
                    held, size, seen = [], 0, set()
                group_of = {row[0]: 0}
            if (row[0], row[1]) not in seen:  # a text that occurs twice answers twice
                seen.add((row[0], row[1]))
                held.append(row)
                size += len(row[6])
    if held:
        yield solve()


_REPEATS_ARROW = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _split(reach: int):
    """Deals the windows of each piece to ranges of `reach` anchor offsets; a range's key also has the bytes that
    all its windows share."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, piece, weight, shard, anchor, windows, body in zip(*(batch.column(i).to_pylist() for i in range(7))):
                sums = _sums(np.frombuffer(body, np.uint8))
                for r in range((anchor - windows + 1) // reach, anchor // reach + 1):
                    lo, hi = max(0, anchor - (r * reach + reach - 1)), min(windows - 1, anchor - r * reach)
                    core = np.array([anchor - r * reach]), np.array([anchor - r * reach - reach + 1 + SPAN])
                    own = _slice_hash(sums, *core) ^ np.uint64((key * 31 + r) & 0xFFFFFFFFFFFFFFFF)
                    whole = _slice_hash(sums, np.array([lo]), np.array([hi + SPAN]))
                    sub = int(_mix(own * _M1).view(np.int64)[0])
                    out.append((key, piece, lo, sub, int((whole ^ np.uint64(anchor - lo)).view(np.int64)[0]), weight, shard, anchor - lo, hi - lo + 1, body[lo : hi + SPAN]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["key_in", "piece_in", "shift", "key", "piece", "weight", "shard", "anchor", "windows", "body"]) if out else pa.RecordBatch.from_pylist([], schema=_SPLIT_ARROW)

    return split


_SPLIT_ARROW = pa.schema([("key_in", pa.int64()), ("piece_in", pa.int64()), ("shift", pa.int32()), ("key", pa.int64()), ("piece", pa.int64()), ("weight", pa.int64()), ("shard", pa.int32()), ("anchor", pa.int32()), ("windows", pa.int32()), ("body", pa.binary())])
SPLIT = "key_in long, piece_in long, shift int, " + FETCHED


def repeats_of(pieces: DataFrame, max_group: int = MAX_GROUP, reach: int = FINE) -> DataFrame:
    """(key, piece, ranges of repeated windows) for the pieces of FETCHED's columns."""
    sizes = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    hot = sizes.filter(F.col("size") > max_group).select("key")
    solve = lambda p: p.select(*FETCHED_NAMES).repartition("key").sortWithinPartitions("key").mapInArrow(_merge_groups, REPEATS)
    if reach < 1 or hot.limit(1).count() == 0:
        return solve(pieces)
    cold = solve(pieces.join(hot, "key", "left_anti"))
    parts = written(pieces.join(hot, "key", "left_semi").select(*FETCHED_NAMES).mapInArrow(_split(reach), SPLIT), "suffix-parts")
    # equal parts of different pieces are one part with their weights added
    merged = parts.groupBy("key", "piece").agg(F.sum("weight").alias("weight"), F.min("shard").alias("shard"), F.min("anchor").alias("anchor"), F.min("windows").alias("windows"), F.min("body").alias("body"))
    found = repeats_of(written(merged, "suffix-hot"), max_group, 1 if reach > 1 else 0)
    back = parts.select("key_in", "piece_in", "shift", "key", "piece").join(found, ["key", "piece"])
    shifted = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
    again = back.select("key_in", "piece_in", shifted.alias("ranges")).groupBy(F.col("key_in").alias("key"), F.col("piece_in").alias("piece")).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return cold.unionByName(again)


FETCHED_NAMES = [c.split()[0] for c in FETCHED.split(", ")]


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """(id, text_hash, spans): the byte intervals [a, b) of each text that repeat, for texts that have any."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(body.cast("binary").alias("body"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("text_hash")).filter(F.octet_length("body") >= SPAN)
    id_type = texts.schema["id"].dataType.simpleString()

    grams = texts.select("body").mapInArrow(_gram_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = written(grams.filter("n > 1").select("key"), "suffix-grams")
    every = texts.mapInArrow(_pieces, f"key long, piece long, id {id_type}, text_hash long, at long")
    placed = written(every.join(often, "key"), "suffix-pieces")

    piece = placed.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("id", "text_hash", "at")).alias("one"))
    piece = written(piece, "suffix-distinct")
    groups = piece.groupBy("key").agg(F.count(F.lit(1)).alias("pieces"))
    several = groups.filter("pieces > 1").select("key")
    wanted = piece.join(several, "key").select("one.*", "key", "piece", "weight").groupBy("id", "text_hash").agg(F.collect_list(F.struct("key", "piece", "weight", "at")).alias("wanted"))
    bodies = texts.join(wanted.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")) & (texts["text_hash"] == wanted["text_hash"]))
    bodies = bodies.select("body", "wanted", F.pmod(F.xxhash64("__id", texts["text_hash"]), F.lit(SHARDS)).cast("int").alias("shard"))
    fetched = written(bodies.mapInArrow(_fetch, FETCHED).dropDuplicates(["key", "piece"]), "suffix-fetched")
    compared = repeats_of(fetched, max_group)
    alone = groups.filter("pieces = 1").select("key").join(piece, "key").select("key", "piece", F.lit(None).cast("array<struct<a:int,b:int>>").alias("ranges"))
    found = compared.unionByName(alone)

    start, windows = F.shiftright("at", 16), F.col("at").bitwiseAND(F.lit(255).cast("long")) + 1
    spot = lambda r: F.struct((start + r["a"]).alias("a"), (start + r["b"] + SPAN - 1).alias("b"))
    own = F.when(F.col("ranges").isNull(), F.array(F.struct(start.alias("a"), (start + windows + SPAN - 1).alias("b")))).otherwise(F.transform("ranges", spot))
    hits = placed.join(found, ["key", "piece"]).select("id", "text_hash", F.explode(own).alias("span"))
    # a text's spans are at most as many as its pieces: copies of a row add nothing to the set
    return hits.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))


CUT = T.StructType([*(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])


def _cut_one(body: bytes, spans) -> tuple[int, int, int, bytes]:
    if spans is None or not len(spans):
        return len(body), 0, 0, body
    kept, at, runs = [], 0, 0
    end = -1
    for span in spans:
        a, b = span["a"], span["b"]
        if a > end:
            runs += 1
            kept.append(body[at:a])
        end = at = max(end, b)
    kept.append(body[at:])
    left = b"".join(kept)
    return len(body), len(body) - len(left), runs, left


@F.pandas_udf(CUT)
def cut(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_cut_one(bytes(b), s) for b, s in zip(bodies, spans)], columns=["n_bytes", "n_removed", "n_spans", "kept"])


def _with_spans(docs: DataFrame, doc_id: str, text: str, max_group: int) -> tuple[DataFrame, Column]:
    """docs with a column `__spans` of each text's repeated intervals (null without any), and the text's bytes."""
    spans = repeated_bytes(docs, doc_id, text, max_group).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__hash"))
    return docs.join(spans, same, "left"), body.cast("binary")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "dedup", max_group: int = MAX_GROUP) -> DataFrame:
    """docs with a struct column: n_bytes, n_removed, n_spans and the kept bytes."""
    docs, (doc_id, text) = set_aside(docs, (into,), (doc_id, text))
    joined, body = _with_spans(docs, doc_id, text, max_group)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], cut(body, F.col("__spans")).alias(into))


@F.pandas_udf(T.StringType())
def whole_characters(bodies: pd.Series, spans: pd.Series) -> pd.Series:
    """What is kept of each text, without torn characters; null where nothing goes."""
    return pd.Series([None if s is None or not len(s) else _cut_one(bytes(b), s)[3].decode("utf-8", "ignore") for b, s in zip(bodies, spans)], dtype=object)


def cut_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """docs with the repeated passages cut out of the text; a character that a cut tears is dropped."""
    joined, body = _with_spans(docs, doc_id, text, max_group)
    # only texts that lose something are sent to the worker
    sent = F.when(F.col("__spans").isNotNull(), body)
    left = F.when(F.col("__spans").isNull(), F.col(f"`{text}`")).otherwise(whole_characters(sent, F.col("__spans")))
    return joined.select(*[(left.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    d = "dedup."
    return docs.select("doc_id", F.col(d + "n_bytes").alias("n_bytes"), F.col(d + "n_removed").alias("n_removed"), F.col(d + "n_spans").alias("n_spans"), F.sha2(F.col(d + "kept"), 256).alias("kept_sha256"))
