"""Transcripts by byte range and offset, and one file a row with its commit."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslake.plans import files as plans
from corpuslake.sources import files, tables
from corpuslake.streaming import jobs


def read(spark, path, **options):
    return sorted((r["session_id"], r["start_byte"], r["raw"]) for r in files.transcript_lines(spark, path, **options).collect())


def plain(path):
    out = []
    for name in os.listdir(path):
        data, at = open(f"{path}/{name}", "rb").read(), 0
        for line in data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]:
            out.append((name[: -len(".jsonl")], at, line.decode()))
            at += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1000, 1 << 20])
def test_ranges_give_each_line_once(spark, tmp_path, range_bytes):
    rnd = random.Random(range_bytes)
    os.makedirs(tmp_path / "t")
    for s in range(4):
        lines = ["".join(rnd.choice("abcé ") for _ in range(rnd.choice([0, 1, 5, 30]))) for _ in range(rnd.randint(0, 12))]
        (tmp_path / "t" / f"s{s}.jsonl").write_bytes("\n".join(lines).encode() + (b"\n" if s % 2 and lines else b""))
    (tmp_path / "t" / "other.txt").write_text("no transcript\n")
    want = [x for x in plain(str(tmp_path / "t")) if x[0].startswith("s")]
    assert read(spark, str(tmp_path / "t"), range_bytes=range_bytes) == want
    numbers = {(r["session_id"], r["start_byte"]): r["line_idx"] for r in files.numbered(files.transcript_lines(spark, str(tmp_path / "t"), range_bytes=range_bytes)).collect()}
    for session in {x[0] for x in want}:
        assert [numbers[x[:2]] for x in want if x[0] == session] == list(range(sum(x[0] == session for x in want)))


def test_a_large_file_is_many_tasks(spark, tmp_path):
    os.makedirs(tmp_path / "t")
    line = b"x" * 999_999 + b"\n"
    with open(tmp_path / "t" / "big.jsonl", "wb") as f:
        for _ in range(200):
            f.write(line)
    lines = files.transcript_lines(spark, str(tmp_path / "t"), range_bytes=32 << 20)
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() >= 6
    assert lines.agg(F.count(F.lit(1)), F.max("start_byte")).first()[:] == (200, 199_000_000)


def test_reading_goes_on_where_it_ended(spark, tmp_path):
    path = tmp_path / "t"
    os.makedirs(path)
    (path / "a.jsonl").write_text("one\ntwo\n")
    at = files.next_bytes(files.transcript_lines(spark, str(path)))
    with open(path / "a.jsonl", "a") as f:
        f.write("three\n")
    (path / "b.jsonl").write_text("new\n")
    assert read(spark, str(path), start=at) == [("a", 8, "three"), ("b", 0, "new")]
    assert read(spark, str(tmp_path / "nothing")) == []


def test_a_restart_reads_only_what_is_new(spark, tmp_path):
    path, out, offsets = tmp_path / "t", str(tmp_path / "out"), str(tmp_path / "offsets")
    os.makedirs(path)
    (path / "a.jsonl").write_text("one\ntwo\nunfinish")
    (path / "b.jsonl").write_text("zero\n")
    drain = lambda: jobs.drained(files.transcript_stream(spark, str(path), start={"b": 5}), out, offsets)
    told = lambda: sorted((r["session_id"], r["start_byte"], r["raw"]) for r in spark.read.parquet(out).collect())
    drain()
    assert told() == [("a", 0, "one"), ("a", 4, "two")]
    drain()
    assert told() == [("a", 0, "one"), ("a", 4, "two")]
    with open(path / "a.jsonl", "a") as f:
        f.write("ed\nfour\n")
    (path / "b.jsonl").write_text("zero\nfirst\n")
    drain()
    assert told() == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "unfinished"), ("a", 19, "four"), ("b", 5, "first")]


def test_as_many_files_as_rows(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/{i}.md", f"text {i}" if i % 4 else None) for i in range(50)] + [("top.md", "é\n")], "path string, document string").repartition(5)
    files.write_row_files(rows, str(tmp_path / "r"))
    found = {os.path.relpath(os.path.join(d, n), tmp_path / "r"): open(os.path.join(d, n)).read() for d, _, ns in os.walk(tmp_path / "r") for n in ns}
    assert found == {r["path"]: r["document"] or "" for r in rows.collect()}
    assert sorted(r["path"] for r in tables.notes(spark, str(tmp_path / "r")).collect()) == sorted(k for k, v in found.items() if v.strip())
    files.write_row_files(rows.limit(0), str(tmp_path / "r"))
    files.write_row_files(spark.createDataFrame([("more.md", "x")], "path string, document string"), str(tmp_path / "r"))
    assert len(tables.notes(spark, str(tmp_path / "r")).collect()) == sum(bool(v.strip()) for v in found.values()) + 1


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.concat(F.col("id"), F.lit(".md")).alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise("x").alias("document"))
    with pytest.raises(Exception, match="lost"):
        files.write_row_files(rows, str(tmp_path / "r"))
    outside = spark.createDataFrame([("../up.md", "x"), ("a.md", "x")], "path string, document string")
    with pytest.raises(Exception, match="not a path inside"):
        files.write_row_files(outside, str(tmp_path / "r"))
    assert [n for _, _, ns in os.walk(tmp_path) for n in ns] == []


def test_source_equals_the_lines_of_whole_files(spark, small):
    got = {(r["session_id"], r["line_idx"], r["text"]) for r in plans.transcript_source(spark, small).collect()}
    assert got and len({g[:2] for g in got}) == len(got)
