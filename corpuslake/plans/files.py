"""Queries that write one file a row and read transcripts by byte range."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import conversations as talk
from corpuslake.operators import lifecycle
from corpuslake.plans.base import query
from corpuslake.plans.conversations import TURNS_SQL, _said
from corpuslake.plans.lifecycle import EPHEMERAL_SQL, OUTCOME_SQL, _as_of, _ephemeral
from corpuslake.sources import files, tables
from corpuslake.streaming import jobs


def _line():
    """A message as a transcript line."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    return F.to_json(F.struct(F.col("role").alias("type"), F.struct(block.alias("content")).alias("message")))


def _transcripts(spark, sf_dir, condition: str = "TRUE") -> str:
    """Each conversation as a file of one message a line."""
    rows = _said(spark, sf_dir).filter(condition).select("session_id", "line_idx", _line().alias("line"))
    bodies = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("x"))
    path = tables.new_path(spark, "transcripts")
    files.write_row_files(bodies, path, F.concat(F.col("session_id").cast("string"), F.lit(".jsonl")), F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n")))
    return path


LINES_SQL = "SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_idx, role, trim(text) AS text FROM conversations"


@query("s3_transcript_source", f"SELECT * FROM ({LINES_SQL}) WHERE role IN ('user', 'assistant')")
def transcript_source(spark, sf_dir):
    """Files in ranges of 256 KB, short ones several to a task; parsed as messages."""
    lines = files.numbered(files.transcript_lines(spark, _transcripts(spark, sf_dir), range_bytes=1 << 18))
    return talk.messages(lines).select("session_id", "line_idx", "role", "text")


@query("r1_transcript_stream", f"WITH {TURNS_SQL} SELECT session_id, turn_no, user_text, assistant_text FROM turns")
def transcript_stream(spark, sf_dir):
    """Lines as a stream by offsets, into turns with state; bytes order a session's lines."""
    lines = files.transcript_stream(spark, _transcripts(spark, sf_dir), range_bytes=1 << 20)
    said = talk.messages(lines.withColumn("line_idx", F.col("start_byte"))).select(F.col("session_id").cast("long").alias("session_id"), "line_idx", "role", "text")
    out = tables.new_path(spark, "transcript-turns")
    jobs.drained(jobs.turn_stream(said), out, tables.new_path(spark, "transcript-offsets"))
    return spark.read.parquet(out).select("session_id", "turn_no", "user_text", "assistant_text")


@query("s10_row_files", rf"""WITH {EPHEMERAL_SQL} SELECT type || 's/p' || (doc_id % 4) || '/' || type || '-row-' || doc_id || '-20240210-000000-' || doc_id || '.md' AS path,
  '---' || chr(10) || 'promoted_from: ' || doc_id || chr(10) || 'type: ' || type || chr(10) || '---' || chr(10) || chr(10) || content AS document FROM judged WHERE {OUTCOME_SQL} = 'promoted'""")
def row_files(spark, sf_dir):
    """Each promoted row is a file with its metadata block in front, read back as notes."""
    path = tables.new_path(spark, "promoted")
    files.write_row_files(lifecycle.promotion_files(lifecycle.promoted(_ephemeral(spark, sf_dir), _as_of())[0]), path)
    return tables.notes(spark, path).select("path", F.col("content").alias("document"))
