"""Queries on turns with state variables: files across batches, expiry, and the state itself read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.plans.base import query
from corpuslake.plans.conversations import TURNS_SQL, _said
from corpuslake.sources.tables import new_path
from corpuslake.streaming import jobs, turns

FILES_SQL = f"""{TURNS_SQL}, f AS (SELECT session_id, turn_no, 'f' || (end_line % 13) AS file FROM turns), s AS (SELECT session_id, file, min(turn_no) AS seen FROM f GROUP BY ALL),
ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seen) AS rn FROM s) WHERE rn <= 10)"""


def _messages(spark, sf_dir):
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return _said(spark, sf_dir).filter("role IN ('user', 'assistant')").withColumn("files", F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("f"), F.col("line_idx") % 13))).otherwise(none))


def _delivered(spark, parts, name: str, timed: bool = False) -> tuple[str, str]:
    """Each part is written and drained before the next comes; (rows, checkpoint)."""
    source, out, offsets = (new_path(spark, f"{name}-{x}") for x in ("in", "out", "offsets"))
    with turns.rocksdb(spark, timed):
        for part in parts:
            part.write.mode("append").parquet(source)
            jobs.drained(turns.turns_with_state(spark.readStream.schema(part.schema).parquet(source), timed), out, offsets)
    return out, offsets


@query("r2_turn_state", f"""WITH {FILES_SQL} SELECT t.session_id, t.turn_no, t.user_text, t.assistant_text, t.start_line, t.end_line, string_agg(s.file, ',' ORDER BY s.rn) AS files
FROM turns t LEFT JOIN ten s ON s.session_id = t.session_id AND s.seen <= t.turn_no GROUP BY ALL""")
def turn_state(spark, sf_dir):
    """The lines come in three deliveries; texts that wait and files seen live in the state between them."""
    said = _messages(spark, sf_dir)
    out, _ = _delivered(spark, [said.filter("line_idx < 3"), said.filter("line_idx BETWEEN 3 AND 7"), said.filter("line_idx > 7")], "turn-state")
    return spark.read.parquet(out).select("session_id", "turn_no", "user_text", "assistant_text", "start_line", "end_line", F.array_join("files", ",").alias("files"))


@query("r2_state_files", f"WITH {FILES_SQL} SELECT session_id, count(*) AS n_files, string_agg(file, ',' ORDER BY file) AS files FROM ten GROUP BY session_id")
def state_files(spark, sf_dir):
    """The list state of files, read back from the stream's checkpoint."""
    said = _messages(spark, sf_dir)
    _, offsets = _delivered(spark, [said.filter("line_idx < 5"), said.filter("line_idx >= 5")], "state-files")
    rows = turns.state_of(spark, offsets, "files").select(F.col("key.session_id").alias("session_id"), F.col("list_element.value.file").alias("file"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.sort_array(F.collect_list("file")), ",").alias("files"))


@query("r3_turn_expiry", f"WITH {TURNS_SQL} SELECT session_id, user_text, start_line, end_line FROM turns WHERE NOT (start_line < 3 AND end_line >= 3)")
def turn_expiry(spark, sf_dir):
    """The first lines, a stray message 35 days later, then the rest: timers have emptied the states of idle sessions."""
    said = _messages(spark, sf_dir)
    at = lambda day: F.timestamp_add("DAY", F.lit(day), F.lit("2024-01-01").cast("timestamp")).alias("ts")
    stray = said.limit(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(0).cast(said.schema["line_idx"].dataType).alias("line_idx"), F.lit("assistant").alias("role"), F.lit("").alias("text"), "files")
    out, _ = _delivered(spark, [said.filter("line_idx < 3").select("*", at(0)), stray.select("*", at(35)), said.filter("line_idx >= 3").select("*", at(36))], "turn-expiry", timed=True)
    return spark.read.parquet(out).select("session_id", "user_text", "start_line", "end_line")
