"""Queries of the conversation family over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import conversations as talk
from corpuslake.operators import similarity
from corpuslake.plans.base import query, table
from corpuslake.sources import tables


def _said(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_idx"), "role", "text")


def _turns(spark, sf_dir):
    rows = talk.turns(_said(spark, sf_dir))
    return rows.withColumn("output_tokens", F.length("assistant_text").cast("long")).withColumn("input_tokens", F.length("user_text").cast("long"))


TURNS_SQL = """said AS (SELECT conv_id AS session_id, turn AS line_idx, role, text FROM conversations WHERE role IN ('user', 'assistant')),
paired AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS user_text, lag(line_idx) OVER w AS start_line FROM said WINDOW w AS (PARTITION BY session_id ORDER BY line_idx)),
turns AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY line_idx) AS INTEGER) AS turn_no, user_text, text AS assistant_text, start_line, line_idx AS end_line,
  length(user_text) + length(text) AS chars, CAST(length(text) AS BIGINT) AS output_tokens, CAST(length(user_text) AS BIGINT) AS input_tokens FROM paired WHERE role = 'assistant' AND before = 'user')"""


@query("w1_turn_pairing", f"WITH {TURNS_SQL} SELECT session_id, turn_no, user_text, assistant_text, start_line, end_line FROM turns")
def turn_pairing(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "turn_no", "user_text", "assistant_text", "start_line", "end_line")


@query("w3_last_turn", f"WITH {TURNS_SQL} SELECT session_id, max(turn_no) AS turn_no, max(end_line) AS end_line FROM turns GROUP BY session_id")
def last_turn(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("session_id").agg(F.max("turn_no").alias("turn_no"), F.max("end_line").alias("end_line"))


@query("s3_transcript_lines", "WITH x AS (SELECT conv_id AS session_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT session_id, CAST(i AS INTEGER) AS line_idx, replace(text, chr(10), ' ') AS raw FROM x WHERE i >= 1 AND trim(text) <> '' AND i < 501")
def transcript_lines(spark, sf_dir):
    rows = _said(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return talk.lines_of(rows, 1, 500)


X20_SQL = "SELECT conv_id AS session_id, turn AS line_idx, role, trim(text) AS text, len(string_split(text, ' ')) AS output_tokens, 'Read' AS tool, 'f' || (turn % 3) AS file FROM conversations WHERE role = 'assistant'"


def _block_lines(spark, sf_dir):
    rows = _said(spark, sf_dir).filter("role = 'assistant'")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string>").alias("input")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Read").alias("name"), F.struct(F.concat(F.lit("f"), F.col("line_idx") % 3).alias("file_path")).alias("input")))
    raw = F.to_json(F.struct(F.col("role").alias("type"), F.struct(block.alias("content"), F.struct(F.size(F.split("text", " ")).alias("output_tokens")).alias("usage")).alias("message")))
    return rows.select("session_id", "line_idx", raw.alias("raw"))


def _told(said):
    return said.select("session_id", "line_idx", "role", "text", F.col("output_tokens").cast("long").alias("output_tokens"), F.element_at("tools", 1).alias("tool"), F.element_at("files", 1).alias("file"))


@query("x20_messages", X20_SQL)
def message_parsing(spark, sf_dir):
    return _told(talk.messages(_block_lines(spark, sf_dir)))


@query("x20_stored_messages", X20_SQL)
def stored_messages(spark, sf_dir):
    """Lines parsed once and stored as shredded variants; the messages are read off their fields."""
    return _told(talk.messages(tables.written(talk.parsed_lines(_block_lines(spark, sf_dir)).drop("raw"), "parsed-lines")))


@query("x20_mixed_content", """SELECT conv_id AS session_id, turn AS line_idx, CASE WHEN turn % 2 = 0 THEN '[' || coalesce(text, '') ELSE trim(coalesce(text, '')) END AS text, CASE WHEN turn % 2 = 1 THEN '{"odd":' || turn || '}' END AS malformed
FROM conversations WHERE role IN ('user', 'assistant') AND turn % 5 <> 4""")
def mixed_content(spark, sf_dir):
    """Content that is a text beginning like a list, or a list with a block that has no type; every fifth line is cut off."""
    said = F.coalesce("text", F.lit(""))
    block = F.array(F.to_json(F.struct(F.lit("text").alias("type"), said.alias("text"))), F.concat(F.lit('{"odd":'), "line_idx", F.lit("}")))
    content = F.when(F.col("line_idx") % 2 == 1, F.concat(F.lit("["), F.array_join(block, ","), F.lit("]")))
    plain = F.substring_index(F.to_json(F.struct(F.concat(F.lit("["), said, F.lit("|")).alias("c"))), '{"c":', -1)
    text = F.coalesce(content, F.concat(F.left(plain, F.length(plain) - 3), F.lit('"')))
    raw = F.concat(F.lit('{"type":"'), "role", F.lit('","message":{"content":'), text, F.when(F.col("line_idx") % 5 == 4, "").otherwise("}}"))
    rows = talk.messages(_said(spark, sf_dir).select("session_id", "line_idx", raw.alias("raw")))
    return rows.select("session_id", "line_idx", "text", F.get("malformed", F.lit(0)).alias("malformed"))


@query("w2_files_seen", f"""WITH {TURNS_SQL}, f AS (SELECT session_id, turn_no, 'f' || (end_line % 4) AS file FROM turns), s AS (SELECT session_id, file, min(turn_no) AS seen FROM f GROUP BY ALL)
SELECT t.session_id, t.turn_no, string_agg(s.file, ',' ORDER BY s.seen) AS files FROM turns t JOIN s ON s.session_id = t.session_id AND s.seen <= t.turn_no GROUP BY ALL""")
def files_seen(spark, sf_dir):
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    said = _said(spark, sf_dir).withColumn("tools", none).withColumn("files", F.array(F.concat(F.lit("f"), F.col("line_idx") % 4))).withColumn("input_tokens", F.lit(0)).withColumn("output_tokens", F.lit(0))
    return talk.turns(said).select("session_id", "turn_no", F.array_join("files", ",").alias("files"))


@query("f8_substance_gate", f"WITH {TURNS_SQL} SELECT session_id, CAST(sum(chars) AS BIGINT) AS chars FROM turns GROUP BY session_id HAVING sum(chars) >= 200")
def substance_gate(spark, sf_dir):
    return talk.session_totals(_turns(spark, sf_dir)).filter("passes").select("session_id", F.col("chars").cast("long").alias("chars"))


@query("f9_substantive_turns", f"WITH {TURNS_SQL} SELECT session_id, turn_no FROM turns WHERE chars >= 200")
def substantive_turns(spark, sf_dir):
    return talk.substantive(_turns(spark, sf_dir)).select("session_id", "turn_no")


@query("a5_session_totals", f"WITH {TURNS_SQL} SELECT session_id, count(*) AS n_turns, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM turns GROUP BY session_id")
def session_totals(spark, sf_dir):
    return talk.session_totals(_turns(spark, sf_dir)).select("session_id", "n_turns", F.col("chars").cast("long").alias("chars"), "input_tokens", "output_tokens")


@query("a6_content_budget", f"WITH {TURNS_SQL} SELECT session_id, CAST(least(2000 + floor(sum(output_tokens) * 0.04), 8000) AS BIGINT) AS budget FROM turns GROUP BY session_id")
def content_budget(spark, sf_dir):
    return talk.session_totals(_turns(spark, sf_dir)).select("session_id", "budget")


@query("a7_best_turn", f"WITH {TURNS_SQL} SELECT session_id, turn_no, CAST(chars AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chars DESC, turn_no) AS rn FROM turns WHERE chars >= 200) WHERE rn = 1")
def best_turn(spark, sf_dir):
    return talk.best_turn(_turns(spark, sf_dir)).select("session_id", "turn_no", F.col("score").cast("long").alias("score"))


@query("w5_budget_shares", f"""WITH {TURNS_SQL}, b AS (SELECT *, least(2000 + floor(sum(output_tokens) OVER w * 0.04), 8000) AS budget, sum(CASE WHEN chars > 150 THEN 0 ELSE chars END) OVER w AS shorts, sum(CASE WHEN chars > 150 THEN chars ELSE 0 END) OVER w AS longs FROM turns WINDOW w AS (PARTITION BY session_id)),
s AS (SELECT *, CASE WHEN chars > 150 THEN greatest(150, floor(CAST(greatest(budget - shorts, 0) AS DOUBLE) * chars / longs)) END AS share FROM b)
SELECT session_id, turn_no, CAST(share AS INTEGER) AS share, CAST(CASE WHEN share IS NOT NULL THEN greatest(50, floor(share / 4)) END AS INTEGER) AS user_share FROM s""")
def budget_shares(spark, sf_dir):
    return talk.budgeted(_turns(spark, sf_dir)).select("session_id", "turn_no", "share", "user_share")


@query("j15_opening_message", "SELECT conv_id AS session_id, left(arg_min(text, turn), 300) AS opening FROM conversations WHERE role = 'user' AND turn < 50 AND text <> '' GROUP BY conv_id")
def opening_message(spark, sf_dir):
    return talk.opening(_said(spark, sf_dir))


REQUESTS_SQL = f"""{TURNS_SQL}, b AS (SELECT *, least(2000 + floor(sum(output_tokens) OVER w * 0.04), 8000) AS budget, sum(CASE WHEN chars > 150 THEN 0 ELSE chars END) OVER w AS shorts, sum(CASE WHEN chars > 150 THEN chars ELSE 0 END) OVER w AS longs FROM turns WINDOW w AS (PARTITION BY session_id)),
s AS (SELECT *, CASE WHEN chars > 150 THEN greatest(150, floor(CAST(greatest(budget - shorts, 0) AS DOUBLE) * chars / longs)) END AS share FROM b),
c AS (SELECT *, CAST(greatest(50, floor(share / 4)) AS BIGINT) AS u, CAST(share - greatest(50, floor(share / 4)) AS BIGINT) AS a FROM s),
d AS (SELECT session_id, turn_no, CASE WHEN share IS NOT NULL AND length(user_text) > u THEN left(user_text, u) || '...' ELSE user_text END AS user_cut, CASE WHEN share IS NOT NULL AND length(assistant_text) > a THEN left(assistant_text, a) || '...' ELSE assistant_text END AS assistant_cut FROM c),
t AS (SELECT session_id, string_agg('### Turn ' || turn_no || chr(10) || 'User: ' || user_cut || chr(10) || 'Assistant: ' || assistant_cut || chr(10) || 'Tools: None', chr(10) || chr(10) ORDER BY turn_no) AS turns FROM d GROUP BY session_id),
o AS (SELECT conv_id AS session_id, left(arg_min(text, turn), 300) AS opening FROM conversations WHERE role = 'user' AND turn < 50 AND text <> '' GROUP BY conv_id),
requests AS (SELECT t.session_id, 'Opening: ' || coalesce(opening, '') || chr(10) || chr(10) || turns AS prompt FROM t LEFT JOIN o ON o.session_id = t.session_id)"""


@query("s13_extraction_requests", f"WITH {REQUESTS_SQL} SELECT session_id, prompt FROM requests")
def extraction_requests(spark, sf_dir):
    """Requests written for whatever answers them, and read back."""
    path = tables.new_path(spark, "requests")
    tables.write_requests(talk.requests(_turns(spark, sf_dir), _said(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query("n3_answers", f"""WITH {REQUESTS_SQL} SELECT CAST(session_id AS VARCHAR) AS session_id, '{{"n": ' || length(prompt) || '}}' AS raw_json FROM requests""")
def answers(spark, sf_dir):
    """Requests through an extraction plug-in, which here answers with the length of the prompt."""
    return tables.answered(talk.requests(_turns(spark, sf_dir), _said(spark, sf_dir)), lambda prompt: f'{{"n": {len(prompt)}}}')


@query("x36_turn_requests", f"""WITH {TURNS_SQL} SELECT session_id, turn_no, 'Project: p' || (session_id % 7) || chr(10) || 'Branch: none' || chr(10) || 'User: ' || CASE WHEN length(user_text) > 500 THEN left(user_text, 500) || '...' ELSE coalesce(nullif(user_text, ''), 'none') END || chr(10)
  || 'Assistant: ' || CASE WHEN length(assistant_text) > 1500 THEN left(assistant_text, 1500) || '...' ELSE coalesce(nullif(assistant_text, ''), 'none') END || chr(10) || 'Tools: none' || chr(10) || 'Files: none' || chr(10) AS prompt FROM turns""")
def turn_requests(spark, sf_dir):
    return talk.turn_requests(_turns(spark, sf_dir), F.concat(F.lit("p"), F.col("session_id") % 7), F.lit(None).cast("string"))


@query("x22_observations", "SELECT conv_id AS session_id, CAST(0 AS INTEGER) AS n, trim(text) AS content, CAST(CASE turn % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS importance_score, CASE WHEN turn % 2 = 0 THEN 'global' ELSE '' END AS scope FROM conversations WHERE trim(text) <> ''")
def observations(spark, sf_dir):
    rows = _said(spark, sf_dir)
    score = F.when(F.col("line_idx") % 3 == 0, "7").when(F.col("line_idx") % 3 == 1, "none").otherwise("-2")
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content"), score.alias("importance_score"), F.when(F.col("line_idx") % 2 == 0, "global").otherwise("mars").alias("scope"))).alias("observations"))), F.lit("\n```"))
    return talk.observations(rows.select("session_id", raw.alias("raw_json"))).select("session_id", "n", "content", "importance_score", "scope")


@query("x22_response_errors", """SELECT conv_id AS session_id, turn, CASE turn % 3 WHEN 0 THEN 'not JSON' ELSE 'no content' END AS error, CASE turn % 3 WHEN 0 THEN '{"observations": [' ELSE '{"scope":"s' || turn || '"}' END AS found
FROM conversations WHERE turn % 3 < 2""")
def response_errors(spark, sf_dir):
    """A third of the responses is cut off, a third has an observation without content beside a good one."""
    good = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content")))
    listed = F.concat(F.lit('{"observations": ['), good, F.when(F.col("line_idx") % 3 == 1, F.concat(F.lit(',{"scope":"s'), "line_idx", F.lit('"}'))).otherwise(""), F.lit("]}"))
    raw = F.when(F.col("line_idx") % 3 == 0, '{"observations": [').otherwise(listed)
    rows = _said(spark, sf_dir).select(F.struct("session_id", "line_idx").alias("of"), raw.alias("raw_json"))
    return talk.response_errors(rows, "of").select("of.session_id", F.col("of.line_idx").alias("turn"), "error", "found")


@query("x23_worklogs", "SELECT conv_id AS session_id, trim(text) AS task_summary, CASE WHEN turn % 2 = 0 THEN 'stream' ELSE 'misc' END AS workstream, CASE turn % 3 WHEN 0 THEN 'coding' ELSE 'other' END AS activity_type FROM conversations WHERE trim(text) <> ''")
def worklogs(spark, sf_dir):
    item = F.struct(F.col("text").alias("task_summary"), F.when(F.col("line_idx") % 2 == 0, "stream").otherwise(" ").alias("workstream"), F.when(F.col("line_idx") % 3 == 0, "coding").otherwise("juggling").alias("activity_type"))
    raw = F.to_json(F.struct(F.when(F.col("line_idx") % 2 == 0, item).alias("worklog"), F.when(F.col("line_idx") % 2 == 1, F.array(item)).alias("worklogs")))
    return talk.worklogs(_said(spark, sf_dir).select("session_id", raw.alias("raw_json"))).select("session_id", "task_summary", "workstream", "activity_type")


def _worklog_rows(spark, sf_dir):
    said = _said(spark, sf_dir).filter("role = 'user'")
    return said.select("session_id", (F.col("session_id") * 100 + F.col("line_idx")).alias("worklog_id"), F.col("text").alias("task_summary"), "line_idx", F.concat(F.lit("stream"), F.col("session_id") % 4).alias("workstream"), F.timestamp_add("HOUR", F.col("session_id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"))


WORDS_SQL = r"list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))"


@query("j7_worklog_dedup", f"""WITH w AS (SELECT conv_id AS s, conv_id * 100 + turn AS worklog_id, turn, {WORDS_SQL} AS t FROM conversations WHERE role = 'user'),
p AS (SELECT a.worklog_id, max(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END) AS score FROM w a LEFT JOIN w b ON a.s = b.s AND b.turn < a.turn WHERE a.turn >= 4 GROUP BY a.worklog_id)
SELECT worklog_id, coalesce(score, 0) >= 0.7 AS dropped FROM p""")
def worklog_dedup(spark, sf_dir):
    """Whole texts; lines from 4 on are new and meet the stored lines and every new line before them."""
    rows = _worklog_rows(spark, sf_dir)
    kept, dropped = talk.fresh_worklogs(rows.filter("line_idx >= 4"), rows.filter("line_idx < 4"), at="line_idx")
    return kept.select("worklog_id", F.lit(False).alias("dropped")).union(dropped.select("worklog_id", F.lit(True)))


@query("v5_similar_worklogs", f"""WITH w AS (SELECT conv_id * 100 + turn AS worklog_id, list_sort({WORDS_SQL}) AS t FROM conversations WHERE role = 'user'),
p AS (SELECT a.worklog_id, count(*) AS n FROM w a JOIN w b ON a.worklog_id <> b.worklog_id AND len(a.t) > 0 AND len(b.t) > 0 WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.7 GROUP BY a.worklog_id)
SELECT w.worklog_id, CASE WHEN len(t) > 0 THEN min(w.worklog_id) OVER (PARTITION BY t) ELSE w.worklog_id END AS same_as, coalesce(n, 0) AS n_links FROM w LEFT JOIN p ON p.worklog_id = w.worklog_id""")
def similar_worklogs(spark, sf_dir):
    """Similarity join over all sessions: each worklog's class of equal word sets and how many others are alike."""
    rows = _worklog_rows(spark, sf_dir).withColumn("all", F.lit(1))
    return similarity.linked(rows, "worklog_id", "task_summary", "all", 0.7).select(F.col("key").alias("worklog_id"), F.col("kind").alias("same_as"), "n_links")


@query("a8_workstreams", "SELECT array_to_string(list_sort(list(DISTINCT workstream)), ',') AS workstreams FROM (SELECT 'stream' || (conv_id % 4) AS workstream FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, conv_id * 100 + turn LIMIT 30)")
def known_workstreams(spark, sf_dir):
    return talk.workstreams(_worklog_rows(spark, sf_dir)).select(F.array_join("workstreams", ",").alias("workstreams"))


@query("a28_extraction_cost", f"WITH {TURNS_SQL} SELECT session_id, round(sum(input_tokens / 1e6 * 1.0 + output_tokens / 1e6 * 5.0), 6) AS dollars FROM turns GROUP BY session_id")
def extraction_cost(spark, sf_dir):
    return talk.cost(_turns(spark, sf_dir), "session_id")


@query("x21_token_counts_in_text", "SELECT conv_id, turn, CAST(turn * 7 AS BIGINT) AS n_in, CAST(length(text) AS BIGINT) AS n_out FROM conversations")
def token_counts_in_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("u", F.format_string("%d in, %d out", F.col("turn") * 7, F.length("text")))
    return rows.select("conv_id", "turn", talk.tokens_in_text(F.col("u"), "in").alias("n_in"), talk.tokens_in_text(F.col("u"), "out").alias("n_out"))
