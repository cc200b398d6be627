"""Queries that run the streaming jobs over the driver's tables, read as streams until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.plans.base import AS_OF, chunks, query, table
from corpuslake.plans.conversations import TURNS_SQL, _turns
from corpuslake.plans.search import PREVIEW_SQL, RANKED_SQL, _vectors, budget_sql
from corpuslake.sources.tables import new_path
from corpuslake.streaming import jobs


def _stream(spark, sf_dir, name):
    """A table as a stream; the pattern matches both a file and a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _drained(spark, stream, name):
    path = new_path(spark, name)
    jobs.drained(stream, path, new_path(spark, f"{name}-offsets"))
    return spark.read.schema(stream.schema).parquet(path)


@query("r2_turn_stream", f"WITH {TURNS_SQL} SELECT session_id, turn_no, user_text, assistant_text, start_line, end_line FROM turns")
def turn_stream(spark, sf_dir):
    said = _stream(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_idx"), "role", "text")
    return _drained(spark, jobs.turn_stream(said), "turns")


@query("r7_distinct_stream", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS d FROM events) GROUP BY event_type")
def distinct_stream(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    kept = _drained(spark, jobs.distinct_stream(rows.select("event_type", "user_id", "day", "ts"), ["event_type", "user_id", "day"], late="40 days"), "distinct")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _updated(spark, stream, name, keys, value):
    """A windowed stream drained in update mode; also windows that are still open count."""
    path = new_path(spark, name)
    jobs.each_batch(stream, lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/{batch}"), new_path(spark, f"{name}-offsets"), mode="update")
    rows = spark.read.schema(f"{stream._jdf.schema().toDDL()}, batch long").option("recursiveFileLookup", "true").parquet(path)
    return jobs.latest(rows, keys, value)


@query("r8_feedback_stream", "SELECT user_id AS doc_id, CAST(sum(0.25) AS DOUBLE) AS increment FROM events GROUP BY user_id")
def feedback_stream(spark, sf_dir):
    served = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(0.25).alias("increment"), F.col("ts").cast("timestamp").alias("ts"))
    windows = _updated(spark, jobs.feedback_stream(served), "feedback", ["w", "doc_id"], "increment")
    return windows.groupBy("doc_id").agg(F.sum("increment").alias("increment"))


@query("a17_activity_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def activity_stream(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _updated(spark, jobs.activity_stream(events), "activity", ["w", "event_type"], "n").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("a20_session_stream", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def session_stream(spark, sf_dir):
    """Sessions that the watermark has closed; those it has not are not final yet."""
    events = _stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, jobs.session_stream(events), "sessions").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("r1_resumed_stream", f"WITH {TURNS_SQL} SELECT session_id, turn_no, start_line, end_line FROM turns")
def resumed_stream(spark, sf_dir):
    """The lines come in two deliveries; the second run starts at the offsets and the state that the first one left."""
    source, out, offsets = (new_path(spark, f"resumed-{x}") for x in ("in", "out", "offsets"))
    said = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_idx"), "role", "text")
    for part in (said.filter("line_idx < 3"), said.filter("line_idx >= 3")):
        part.write.mode("append").parquet(source)
        jobs.drained(jobs.turn_stream(spark.readStream.schema(said.schema).parquet(source)), out, offsets)
    return spark.read.parquet(out).select("session_id", "turn_no", "start_line", "end_line")


@query("r3_expiring_state", f"WITH {TURNS_SQL} SELECT session_id, user_text, start_line, end_line FROM turns WHERE NOT (start_line < 3 AND end_line >= 3)")
def expiring_state(spark, sf_dir):
    """The first lines, a stray message 35 days later, then the rest: what waited in a state for its answer is gone."""
    source, out, offsets = (new_path(spark, f"expiring-{x}") for x in ("in", "out", "offsets"))
    said = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_idx"), "role", "text")
    at = lambda day: F.timestamp_add("DAY", F.lit(day), F.lit("2024-01-01").cast("timestamp")).alias("ts")
    stray = spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(0).cast(said.schema["line_idx"].dataType).alias("line_idx"), F.lit("assistant").alias("role"), F.lit("").alias("text"))
    for part, day in ((said.filter("line_idx < 3"), 0), (stray, 35), (said.filter("line_idx >= 3"), 36)):
        part = part.select("*", at(day))
        part.write.mode("append").parquet(source)
        jobs.drained(jobs.turn_stream(spark.readStream.schema(part.schema).parquet(source), expire=True), out, offsets)
    return spark.read.parquet(out).select("session_id", "user_text", "start_line", "end_line")


@query("r4_advance_rules", f"WITH {TURNS_SQL} SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'set aside' ELSE 'stored' END AS place, count(*) AS n_turns FROM turns GROUP BY session_id HAVING sum(chars) >= 200")
def advance_rules(spark, sf_dir):
    """Even sessions come in a batch whose storing fails, odd ones in the next; sessions below the gate leave nothing."""
    source, kept = new_path(spark, "mined-in"), new_path(spark, "mined")
    turns = _turns(spark, sf_dir).select("session_id", "user_text", "assistant_text")
    for rest in (0, 1):
        turns.filter(F.col("session_id") % 2 == rest).coalesce(1).write.mode("append").parquet(source)

    def store(found, batch):
        if batch == 0:
            raise OSError("the store does not answer")
        found.write.mode("overwrite").parquet(f"{kept}/stored")

    handle = jobs.mining_handler(lambda rows: rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns")), store, lambda found, batch: found.write.mode("overwrite").parquet(f"{kept}/aside"))
    jobs.each_batch(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(source), handle, new_path(spark, "mined-offsets"))
    place = lambda name, said: spark.read.parquet(f"{kept}/{name}").select("session_id", F.lit(said).alias("place"), "n_turns")
    return place("stored", "stored").union(place("aside", "set aside"))


@query("r5_prompt_search_stream", rf"""WITH RECURSIVE {RANKED_SQL}, enough AS (SELECT * FROM ranked WHERE relevance >= 0.5), {budget_sql('enough')},
p AS (SELECT e.query_id, e.doc_id, parent_file, relevance, trim(regexp_replace(content, '\s+', ' ', 'g')) AS f FROM enough e JOIN picked ON picked.query_id = e.query_id AND picked.doc_id = e.doc_id)
SELECT query_id, '<context>' || chr(10) || string_agg('<memory source="' || parent_file || '" relevance="' || printf('%.2f', relevance) || '">' || replace(replace(replace({PREVIEW_SQL}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</memory>', chr(10) ORDER BY relevance DESC, doc_id) || chr(10) || '</context>' AS block, count(*) AS n_matches FROM p GROUP BY query_id""")
def prompt_search_stream(spark, sf_dir):
    """Equal to the batch blocks of the same prompts (tests/test_streaming.py)."""
    path = new_path(spark, "blocks")
    prompts = _stream(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit("what did we decide about it").alias("text"))
    handle = jobs.prompt_search_handler(chunks(spark, sf_dir), _vectors(spark, sf_dir), lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}"), F.lit(AS_OF).cast("timestamp"))
    jobs.each_batch(prompts, handle, new_path(spark, "blocks-offsets"))
    return spark.read.parquet(path).drop("batch")


@query("r6_index_sync_stream", "SELECT 'n' || (doc_id % 50) || '/' || doc_id || '.md' AS parent_file FROM documents WHERE doc_id % 10 <> 2")
def index_sync_stream(spark, sf_dir):
    from corpuslake.plans.lifecycle import _files

    files = _files(spark, sf_dir)
    path = new_path(spark, "snapshots")
    feed = _stream(spark, sf_dir, "documents").filter("doc_id % 10 IN (1, 2)").select(F.concat(F.lit("n"), F.col("doc_id") % 50, F.lit("/"), "doc_id", F.lit(".md")).alias("path"))

    def current():
        return table_at[0] if table_at else files.select(F.col("path").alias("parent_file"))

    table_at: list = []

    def replace(snapshot, batch):
        at = f"{path}/{batch}"
        snapshot.select("parent_file").distinct().write.mode("overwrite").parquet(at)
        table_at[:] = [spark.read.parquet(at)]

    jobs.each_batch(feed, jobs.index_sync_handler(current, lambda: files.filter("doc_id % 10 <> 2"), replace, F.lit(AS_OF).cast("timestamp")), new_path(spark, "snapshots-offsets"))
    return current()


@query("n4_sql_functions", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g') AS slug, CAST(round(least(0.1, round(log2(p_size + 1) / 10, 4)), 4) AS DOUBLE) AS bonus FROM part")
def sql_functions(spark, sf_dir):
    from corpuslake.functions import sql_names

    sql_names.register(spark)
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "slug(p_name) AS slug", "round(retrieval_bonus(CAST(p_size AS DOUBLE)), 4) AS bonus")


@query("s9_task_snapshot", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus = 'F' AS is_completed, strftime(o_orderdate, '%Y-%m-%d') AS due FROM orders")
def task_snapshot(spark, sf_dir):
    from corpuslake.sources import tables

    path = new_path(spark, "tasks")
    orders = table(spark, sf_dir, "orders")
    orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("x").alias("content"), (F.col("o_orderstatus") == "F").alias("is_completed"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("due")).write.json(path)
    return tables.task_snapshot(spark, path).select("id", "is_completed", F.date_format("due.date", "yyyy-MM-dd").alias("due"))


@query("s1_corpus_scan", "SELECT source, count(*) AS n_lines, sum(length(text) + 2) AS n_chars FROM documents GROUP BY source")
def corpus_scan(spark, sf_dir):
    """Documents written as text files below a folder for each source, and read back by the recursive scan."""
    from corpuslake.sources import tables

    root = new_path(spark, "notes")
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    docs.write.option("maxRecordsPerFile", 500).partitionBy("source").text(root)
    read = tables.notes(spark, root, "*.txt").select(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source"), F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    return read.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
