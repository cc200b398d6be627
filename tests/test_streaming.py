from pyspark.sql import functions as F

from corpuslake.plans import search as plans
from corpuslake.plans import streams
from corpuslake.streaming import jobs


def test_state_lives_across_batches(spark, tmp_path):
    schema = "session_id long, line_idx long, role string, text string"
    source, out, offsets = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "offsets")
    batches = [[(1, 0, "user", "q1")], [(1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (2, 0, "assistant", "stray")], [(1, 3, "user", "q3"), (1, 4, "assistant", "a3")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.drained(jobs.turn_stream(spark.readStream.schema(schema).parquet(source)), out, offsets)
    got = sorted((r.session_id, r.turn_no, r.user_text, r.assistant_text) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1, "q1", "a1"), (1, 2, "q3", "a3")]


def test_failed_extraction_holds_the_offset(spark, tmp_path):
    source, offsets = str(tmp_path / "in"), str(tmp_path / "offsets")
    schema = "session_id long, user_text string, assistant_text string"
    spark.createDataFrame([(1, "u" * 300, "a")], schema).write.parquet(source)
    calls, stored, aside = [], [], []

    def extract(turns):
        calls.append(turns.count())
        if len(calls) == 1:
            raise RuntimeError("no answer")
        return turns

    handle = jobs.mining_handler(extract, lambda df, b: stored.append(df.count()), lambda df, b: aside.append(b))
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    try:
        jobs.each_batch(stream(), handle, offsets)
    except Exception:
        pass
    jobs.each_batch(stream(), handle, offsets)
    assert calls == [1, 1] and stored == [1] and aside == []


def test_search_stream_equals_batch(spark, small):
    from corpuslake.operators import search
    from corpuslake.plans.base import AS_OF, chunks

    prompts = plans._asked(spark, small).withColumn("text", F.lit("what did we decide about it"))
    batch = search.context_block(search.served(prompts, chunks(spark, small), plans._vectors(spark, small), F.lit(AS_OF).cast("timestamp"))[1])
    assert sorted(map(tuple, streams.prompt_search_stream(spark, small).select("query_id", "block").collect())) == sorted(map(tuple, batch.select("query_id", "block").collect()))


def test_lazy_extraction_that_fails_is_not_taken_for_the_store(spark, tmp_path):
    """The extraction fails while its rows are made, not while it is called: nothing is stored or set aside."""
    source, offsets = str(tmp_path / "in"), str(tmp_path / "offsets")
    schema = "session_id long, user_text string, assistant_text string"
    spark.createDataFrame([(1, "u" * 300, "a")], schema).write.parquet(source)
    stored, aside, broken = [], [], [True]

    def extract(turns):
        return turns.withColumn("x", F.assert_true(F.lit(not broken[0])))

    handle = jobs.mining_handler(extract, lambda df, b: stored.append(df.count()), lambda df, b: aside.append(b))
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    try:
        jobs.each_batch(stream(), handle, offsets)
    except Exception:
        pass
    assert stored == [] and aside == []
    broken[0] = False
    jobs.each_batch(stream(), handle, offsets)
    assert stored == [1] and aside == []


def test_search_stream_expands_embeds_and_logs(spark, tmp_path):
    """A model plug-in sees the expanded prompt; trivial prompts are skipped; telemetry has a row for each other prompt."""
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "why did the db break at night"), (2, "ok"), (3, "something else altogether")], "query_id long, text string").coalesce(1).write.parquet(source)
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "doc_id long, embedding array<float>")
    rows = spark.createDataFrame([(10, "a.md", "x" * 400, "high", None, None, "vault"), (11, "b.md", "y" * 90, "low", None, None, "pattern")], "doc_id long, parent_file string, content string, importance string, importance_score double, updated_at timestamp, type string")
    embed = lambda df: df.withColumn("embedding", F.when(F.contains("expanded", F.lit("postgres")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    blocks, logs = [], []
    handle = jobs.prompt_search_handler(rows, vectors, lambda df, b: blocks.extend(df.collect()), F.lit("2024-01-01").cast("timestamp"), embed=embed, log=lambda df, b: logs.extend(df.collect()))
    jobs.each_batch(spark.readStream.schema("query_id long, text string").parquet(source), handle, str(tmp_path / "offsets"))
    by = {r.query_id: r.block for r in blocks}
    assert set(by) == {1, 3} and by[1].index("a.md") < len(by[1]) and "b.md" in by[3] and "a.md" not in by[3].split("</memory>")[0]
    assert {r.query_id: r.n_matches > 0 for r in logs} == {1: True, 3: True}
