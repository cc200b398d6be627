"""State variables: files across batches, time to live, timers."""

import datetime

import pytest

from corpuslake.streaming import jobs, turns

SCHEMA = "session_id long, line_idx long, role string, text string, files array<string>"


@pytest.fixture
def deliver(spark, tmp_path):
    def run(batches, schema=SCHEMA, **options):
        source, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
        with turns.rocksdb(spark, options.get("timed", False)):
            for rows in batches:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
                jobs.drained(turns.turns_with_state(spark.readStream.schema(schema).parquet(source), **options), out, offsets)
        return sorted((r.session_id, r.turn_no, r.user_text, r.assistant_text, r.files, r.start_line, r.end_line) for r in spark.read.parquet(out).collect()), offsets

    return run


def test_texts_and_files_live_across_batches(spark, deliver):
    many = [f"g{i}" for i in range(12)]
    batches = [
        [(1, 0, "user", "q1", None), (2, 0, "assistant", "stray", ["x"])],
        [(1, 2, "user", "q2", []), (1, 1, "assistant", "a1", ["a", "b", "a"])],
        [(1, 3, "assistant", None, ["b", "c"]), (1, 4, "assistant", "again", ["d"]), (2, 1, "user", None, None), (2, 2, "assistant", "a", many)],
    ]
    got, offsets = deliver(batches)
    assert got == [(1, 1, "q1", "a1", ["a", "b"], 0, 1), (1, 2, "q2", "", ["a", "b", "c"], 2, 3), (2, 1, "", "a", many[:10], 1, 2)]
    files = turns.state_of(spark, offsets, "files").selectExpr("key.session_id AS s", "list_element.value.file AS f").collect()
    assert sorted(r.f for r in files if r.s == 1) == ["a", "b", "c"] and len(files) == 13


def test_idle_state_is_gone_after_its_time_to_live(deliver):
    got, _ = deliver([[(1, 0, "user", "q", None)], [(1, 1, "assistant", "a", ["x"])]], idle_ms=1)
    assert got == []


def test_timers_empty_idle_sessions(deliver):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    schema = SCHEMA + ", ts timestamp"
    got, _ = deliver([[(1, 0, "user", "old", None, day(0)), (2, 0, "user", "kept", None, day(20))], [(3, 0, "user", "x", None, day(31))], [(1, 1, "assistant", "late", None, day(31)), (2, 1, "assistant", "in time", None, day(31))]], schema, timed=True)
    assert got == [(2, 1, "kept", "in time", [], 0, 1)]
