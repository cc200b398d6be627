import json

from corpuslake.operators import conversations as talk


def line(role, content, **usage):
    return json.dumps({"type": role, "message": {"content": content, "usage": usage}})


def test_lines_messages_turns(spark):
    use = {"type": "tool_use", "name": "Edit", "input": {"file_path": "a.py"}}
    raw = [
        line("user", "first"), line("user", "second"), line("assistant", [{"type": "text", "text": "one"}, use, use], input_tokens=3, output_tokens=5), line("assistant", [{"type": "text", "text": "late"}]), "", "{bad",
        line("system", "x"), line("user", [{"type": "text", "text": "third"}]), line("progress", "y"), line("assistant", [{"type": "text", "text": "two"}, {"type": "tool_use", "name": "Bash", "input": {"path": "no"}}, {"type": "tool_use", "name": "Read", "input": {"path": "b.py"}}]), line("user", "open"),
    ]
    lines = talk.lines_of(spark.createDataFrame([(1, "\n".join(raw))], "session_id int, body string"))
    assert lines.count() == 10
    turns = talk.turns(talk.messages(lines)).orderBy("turn_no").collect()
    assert [(t.user_text, t.assistant_text, t.tool_names, t.files, t.output_tokens, t.start_line, t.end_line) for t in turns] == [("second", "one", ["Edit"], ["a.py"], 5, 1, 2), ("third", "two", ["Bash", "Read"], ["a.py", "b.py"], 0, 7, 9)]


def test_more_than_ten_files(spark):
    rows = [(1, i * 2 + k, role, "t", [], [f"f{i}"] if role == "assistant" else [], 0, 0) for i in range(14) for k, role in enumerate(("user", "assistant"))]
    said = spark.createDataFrame(rows, "session_id int, line_idx int, role string, text string, tools array<string>, files array<string>, input_tokens long, output_tokens long")
    turns = talk.turns(said).orderBy("turn_no").collect()
    assert [len(t.files) for t in turns] == [min(i + 1, 10) for i in range(14)]


def test_responses(spark):
    rows = [
        ("a", '```json\n{"observations": [{"content": " x ", "importance_score": 4, "scope": "global"}, {"content": " "}]}\n```'), ("b", '{"has_observation": true, "content": "old", "tags": ["t"]}'),
        ("c", '{"has_observation": false, "content": "no"}'), ("d", "not json"), ("e", '{"worklog": {"task_summary": "did", "activity_type": "odd"}}'), ("f", '{"worklogs": [{"task_summary": "w", "workstream": "s", "activity_type": "coding"}]}'), ("g", "[]"),
    ]
    df = spark.createDataFrame(rows, "session_id string, raw_json string")
    assert {(r.session_id, r.content, r.importance_score, r.scope) for r in talk.observations(df).collect()} == {("a", "x", 1.0, "global"), ("b", "old", 0.5, "")}
    assert {(r.session_id, r.task_summary, r.workstream, r.activity_type) for r in talk.worklogs(df).collect()} == {("e", "did", "misc", "other"), ("f", "w", "s", "coding")}


def test_prompt_is_built_from_budgeted_turns(spark):
    rows = [(1, 1, "u" * 40, "a" * 60, [], [], 0, 100, 0, 1), (1, 2, "U" * 4000, "A" * 9000, ["Edit"], [], 0, 900, 2, 3)]
    turns = spark.createDataFrame(rows, "session_id int, turn_no int, user_text string, assistant_text string, tool_names array<string>, files array<string>, input_tokens long, output_tokens long, start_line int, end_line int")
    said = spark.createDataFrame([(1, 0, "user", "hello")], "session_id int, line_idx int, role string, text string")
    prompt = talk.requests(turns, said).first().prompt
    budget = min(2000 + int(0.04 * 1000), 8000)
    share = int((budget - 100) * 13000 / 13000)
    user = share // 4
    assert prompt == "Opening: hello\n\n### Turn 1\nUser: " + "u" * 40 + "\nAssistant: " + "a" * 60 + "\nTools: None\n\n### Turn 2\nUser: " + "U" * user + "...\nAssistant: " + "A" * (share - user) + "...\nTools: Edit"


def test_worklog_duplicates(spark):
    stored = spark.createDataFrame([(1, "fix the login page now")], "session_id int, task_summary string")
    new = spark.createDataFrame([(1, 1, "fix the LOGIN page"), (2, 1, "write docs"), (3, 2, "fix the login page now")], "worklog_id int, session_id int, task_summary string")
    kept, dropped = talk.fresh_worklogs(new, stored)
    assert {r.worklog_id for r in kept.collect()} == {2, 3} and {(r.worklog_id, round(r.score, 2)) for r in dropped.collect()} == {(1, 0.8)}


def test_worklogs_are_compared_whole_with_all_before(spark, tmp_path):
    """Long common openings do not drop a row; copies after another opening and copies among new rows do."""
    from corpuslake.plans import registry

    opening, other = "same words at the start " * 8, " ".join(f"other{i}" for i in range(4))
    body = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    said = [(1, 0, "user", opening + body("a")), (1, 4, "user", opening + body("b")), (1, 6, "user", other + " " + body("a")), (1, 8, "user", body("c")), (1, 10, "user", body("c", 38)), (1, 12, "user", body("c")), (2, 4, "user", body("c")), (1, 5, "assistant", body("c")), (1, 14, "user", ""), (1, 16, "user", "")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sets = {(c, t): set(x.lower().split()) for c, t, role, x in said if role == "user"}
    alike = lambda a, b: bool(a | b) and len(a & b) / len(a | b) >= 0.7
    want = {c * 100 + t: any(d == c and u < t and alike(sets[d, u], x) for d, u in sets) for (c, t), x in sets.items() if t >= 4}
    got = [(r.worklog_id, r.dropped) for r in registry.QUERIES["j7_worklog_dedup"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and dict(got) == want == {104: False, 106: True, 108: False, 110: True, 112: True, 204: False, 114: False, 116: False}


def test_messages_of_both_shapes_and_malformed_blocks(spark, tmp_path):
    odd = [line("user", "[not a list"), line("assistant", [5, {"no": 1}, {"type": "text", "text": "said"}], input_tokens="x"), line("user", None), line("user", {"a": 1}), '{"type": 7, "message": 5}', "[]", "{bad", '{"type": "user", "type": "user"}']
    lines = spark.createDataFrame([(1, i, raw) for i, raw in enumerate(odd)] + [(1, 99, None)], "session_id int, line_idx int, raw string")
    want = [(0, "user", "[not a list", []), (1, "assistant", "said", ["5", '{"no":1}']), (2, "user", "", []), (3, "user", '{"a":1}', [])]
    said = talk.messages(lines)
    assert [(m.line_idx, m.role, m.text, m.malformed) for m in said.orderBy("line_idx").collect()] == want
    assert {r.line_idx for r in talk.line_errors(lines).collect()} == {6, 7}
    use = {"type": "tool_use", "name": "Copy", "input": {"path": "b", "file_path": "a", "relative_path": ""}}
    assert talk.messages(spark.createDataFrame([(1, 0, line("assistant", [use, use]))], "session_id int, line_idx int, raw string")).first().files == ["a", "b"]
    plan = said.filter("role = 'user'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1, plan

    talk.parsed_lines(lines).drop("raw").write.parquet(f"{tmp_path}/lines")
    stored = talk.messages(spark.read.parquet(f"{tmp_path}/lines"))
    assert [(m.line_idx, m.role, m.text, m.malformed) for m in stored.orderBy("line_idx").collect()] == want


def test_responses_are_parsed_once_and_errors_kept(spark):
    rows = [("a", '{"observations": [{"content": "x"}, 7, {"tags": []}]}'), ("b", "cut {"), ("c", " "), ("d", None), ("e", '{"observations": 3}'), ("f", "[1]")]
    df = spark.createDataFrame(rows, "session_id string, raw_json string")
    assert [(r.session_id, r.content) for r in talk.observations(df).collect()] == [("a", "x")]
    assert {(r.session_id, r.error, r.found) for r in talk.response_errors(df).collect()} == {("a", "no content", "7"), ("a", "no content", '{"tags":[]}'), ("b", "not JSON", "cut {")}
    for out in (talk.observations(df), talk.worklogs(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parse_json") + plan.count("parseJson") == 1, plan
