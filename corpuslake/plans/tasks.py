"""Queries of the task family (orders as tasks, customers as lists) and of the change and search families (events,
pages and documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import text
from corpuslake.operators import changes, lifecycle, search, tasks
from corpuslake.plans.base import AS_OF, CHUNKS_SQL, chunks, query, table
from corpuslake.sources import tables


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


VERBS = ("buy", "report", "noticed", "fix")


def _tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (k % 4 + 1).cast("int"))
    labels = F.filter(F.array(F.when(k % 3 == 0, "ingested"), F.when(k % 5 == 0, "app-scheduled"), F.when(k % 10 == 0, "app-action:archive")), lambda x: x.isNotNull())
    return o.select(
        k.alias("id"), F.concat(verb, F.lit(" item "), k % 97, F.lit(" of "), F.col("o_custkey") % 7).alias("content"), F.col("o_orderstatus").alias("description"), labels.alias("labels"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_custkey") % 50).alias("project_id"), F.when(k % 20 == 0, k - 1).alias("parent_id"),
        (F.col("o_orderstatus") == "F").alias("is_completed"), F.to_date("o_orderdate").alias("created_at"), F.when(k % 2 == 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("due"), (k % 11 == 0).alias("is_recurring"),
    )


TASKS_SQL = """tasks AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'buy' WHEN 1 THEN 'report' WHEN 2 THEN 'noticed' ELSE 'fix' END || ' item ' || (o_orderkey % 97) || ' of ' || (o_custkey % 7) AS content, o_orderstatus AS description,
  list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'ingested' END, CASE WHEN o_orderkey % 5 = 0 THEN 'app-scheduled' END, CASE WHEN o_orderkey % 10 = 0 THEN 'app-action:archive' END], lambda x: x IS NOT NULL) AS labels,
  CAST(o_orderpriority[1] AS INTEGER) AS priority, o_custkey % 50 AS project_id, CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey - 1 END AS parent_id, o_orderstatus = 'F' AS is_completed, CAST(o_orderdate AS DATE) AS created_at,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 30 END AS due, o_orderkey % 11 = 0 AS is_recurring FROM orders)"""


def _today():
    return F.lit("1998-01-01").cast("date")


@query("f21_find_tasks", f"WITH {TASKS_SQL} SELECT id FROM tasks WHERE project_id = 5 AND list_contains(labels, 'app-scheduled') AND contains(lower(content || chr(10) || description), 'item')")
def find_tasks(spark, sf_dir):
    return tasks.found(_tasks(spark, sf_dir), "5", ("app-scheduled",), "ITEM").select("id")


for _policy, _rule in (("include", "due < DATE '1998-01-01' OR (due >= DATE '1998-01-01' AND due < DATE '1998-01-15')"), ("exclude", "due >= DATE '1998-01-01' AND due < DATE '1998-01-15'"), ("only", "due < DATE '1998-01-01'")):

    @query(f"f22_due_{_policy}", f"WITH {TASKS_SQL} SELECT id FROM tasks WHERE {_rule}")
    def due(spark, sf_dir, policy=_policy):
        return tasks.due_between(_tasks(spark, sf_dir), _today(), 14, policy).select("id")


@query("f23_projects", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '0012')")
def projects(spark, sf_dir):
    return tasks.projects_named(table(spark, sf_dir, "customer").withColumnRenamed("c_name", "name"), "0012").select("c_custkey")


@query("f24_scheduled", f"WITH {TASKS_SQL} SELECT id, CASE WHEN list_contains(labels, 'app-action:archive') THEN 'archive' END AS action, CAST(DATE '1998-01-01' - due AS INTEGER) AS overdue_days, NOT list_contains(labels, 'app-action:archive') AS missing_action FROM tasks WHERE list_contains(labels, 'app-scheduled') AND due <= DATE '1998-01-01'")
def scheduled(spark, sf_dir):
    return tasks.scheduled(_tasks(spark, sf_dir), _today()).select("id", "action", "overdue_days", "missing_action")


@query("t7_due_list", f"WITH {TASKS_SQL} SELECT id, strftime(due, '%Y-%m-%d') AS due FROM tasks WHERE list_contains(labels, 'app-scheduled') AND due <= DATE '1998-01-01'")
def due_list(spark, sf_dir):
    return tasks.scheduled(_tasks(spark, sf_dir), _today()).select("id", F.date_format("due", "yyyy-MM-dd").alias("due"))


@query("f26_not_ingested", f"WITH {TASKS_SQL} SELECT id FROM tasks WHERE NOT list_contains(labels, 'ingested') AND id % 7 <> 0")
def not_ingested(spark, sf_dir):
    rows = _tasks(spark, sf_dir)
    return tasks.not_ingested(rows, rows.filter("id % 7 = 0").select("id")).select("id")


CLASS_SQL = """classed AS (SELECT *, CASE WHEN content ~ '^(buy|fix)' THEN 9 ELSE 0 END + CASE WHEN content LIKE 'report%' THEN 4 ELSE 0 END + CASE WHEN due IS NOT NULL THEN 3 ELSE 0 END AS task_score, CASE WHEN content LIKE 'noticed%' THEN 5 ELSE 0 END AS capture_score FROM tasks)"""


@query("x30_task_class", f"WITH {TASKS_SQL}, {CLASS_SQL} SELECT id, task_score, capture_score, CASE WHEN is_recurring THEN 'task' WHEN task_score >= 15 THEN 'task' WHEN capture_score >= 12 THEN 'capture' ELSE 'capture' END AS kind FROM classed")
def task_class(spark, sf_dir):
    return tasks.classified(_tasks(spark, sf_dir)).select("id", "task_score", "capture_score", "kind")


def _rules(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").alias("rule_order"), F.concat(F.lit("item "), F.col("r_regionkey") + 1).alias("needle"), F.concat(F.lit("to-"), F.lower("r_name")).alias("action"))


RULES_SQL = """ruled AS (SELECT t.id, arg_min('to-' || lower(r_name), r_regionkey) AS rule_action FROM tasks t JOIN region ON contains(content, 'item ' || (r_regionkey + 1)) GROUP BY t.id)"""


@query("j17_routing_rules", f"WITH {TASKS_SQL}, {RULES_SQL} SELECT t.id, rule_action FROM tasks t LEFT JOIN ruled r ON r.id = t.id")
def routing_rules(spark, sf_dir):
    return tasks.ruled(_tasks(spark, sf_dir), _rules(spark, sf_dir)).select("id", "rule_action")


SYNC_SQL = f"WITH {TASKS_SQL}, {CLASS_SQL}, {RULES_SQL}, proposals AS (SELECT c.id, coalesce(rule_action, CASE WHEN is_recurring THEN 'task' ELSE 'capture' END) AS proposal FROM classed c LEFT JOIN ruled r ON r.id = c.id WHERE NOT list_contains(labels, 'ingested'))"


@query("m18_inbox_sync", f"{SYNC_SQL} SELECT id, proposal FROM proposals")
def inbox_sync(spark, sf_dir):
    return tasks.inbox_sync(_tasks(spark, sf_dir), _rules(spark, sf_dir))


@query("a27_routing_counts", f"{SYNC_SQL} SELECT proposal, count(*) AS n FROM proposals GROUP BY proposal")
def routing_counts(spark, sf_dir):
    return tasks.routing_counts(tasks.inbox_sync(_tasks(spark, sf_dir), _rules(spark, sf_dir)))


@query("m19_corrections", f"WITH {TASKS_SQL} SELECT id, CASE WHEN id % 6 = 0 THEN 'task' ELSE 'capture' END AS kind, CASE WHEN id % 6 = 0 THEN 'undo capture' END AS undo FROM tasks")
def corrections(spark, sf_dir):
    ledger = _tasks(spark, sf_dir).select("id", F.lit("capture").alias("kind"))
    return tasks.corrected(ledger, ledger.filter("id % 6 = 0").select("id", F.lit("task").alias("kind")))


@query("a26_task_analysis", f"""WITH {TASKS_SQL} SELECT CASE WHEN DATE '1998-01-01' - created_at < 7 THEN 'new' WHEN DATE '1998-01-01' - created_at < 30 THEN 'recent' WHEN DATE '1998-01-01' - created_at < 90 THEN 'aging' ELSE 'stale' END AS bucket, priority, count(*) AS n,
  count(*) FILTER (len(string_split(content, ' ')) > 10 AND id NOT IN (SELECT parent_id FROM tasks WHERE parent_id IS NOT NULL)) AS n_large FROM tasks WHERE NOT is_completed GROUP BY ALL""")
def task_analysis(spark, sf_dir):
    return tasks.analysis(_tasks(spark, sf_dir), _today())


@query("j16_similar_tasks", rf"""WITH {TASKS_SQL}, w AS (SELECT project_id, id, list_sort(list_distinct(string_split(content, ' '))) AS t FROM tasks WHERE NOT is_completed),
s AS (SELECT project_id, t, min(id) AS same_as, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT a.project_id, a.same_as, sum(b.n) AS n FROM s a JOIN s b ON a.project_id = b.project_id AND a.t <> b.t WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.8 GROUP BY ALL)
SELECT w.project_id, w.id, s.same_as, CAST(s.n - 1 + coalesce(p.n, 0) AS BIGINT) AS n_links FROM w JOIN s ON s.project_id = w.project_id AND s.t = w.t LEFT JOIN p ON p.project_id = w.project_id AND p.same_as = s.same_as""")
def similar_tasks(spark, sf_dir):
    """One row a task: its class of equal words and how many other tasks of the list are alike."""
    return tasks.similar(_tasks(spark, sf_dir), 0.8)


@query("j16_similar_kinds", rf"""WITH {TASKS_SQL}, w AS (SELECT project_id, id, list_sort(list_distinct(string_split(content, ' '))) AS t FROM tasks WHERE NOT is_completed), s AS (SELECT project_id, t, min(id) AS k FROM w GROUP BY ALL),
p AS (SELECT a.project_id, a.k AS a, b.k AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS s FROM s a JOIN s b ON a.project_id = b.project_id AND a.k < b.k) SELECT project_id, a, b, round(s, 4) AS similarity FROM p WHERE s >= 0.8""")
def similar_kinds(spark, sf_dir):
    """The pairs behind it: different wordings of a list that are alike."""
    return tasks.similar_kinds(_tasks(spark, sf_dir), 0.8)


@query("t8_focus_set", f"WITH {TASKS_SQL}, r AS (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, due ASC NULLS LAST, id) AS rn FROM tasks WHERE NOT is_completed) SELECT id, CAST(rn AS INTEGER) AS place, rn <= 3 AS shown FROM r")
def focus_set(spark, sf_dir):
    return tasks.focus(_tasks(spark, sf_dir)).select("id", "place", "shown")


CHANGES = ("update", "complete", "delete", "update")


def _task_changes(spark, sf_dir):
    rows = _tasks(spark, sf_dir)
    k = F.col("id") % 4
    some = rows.filter("id % 3 = 0").select(F.lit(1).alias("seq"), "id", F.when(k == 1, "complete").when(k == 2, "delete").otherwise("update").alias("op"), F.lit("changed").alias("content"), F.lit(None).cast("int").alias("priority"), F.lit(None).cast("date").alias("due"))
    new = rows.filter("id % 50 = 0").select(F.lit(2).alias("seq"), (F.col("id") + 1000000000).alias("id"), F.when(F.col("id") % 2 == 0, "create").otherwise("update").alias("op"), F.lit("new").alias("content"), F.lit(1).alias("priority"), F.lit(None).cast("date").alias("due"))
    return tasks.applied(rows, some.union(new))


@query("m16_task_snapshot", f"WITH {TASKS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'changed' ELSE content END AS content, CAST(priority AS INTEGER) AS priority, is_completed OR (id % 3 = 0 AND id % 4 = 1) AS is_completed FROM tasks WHERE NOT (id % 3 = 0 AND id % 4 = 2) UNION ALL SELECT id + 1000000000, 'new', 1, FALSE FROM tasks WHERE id % 50 = 0 AND id % 2 = 0")
def task_snapshot(spark, sf_dir):
    """The snapshot that the changes leave."""
    return _task_changes(spark, sf_dir)[0].select("id", "content", "priority", "is_completed")


@query("m16_task_changes", f"WITH {TASKS_SQL} SELECT id, CASE id % 4 WHEN 1 THEN 'completed' WHEN 2 THEN 'deleted' ELSE 'updated' END AS outcome FROM tasks WHERE id % 3 = 0 UNION ALL SELECT id + 1000000000, CASE WHEN id % 2 = 0 THEN 'created' ELSE 'error: no such task' END FROM tasks WHERE id % 50 = 0")
def task_changes(spark, sf_dir):
    return _task_changes(spark, sf_dir)[1]


@query("m17_project_create", "SELECT c_custkey, c_name AS name FROM customer UNION ALL SELECT c_custkey + 1000000, 'new ' || c_name FROM customer WHERE c_custkey % 25 = 0")
def project_create(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return lifecycle.upsert(rows, rows.filter("c_custkey % 25 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.concat(F.lit("new "), "name").alias("name")), "c_custkey")


@query("x28_task_minutes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size WHEN 2 THEN p_size * 60 + 30 ELSE 90 END AS minutes FROM part")
def task_minutes(spark, sf_dir):
    k = F.col("p_partkey") % 4
    d = F.when(k == 0, F.concat("p_size", F.lit("h"))).when(k == 1, F.concat("p_size", F.lit("m"))).when(k == 2, F.concat("p_size", F.lit("h30m"))).otherwise("1.5h")
    return table(spark, sf_dir, "part").select("p_partkey", tasks.minutes(d).alias("minutes"))


@query("x29_priorities", "SELECT o_orderkey, 5 - least(CAST(o_orderpriority[1] AS INTEGER), 4) AS priority FROM orders")
def priorities(spark, sf_dir):
    label = F.concat(F.lit("P"), F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4)))
    return table(spark, sf_dir, "orders").select("o_orderkey", tasks.priority_number(label).alias("priority"))


def _changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "view", "edit").when(F.col("event_type") == "purchase", "delete").otherwise("user")
    entry = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMddHHmmss"))
    body = F.concat(F.lit("note "), F.col("event_id") % 9, F.lit("\n"), changes.audit_tag("audit", op, F.lit("agent"), entry))
    files = F.array(F.struct(F.concat(F.lit("n"), F.col("user_id") % 40, F.lit(".md")).alias("path")), F.struct(F.concat(F.lit("m"), F.col("event_id") % 13, F.lit(".md")).alias("path")))
    return e.select(F.col("event_id").alias("commit_hash"), changes.subject("audit", op, F.concat(F.lit("change | "), "event_id")).alias("subject"), body.alias("body"), "ts", files.alias("files"), op.alias("op"), entry.alias("entry"))


CHANGES_SQL = """changes AS (SELECT event_id AS commit_hash, CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'edit' WHEN 'purchase' THEN 'delete' ELSE 'user' END AS op, ts, 'n' || (user_id % 40) || '.md' AS p1, 'm' || (event_id % 13) || '.md' AS p2,
  CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y%m%d%H%M%S') END AS entry FROM events)"""


@query("f15_change_filter", f"WITH {CHANGES_SQL} SELECT commit_hash FROM changes WHERE op = 'edit' AND ts >= TIMESTAMP '2024-01-20 00:00:00' AND (p1 = 'n3.md' OR p2 = 'n3.md')")
def change_filter(spark, sf_dir):
    return changes.history(_changes(spark, sf_dir), "audit", "edit", F.lit("2024-01-20").cast("timestamp"), "n3.md").select("commit_hash")


@query("f16_file_history", f"WITH {CHANGES_SQL}, e AS (SELECT commit_hash, ts, p1 AS path FROM changes UNION ALL SELECT commit_hash, ts, p2 FROM changes), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, commit_hash) AS rank FROM e) SELECT path, commit_hash, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def file_history(spark, sf_dir):
    return changes.file_histories(_changes(spark, sf_dir)).select("path", "commit_hash", "rank")


@query("x27_audit_tags", f"WITH {CHANGES_SQL} SELECT commit_hash, CASE op WHEN 'create' THEN 'C' WHEN 'edit' THEN 'E' WHEN 'delete' THEN 'D' ELSE 'U' END AS op, CASE WHEN op <> 'user' THEN 'a' END AS mode, entry AS entry_id FROM changes")
def audit_tags(spark, sf_dir):
    return _changes(spark, sf_dir).select("commit_hash", changes.parsed_tag("audit", F.col("body")).alias("t")).select("commit_hash", "t.*")


@query("s8_change_scan", f"WITH {CHANGES_SQL} SELECT commit_hash, CASE op WHEN 'user' THEN 'User updates: ' ELSE 'audit ' || upper(op) || ': ' END || 'change | ' || commit_hash AS subject, strftime(ts, '%Y-%m-%d') AS day FROM changes")
def change_scan(spark, sf_dir):
    """The log written as JSON lines, as an export would have it, and scanned."""
    path = tables.new_path(spark, "change-log")
    _changes(spark, sf_dir).select(F.col("commit_hash").cast("string").alias("commit_hash"), "subject", "body", F.col("ts").cast("timestamp").alias("ts"), "files").write.json(path)
    return tables.change_log(spark, path).select(F.col("commit_hash").cast("long").alias("commit_hash"), "subject", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("f17_audit_validation", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'operation' WHEN 1 THEN 'entry_id' ELSE '' END AS bad_fields FROM events")
def audit_validation(spark, sf_dir):
    k = F.col("event_id") % 3
    errors = changes.audit_errors(F.when(k == 0, "explode").otherwise("edit"), F.lit("x"), F.when(k == 1, "123"), F.lit("agent"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.map_keys(errors), ",").alias("bad_fields"))


@query("a30_change_stats", "SELECT CAST(sum(event_id % 5 + 1) AS BIGINT) AS files, CAST(sum(user_id % 100) AS BIGINT) AS insertions, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 0 END) AS BIGINT) AS deletions FROM events")
def change_stats(spark, sf_dir):
    k = F.col("event_id")
    line = F.concat(F.lit(" "), k % 5 + 1, F.lit(" files changed, "), F.col("user_id") % 100, F.lit(" insertions(+)"), F.when(k % 2 == 0, F.concat(F.lit(", "), k % 7, F.lit(" deletions(-)"))).otherwise(""))
    return changes.change_stats(table(spark, sf_dir, "events").select(line.alias("stat")))


@query("u2_outside_request", "SELECT DISTINCT 'p' || (event_id % 300) AS path FROM events WHERE event_id % 300 % 3 <> 0")
def outside_request(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("p"), F.col("event_id") % 300).alias("path"))
    part = lambda i: rows.filter(F.col("event_id") % 3 == i).select("path")
    asked = rows.filter("event_id % 300 % 3 = 0").select("path").distinct()
    return changes.outside_request(part(0), part(1), part(2), asked)


@query("m22_message_scrub", f"WITH {CHANGES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, commit_hash) AS rn FROM changes) SELECT commit_hash, CASE WHEN rn <= 500 AND commit_hash % 9 = 4 THEN 1 ELSE 2 END AS n_lines FROM r")
def message_scrub(spark, sf_dir):
    return changes.scrubbed(_changes(spark, sf_dir), ["^note 4$"], 500).select("commit_hash", F.size(F.split("body", "\n")).alias("n_lines"))


@query("m21_revert", "WITH v AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderkey AS content FROM orders), b AS (SELECT *, lag(content) OVER (PARTITION BY path ORDER BY version) AS previous, max(version) OVER (PARTITION BY path) AS last FROM v) SELECT path, CAST(last + 1 AS INTEGER) AS version, previous AS content, CASE WHEN previous IS NULL THEN 'removed' ELSE 'restored' END AS outcome FROM b WHERE content % 10 = 0")
def revert(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderkey").alias("content"))
    versions = lifecycle.versioned(rows, ("path",), "at").select("path", "version", "content")
    return changes.reverted(versions, versions.filter("content % 10 = 0"))


@query("m14_moves", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'moved' WHEN 1 THEN 'error: target exists' ELSE 'error: no such document' END AS outcome FROM documents")
def moves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/"), "doc_id").alias("path"))
    k = F.col("doc_id") % 3
    asked = docs.select("doc_id", F.when(k == 2, F.concat(F.lit("zz/"), "doc_id")).otherwise(F.col("path")).alias("src"), F.when(k == 1, F.col("path")).otherwise(F.concat(F.lit("b/"), "doc_id")).alias("dst"))
    judged = changes.moved(docs.select("path"), asked.select("src", "dst"))[1]
    return judged.select(F.substring_index("src", "/", -1).cast("long").alias("doc_id"), "outcome")


@query("m14_moved_table", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b/' ELSE 'a/' END || doc_id AS path FROM documents")
def moved_table(spark, sf_dir):
    """The table that the moves leave."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/"), "doc_id").alias("path"))
    k = F.col("doc_id") % 3
    asked = docs.select(F.when(k == 2, F.concat(F.lit("zz/"), "doc_id")).otherwise(F.col("path")).alias("src"), F.when(k == 1, F.col("path")).otherwise(F.concat(F.lit("b/"), "doc_id")).alias("dst"))
    return changes.moved(docs, asked)[0].select("doc_id", "path")


@query("f18_structured_search", f"WITH {CHUNKS_SQL} SELECT doc_id FROM chunks WHERE contains(lower(content), 'the') AND updated_at >= TIMESTAMP '2024-01-10' AND type IN ('vault', 'pattern') AND list_has_any(tags, ['work', 'home']) AND NOT list_contains(tags, 'idea') AND directory <> 'fr'")
def structured_search(spark, sf_dir):
    return changes.structured(chunks(spark, sf_dir), text="THE", start="2024-01-10", types=("vault", "pattern"), any_tags=("work", "home"), no_tags=("idea",), sensitive=("fr",)).select("doc_id")


@query("f19_date_ranges", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '1995-01-01' WHEN 2 THEN '2024-02-10' END AS start_day, CASE o_orderkey % 4 WHEN 0 THEN '2024-02-10' WHEN 1 THEN '1995-12-31' WHEN 2 THEN '2024-02-10' END AS end_day, CASE o_orderkey % 4 WHEN 3 THEN 'bad date range' END AS error FROM orders")
def date_ranges(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    spec = F.when(k == 0, "7d").when(k == 1, "1995").when(k == 2, "today").otherwise("soon")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", changes.date_range(spec, _as_of()).alias("r"))
    return rows.select("o_orderkey", F.date_format("r.start", "yyyy-MM-dd").alias("start_day"), F.date_format("r.end", "yyyy-MM-dd").alias("end_day"), "r.error")


@query("f20_sensitive_hint", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'sensitive word' WHEN 1 THEN 'looks like a name' END AS hint FROM customer")
def sensitive_hint(spark, sf_dir):
    k = F.col("c_custkey") % 3
    q = F.when(k == 0, "my Salary notes").when(k == 1, "lunch with Ada Lovelace").otherwise("the build of today")
    return table(spark, sf_dir, "customer").select("c_custkey", changes.sensitive_hint(q).alias("hint"))


KEYWORD_SQL = "hits AS (SELECT doc_id, CASE WHEN contains(lower(content), 'the that') THEN least(1.0, 0.9 + fresh) WHEN contains(lower(content), 'the') OR contains(lower(content), 'that') THEN least(1.0, 0.5 + fresh) ELSE 0 END AS relevance FROM (SELECT *, CASE WHEN date_diff('day', CAST(updated_at AS DATE), DATE '2024-02-10') BETWEEN 0 AND 7 THEN 0.1 ELSE 0 END AS fresh FROM chunks))"


def _keyword(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    score = changes.keyword_relevance("the that", F.lit(""), F.col("content"), F.col("updated_at"), _as_of())
    return rows.withColumn("relevance", score).filter("relevance > 0")


@query("t4_keyword_relevance", f"WITH {CHUNKS_SQL}, {KEYWORD_SQL} SELECT doc_id, CAST(round(relevance, 4) AS DOUBLE) AS relevance FROM hits WHERE relevance > 0")
def keyword_relevance(spark, sf_dir):
    return _keyword(spark, sf_dir).select("doc_id", F.round("relevance", 4).alias("relevance"))


@query("t3_pages", f"WITH {CHUNKS_SQL}, {KEYWORD_SQL}, k AS (SELECT * FROM hits WHERE relevance > 0) SELECT doc_id, (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k) > 30 AS has_more FROM k ORDER BY relevance DESC, doc_id LIMIT 10 OFFSET 20")
def pages(spark, sf_dir):
    return changes.page(_keyword(spark, sf_dir), 20, 10).select("doc_id", "total", "has_more")


HYBRID_SQL = """s AS (SELECT r.vec_id AS doc_id, round(1 - greatest(0, least(2, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))) / 2, 6) AS r
  FROM embeddings q, embeddings r WHERE q.vec_id = 0 ORDER BY round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9), r.vec_id LIMIT 60), k AS (SELECT doc_id, relevance AS r FROM hits WHERE relevance > 0)"""


def _semantic(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.filter("doc_id = 0").withColumnRenamed("doc_id", "query_id")
    return search.nearest(asked, vectors, 60).select("doc_id", F.round(1 - F.col("distance") / 2, 6).alias("relevance"))


@query("j12_hybrid_merge", f"WITH {CHUNKS_SQL}, {KEYWORD_SQL}, {HYBRID_SQL} SELECT coalesce(s.doc_id, k.doc_id) AS doc_id, CAST(round(least(1.0, greatest(coalesce(k.r, 0), coalesce(s.r + 0.15, 0))), 4) AS DOUBLE) AS relevance, CASE WHEN s.r IS NULL THEN 'keyword' WHEN k.r IS NULL THEN 'semantic' ELSE 'both' END AS source FROM s FULL JOIN k ON s.doc_id = k.doc_id")
def hybrid_merge(spark, sf_dir):
    """The sixty chunks nearest to one query among all vectors, and the keyword hits."""
    return changes.hybrid(_semantic(spark, sf_dir), _keyword(spark, sf_dir))


@query("u3_hybrid_union", f"WITH {CHUNKS_SQL}, {KEYWORD_SQL}, {HYBRID_SQL} SELECT doc_id, list_sort(list(found_by)) AS found_by FROM (SELECT doc_id, 'semantic' AS found_by FROM s UNION SELECT doc_id, 'keyword' FROM k) GROUP BY doc_id")
def hybrid_union(spark, sf_dir):
    """Both result lists as one, each document once."""
    named = lambda rows, name: rows.select("doc_id", F.lit(name).alias("found_by"))
    both = named(_semantic(spark, sf_dir), "semantic").union(named(_keyword(spark, sf_dir), "keyword"))
    return both.groupBy("doc_id").agg(F.array_sort(F.collect_set("found_by")).alias("found_by"))


@query("a25_result_summary", f"WITH {CHUNKS_SQL}, {KEYWORD_SQL} SELECT CAST(count(*) AS BIGINT) AS total, strftime(min(updated_at), '%Y-%m-%d') AS first_day, strftime(max(updated_at), '%Y-%m-%d') AS last_day, count(*) FILTER (type = 'vault') AS n_vault FROM chunks c JOIN hits h ON h.doc_id = c.doc_id WHERE relevance > 0")
def result_summary(spark, sf_dir):
    out = changes.result_summary(_keyword(spark, sf_dir))
    return out.select("total", F.date_format("first", "yyyy-MM-dd").alias("first_day"), F.date_format("last", "yyyy-MM-dd").alias("last_day"), F.col("by_type")["vault"].alias("n_vault"))


@query("t5_browse", f"WITH {CHUNKS_SQL} SELECT doc_id FROM chunks ORDER BY coalesce(importance_score, 0) DESC, doc_id LIMIT 20")
def browse(spark, sf_dir):
    return changes.browsed(chunks(spark, sf_dir), "importance_score", True).select("doc_id")


def _graph(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("n"), F.col("o_custkey") % 200).alias("path"), F.concat(F.lit("see [[n"), F.col("o_orderkey") % 200, F.lit("]] and [[n"), F.col("o_orderkey") % 200, F.lit("|again]]")).alias("content"))


GRAPH_SQL = "graph AS (SELECT DISTINCT 'n' || (o_custkey % 200) AS src, 'n' || (o_orderkey % 200) AS dst FROM orders)"


@query("j11_backlinks", f"WITH {GRAPH_SQL} SELECT dst AS note, count(*) AS n_backlinks FROM graph GROUP BY dst")
def backlinks(spark, sf_dir):
    return changes.edges(_graph(spark, sf_dir)).distinct().groupBy(F.col("dst").alias("note")).agg(F.count(F.lit(1)).alias("n_backlinks"))


@query("j10_link_traversal", f"""WITH {GRAPH_SQL}, s AS (SELECT 'n' || r_regionkey AS start FROM region), d1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN graph ON src = start WHERE dst <> start),
d2 AS (SELECT DISTINCT start, dst AS node FROM d1 JOIN graph ON src = node WHERE dst <> start EXCEPT SELECT start, node FROM d1) SELECT start, node, 1 AS depth FROM d1 UNION ALL SELECT start, node, 2 FROM d2""")
def link_traversal(spark, sf_dir):
    start = table(spark, sf_dir, "region").select(F.concat(F.lit("n"), "r_regionkey").alias("start"))
    return changes.reachable(changes.edges(_graph(spark, sf_dir)).distinct(), start, 2)


@query("s6_directory_listing", "SELECT '' AS directory, 'n' || (doc_id % 50) AS entry, 'dir' AS kind FROM documents GROUP BY ALL UNION ALL SELECT 'n' || (doc_id % 50), doc_id || '.md', 'file' FROM documents")
def directory_listing(spark, sf_dir):
    return changes.directory_listing(table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), F.col("doc_id") % 50, F.lit("/"), "doc_id", F.lit(".md")).alias("path")))


@query("s7_existence", "SELECT p_partkey, p_partkey IN (SELECT doc_id FROM documents) AS is_file FROM part")
def existence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"))
    wanted = table(spark, sf_dir, "part").select(F.concat(F.lit("d/"), "p_partkey").alias("path"))
    return changes.existence(wanted, docs).select(F.substring_index("path", "/", -1).cast("long").alias("p_partkey"), "is_file")


@query("s5_point_reads", "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT doc_id FROM documents) THEN 'found' ELSE 'missing' END AS outcome FROM part")
def point_reads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("vault::"), "doc_id").alias("doc_id"))
    wanted = table(spark, sf_dir, "part").select(lifecycle.normal_id(F.col("p_partkey").cast("string")).alias("doc_id"))
    hit, miss = lifecycle.lookup(docs, wanted)
    both = hit.select("doc_id", F.lit("found").alias("outcome")).union(miss.select("doc_id", F.lit("missing")))
    return both.select(F.substring_index("doc_id", "::", -1).cast("long").alias("p_partkey"), "outcome")


@query("x19_jaccard", r"WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS similarity FROM t")
def word_jaccard(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.jaccard(text.token_set(F.col("p_name")), text.token_set(F.col("p_type"))), 4).alias("similarity"))
