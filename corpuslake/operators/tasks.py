"""Task lists: filters, due policies, analysis, routing, change application and inbox sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators import similarity

# Priority labels, signal words with their published weights.
PRIORITIES = {"p1": 4, "p2": 3, "p3": 2, "p4": 1}
ACTION = r"(?i)\b(buy|call|send|schedule|fix|update|review|check|setup|write|make|prep|validate|book|add)\b"
IMPERATIVE = r"(?i)^\s*(buy|call|send|schedule|fix|update|review|check|setup|write|make|prep|validate|book|add)\b"
DELIVERABLE = r"(?i)\b(report|document|1-pager|presentation)\b"
TECHNICAL = r"(?i)\b(server|release|contract|budget|client)\b"
CAPTURE = ((r"(?i)\b(realized|learned|noticed)\b", 5), (r"(?i)\b(what if|how about)\b", 5), (r"(?i)\b(just had|today i)\b", 4), (r"(?i)\b(grateful|worried|excited)\b", 3), (r"(?i)\b(could be|might be)\b", 4))


def found(tasks: DataFrame, project: str = "", labels: tuple = (), text: str = "", limit: int = 0) -> DataFrame:
    """By project, by a superset of labels, by text in content or description."""
    kept = tasks.filter(F.col("project_id") == project) if project else tasks
    if labels:
        kept = kept.filter(F.size(F.array_except(F.array(*map(F.lit, labels)), F.col("labels"))) == 0)
    if text:
        kept = kept.filter(F.contains(F.lower(F.concat_ws("\n", "content", "description")), F.lit(text.lower())))
    return kept.orderBy("id").limit(limit) if limit else kept


def due_between(tasks: DataFrame, start: Column, days: int, overdue: str = "include", today: Column | None = None) -> DataFrame:
    """By due date under an overdue policy: include, exclude or only."""
    late = F.col("due") < (today if today is not None else start)
    inside = (F.col("due") >= start) & (F.col("due") < F.date_add(start, days))
    rule = {"only": late, "include": late | inside, "exclude": inside}[overdue]
    return tasks.filter(rule)


def projects_named(projects: DataFrame, text: str) -> DataFrame:
    return projects.filter(F.contains(F.lower("name"), F.lit(text.lower())))


def scheduled(tasks: DataFrame, today: Column) -> DataFrame:
    """Tasks with a scheduling label that are due, their action, days overdue; most overdue first."""
    flagged = tasks.filter(F.exists("labels", lambda x: x.endswith("-scheduled")) & (F.col("due") <= today))
    action = F.regexp_extract(F.array_join(F.filter("labels", lambda x: x.rlike(r"-action:")), ","), r"-action:([\w-]+)", 1)
    return flagged.select("id", "due", F.nullif(action, F.lit("")).alias("action"), F.datediff(today, "due").alias("overdue_days"), (action == "").alias("missing_action")).orderBy("due", "id")


def not_ingested(tasks: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    fresh = tasks.filter(~F.array_contains("labels", "ingested"))
    return fresh.join(ledger, "id", "left_anti") if ledger is not None else fresh


def minutes(duration: Column) -> Column:
    """`2h30m`, `1.5h`, `90m` -> minutes."""
    h = F.coalesce(F.regexp_extract(duration, r"([\d.]+)\s*h", 1).try_cast("double"), F.lit(0.0))
    m = F.coalesce(F.regexp_extract(duration, r"(\d+)\s*m", 1).try_cast("int"), F.lit(0))
    return F.nullif((F.floor(h * 60) + m).cast("int"), F.lit(0))


def priority_number(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), F.lower(label))


def classified(tasks: DataFrame, text: str = "content", ambiguous: str = "capture") -> DataFrame:
    """Task or capture by weighted signals (X30): each signal counts once; recurring items are tasks."""
    c = F.col(text)
    task = F.when(c.rlike(ACTION), 5).otherwise(0) + F.when(c.rlike(IMPERATIVE), 4).otherwise(0) + F.when(c.rlike(DELIVERABLE), 4).otherwise(0) + F.when(F.col("due").isNotNull(), 3).otherwise(0) + F.when(c.rlike(TECHNICAL), 2).otherwise(0)
    capture = F.lit(0)
    for pattern, weight in CAPTURE:
        capture = capture + F.when(c.rlike(pattern), weight).otherwise(0)
    kind = F.when(F.coalesce("is_recurring", F.lit(False)), "task").when(task >= 15, "task").when(capture >= 12, "capture").otherwise(ambiguous)
    return tasks.withColumn("task_score", task).withColumn("capture_score", capture).withColumn("kind", kind)


def ruled(tasks: DataFrame, rules: DataFrame, text: str = "content") -> DataFrame:
    """The action of the first rule whose words occur (J17). `rules` (rule_order, needle, action) is a user's short
    list; the join is left to the planner."""
    met = tasks.join(rules, F.contains(F.lower(text), F.lower("needle"))).groupBy("id").agg(F.min_by("action", "rule_order").alias("rule_action"))
    return tasks.join(met, "id", "left")


def analysis(tasks: DataFrame, today: Column) -> DataFrame:
    """Open tasks by age bucket and priority, with how many are large and without children."""
    age = F.datediff(today, "created_at")
    bucket = F.when(age < 7, "new").when(age < 30, "recent").when(age < 90, "aging").otherwise("stale")
    parents = tasks.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("__parent", F.lit(True))
    rows = tasks.filter("NOT is_completed").join(parents, "id", "left")
    large = (F.size(F.split("content", r"\s+")) > 10) & F.col("__parent").isNull()
    return rows.groupBy(bucket.alias("bucket"), "priority").agg(F.count(F.lit(1)).alias("n"), F.count_if(large).alias("n_large"))


def similar(tasks: DataFrame, least: float = 0.7) -> DataFrame:
    """Each open task with the least id of its project that has the same words, and how many others are alike."""
    found = similarity.linked(tasks.filter("NOT is_completed"), "id", "content", "project_id", least)
    return found.select(F.col("within").alias("project_id"), F.col("key").alias("id"), F.col("kind").alias("same_as"), "n_links")


def similar_kinds(tasks: DataFrame, least: float = 0.7) -> DataFrame:
    """The pairs behind similar(): different wordings of a project's open tasks that are alike, each named by its least id."""
    sets = similarity.kinds(tasks.filter("NOT is_completed"), "id", "content", "project_id")
    return similarity.links(sets, least).select(F.col("within").alias("project_id"), "a", "b", F.round("similarity", 4).alias("similarity"))


def focus(tasks: DataFrame, most: int = 3, by: str = "project_id") -> DataFrame:
    """The first few open tasks of each list, the rest hidden."""
    w = Window.partitionBy(by).orderBy(F.desc("priority"), F.asc_nulls_last("due"), "id")
    return tasks.filter("NOT is_completed").withColumn("place", F.row_number().over(w)).withColumn("shown", F.col("place") <= most)


def applied(tasks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, outcome of each task) after ordered changes (seq, id, op, content, priority, due) (M16): the last
    given value of each field counts; unknown ids are errors except for create."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}")
    folded = changes.groupBy("id").agg(last("content"), last("priority"), last("due"), F.max(F.col("op") == "create").alias("__create"), F.max(F.col("op") == "complete").alias("__complete"), F.max(F.col("op") == "delete").alias("__delete"))
    joined = tasks.withColumn("__old", F.lit(True)).join(folded, "id", "full_outer")
    outcome = F.when(F.col("__create").isNull(), "unchanged").when(F.col("__old").isNull() & ~F.col("__create"), "error: no such task").when(F.col("__delete"), "deleted").when(F.col("__complete"), "completed").when(F.col("__old").isNull(), "created").otherwise("updated")
    judged = joined.withColumn("outcome", outcome)
    values = {c: F.coalesce(f"__{c}", c) for c in ("content", "priority", "due")} | {"is_completed": F.coalesce("is_completed", F.lit(False)) | F.coalesce("__complete", F.lit(False))}
    kept = judged.filter(~F.col("outcome").isin("deleted", "error: no such task")).select(*[values.get(c, F.col(c)).alias(c) for c in tasks.columns])
    return kept, judged.filter("outcome <> 'unchanged'").select("id", "outcome")


def inbox_sync(tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """Proposals for what came in: its rule's action, else its class."""
    judged = ruled(classified(not_ingested(tasks)), rules)
    return judged.select("id", F.coalesce("rule_action", "kind").alias("proposal"))


# Where an inbox item of each class goes.
DESTINATIONS = {"journal": "journal", "work": "work", "note": "notes", "person": "people", "discard": "deleted", "skip": "inbox"}


def destination(kind: Column) -> Column:
    """Folder of an inbox item's class; unknown classes stay in the inbox."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DESTINATIONS.items() for x in kv]), kind), F.lit("inbox"))


def corrected(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """The ledger with corrected classes, and what each correction undoes."""
    joined = ledger.join(corrections.select("id", F.col("kind").alias("__kind")), "id", "left")
    return joined.select("id", F.coalesce("__kind", "kind").alias("kind"), F.when(F.col("__kind").isNotNull() & (F.col("__kind") != F.col("kind")), F.concat(F.lit("undo "), "kind")).alias("undo"))


def routing_counts(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("proposal").agg(F.count(F.lit(1)).alias("n"))
