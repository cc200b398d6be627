"""The mutable tables as snapshot-producing jobs: upsert, delete, promote, version, validate, route, count retrievals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import ids
from corpuslake.functions.scoring import days_between
from corpuslake.functions.text import front_matter_block, slug
from corpuslake.options import ALL_TYPES, Promotion

PROMOTED_DIRECTORIES = {"observation": "observations", "pattern": "patterns", "summary": "summaries", "learning": "learnings", "decision": "decisions", "worklog": "worklogs"}


def upsert(target: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The target with rows of changes in place of those with the same key."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def lookup(target: DataFrame, wanted: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows found, keys not found); a bare path stands for its vault id."""
    return target.join(wanted, key), wanted.join(target.select(key), key, "left_anti")


def normal_id(doc_id: Column) -> Column:
    return F.when(F.contains(doc_id, F.lit("::")), doc_id).otherwise(F.concat(F.lit("vault::"), doc_id))


def deleted(target: DataFrame, requests: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rest, outcome of each request) (M2, M8, M13): requests that are not confirmed are previews."""
    sure = requests.filter(F.coalesce("confirm", F.lit(True))) if "confirm" in requests.columns else requests
    present = requests.join(target.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    confirmed = F.coalesce("confirm", F.lit(True)) if "confirm" in requests.columns else F.lit(True)
    outcome = F.when(F.col("__there").isNull(), "not_found").when(confirmed, "deleted").otherwise("preview")
    return target.join(sure.select(key), key, "left_anti"), present.select(key, outcome.alias("outcome"))


def with_retrievals(target: DataFrame, served: DataFrame, as_of: Column, key: str = "doc_id") -> DataFrame:
    """Retrieval counts raised by the served ids' increments, rounded to two digits."""
    added = served.groupBy(key).agg(F.sum("increment").alias("__add"))
    joined = target.join(added, key, "left")
    count = F.round(F.coalesce("retrieval_count", F.lit(0.0)) + F.coalesce("__add", F.lit(0.0)), 2)
    return joined.withColumn("retrieval_count", count).withColumn("updated_at", F.when(F.col("__add").isNotNull(), as_of).otherwise(F.col("updated_at"))).drop("__add")


def merged(target: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the given (non-null, non-empty) fields replace the old ones (M7)."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = target.join(new, key, "left")
    given = lambda c: F.nullif(F.col(f"__{c}"), F.lit("")) if dict(changes.dtypes)[c] == "string" else F.col(f"__{c}")
    return joined.select(*[(F.coalesce(given(c), F.col(c)) if c in fields else F.col(c)).alias(c) for c in target.columns])


def row_errors(kind: Column, name: Column, score: Column) -> Column:
    """What is wrong with a row for the ephemeral table."""
    return F.array_compact(F.array(F.when(~F.coalesce(kind.isin(*ALL_TYPES), F.lit(False)), "unknown type"), F.when(kind.isin("pattern", "plan", "decision", "hint") & (F.coalesce(F.trim(name), F.lit("")) == ""), "name required"), F.when(~F.coalesce(score.between(0, 1), F.lit(True)), "score out of range"), F.when((kind == "relationship") & ~F.coalesce(name.rlike(r"^[^:]+::[^:]+$"), F.lit(False)), "relationship needs two names")))


def memory_errors(name: Column, scope: Column, importance: Column, project: Column) -> Column:
    """What is wrong with a memory."""
    return F.array_compact(F.array(F.when(~F.coalesce(name.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"), F.lit(False)), "bad name"), F.when(~F.coalesce(scope.isin("global", "project"), F.lit(False)), "bad scope"), F.when(~F.coalesce(importance.isin("low", "medium", "high", "critical"), F.lit(False)), "bad importance"), F.when((scope == "project") & (F.coalesce(F.trim(project), F.lit("")) == ""), "project required")))


def inserted(target: DataFrame, rows: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(table with the valid, secret-free new rows, outcome of each) (M5): ids from time and content, counts from 0, a
    missing score 0.5 - a score of 0.0 stays."""
    from corpuslake.operators.ingest import secrets

    judged = rows.withColumn("errors", row_errors(F.col("type"), F.col("name"), F.col("importance_score"))).withColumn("secrets", secrets(F.col("content")))
    judged = judged.withColumn("outcome", F.when(F.size("errors") > 0, "invalid").when(F.size("secrets") > 0, "rejected").otherwise("stored"))
    stamp = F.concat(F.col("type"), F.lit("::"), F.unix_millis(as_of).cast("string"), F.lit("-"), F.left(F.md5(F.concat_ws("\x1f", "name", "content").cast("binary")), F.lit(12)))
    new = judged.filter("outcome = 'stored'").select(stamp.alias("doc_id"), "type", "name", "content", F.coalesce("importance_score", F.lit(0.5)).alias("importance_score"), F.lit(0.0).alias("retrieval_count"), F.lit(False).alias("promoted"), as_of.alias("created_at"))
    return upsert(target, new.dropDuplicates(["doc_id"])), judged


def ephemeral_list(rows: DataFrame, kind: str = "", source: str = "", session: str = "", least: float = 0.0, sort_by: str = "importance", ascending: bool = False, limit: int = 20) -> DataFrame:
    """Filtered, sorted, cut, with the total before the cut."""
    kept = rows.filter(F.coalesce("importance_score", F.lit(0.5)) >= least)
    for column, value in (("type", kind), ("source", source), ("session_id", session)):
        if value:
            kept = kept.filter(F.col(column) == value)
    key = {"importance": F.coalesce("importance_score", F.lit(0.5)), "created": F.col("created_at")}.get(sort_by, F.col("doc_id"))
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return kept.orderBy(key.asc() if ascending else key.desc(), "doc_id").limit(limit).join(F.broadcast(total))  # one row


def promotion(rows: DataFrame, as_of: Column, options: Promotion = Promotion()) -> DataFrame:
    """rows with the criteria each meets, the reason and whether it may move (A10)."""
    score, count = F.coalesce("importance_score", F.lit(0.5)), F.coalesce("retrieval_count", F.lit(0.0))
    age = F.floor(days_between(as_of, F.col("created_at")))
    met = F.array_compact(
        F.array(
            F.when(score >= options.importance, F.format_string(f"importance %.2f >= {options.importance}", score)),
            F.when(count > options.retrievals, F.format_string(f"retrievals %.2f > {options.retrievals:g}", count)),
            F.when((age >= options.age_days) & (score >= options.age_importance), F.format_string(f"age %dd >= {options.age_days}d + importance %.2f >= {options.age_importance}", age, score)),
        )
    )
    return rows.withColumn("criteria", met).withColumn("eligible", F.size("criteria") > 0).withColumn("reason", F.when(F.size("criteria") > 0, F.array_join("criteria", "; ")).otherwise("no criterion met"))


def promoted(rows: DataFrame, as_of: Column, options: Promotion = Promotion()) -> tuple[DataFrame, DataFrame]:
    """(durable rows, outcome of each row) (M9, X34): eligible, supported and not moved yet."""
    kinds = F.create_map(*[F.lit(x) for kv in PROMOTED_DIRECTORIES.items() for x in kv])
    judged = promotion(rows, as_of, options).withColumn("into", F.try_element_at(kinds, "type"))
    outcome = F.when(F.coalesce("promoted", F.lit(False)), "already promoted").when(F.col("into").isNull(), "type does not move").when(~F.col("eligible"), "not eligible").otherwise("promoted")
    judged = judged.withColumn("outcome", outcome)
    project = F.nullif(F.element_at(F.split(F.coalesce("project_path", F.lit("")), "/"), -1), F.lit(""))
    stamp = F.date_format(as_of, "yyyyMMdd-HHmmss")
    path = F.concat_ws("/", "into", project, F.concat(F.col("type"), F.lit("-"), slug(F.coalesce("name", F.lit("unnamed"))), F.lit("-"), stamp, F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")))
    moved = judged.filter("outcome = 'promoted'").withColumn("path", path)
    durable = moved.select(F.concat(F.lit("vault::"), "path").alias("doc_id"), F.lit("vault").alias("type"), F.col("type").alias("vault_type"), project.alias("project"), "path", "content", F.col("doc_id").cast("string").alias("promoted_from"), as_of.alias("promoted_at"))
    return durable, judged.select("doc_id", "outcome", "reason")


def promotion_files(durable: DataFrame) -> DataFrame:
    """(path, document) with a generated block, to be written partitioned by type and project."""
    block = front_matter_block(F.create_map(F.lit("type"), F.col("vault_type"), F.lit("promoted_from"), F.col("promoted_from")))
    return durable.select("path", "vault_type", "project", F.concat(block, F.lit("\n"), "content").alias("document"))


def browse(rows: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Candidates by importance with age, retrievals and a star for the eligible ones."""
    judged = promotion(rows, as_of)
    return judged.orderBy(F.desc(F.coalesce("importance_score", F.lit(0.5))), "doc_id").limit(limit).select("doc_id", "importance_score", F.floor(days_between(as_of, F.col("created_at"))).cast("long").alias("age_days"), "retrieval_count", F.when(F.col("eligible"), "*").otherwise("").alias("star"))


def versioned(writes: DataFrame, keys: tuple = ("scope", "project", "name"), order: str = "modified_at") -> DataFrame:
    """Every write of a named memory with its version number and the time of the first write."""
    w = Window.partitionBy(*keys).orderBy(order)
    return writes.withColumn("version", F.row_number().over(w)).withColumn("created_at", F.min(order).over(Window.partitionBy(*keys)))


def latest(versions: DataFrame, keys: tuple = ("scope", "project", "name")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return versions.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def memory_upsert(stored: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, outcomes) (M10, X35): a new version over the stored one; an existing name needs `overwrite`."""
    keys = ["scope", "project", "name"]
    errors = memory_errors(F.col("name"), F.col("scope"), F.col("importance"), F.col("project"))
    old = stored.select(*keys, F.col("version").alias("__version"), F.col("created_at").alias("__created"))
    judged = writes.withColumn("errors", errors).join(old, keys, "left")
    outcome = F.when(F.size("errors") > 0, "invalid").when(F.col("__version").isNotNull() & ~F.coalesce("overwrite", F.lit(False)), "exists").otherwise("written")
    judged = judged.withColumn("outcome", outcome)
    new = judged.filter("outcome = 'written'").withColumn("version", F.coalesce("__version", F.lit(0)) + 1).withColumn("created_at", F.coalesce("__created", "modified_at"))
    new = new.select(*[c for c in stored.columns])
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new), judged.select(*keys, "outcome", "errors")


def memory_rows(writes: DataFrame, as_of: Column) -> DataFrame:
    """Index rows of memory files (X35): id by scope, tags from a comma text, a whole version number (1 if there is none)."""
    tags = F.transform(F.array_remove(F.split(F.coalesce("tags", F.lit("")), ","), ""), lambda t: F.trim(t))
    return writes.select(
        ids.memory_id(F.col("scope"), F.col("project"), F.col("name")).alias("doc_id"), F.lit("memory").alias("type"), "scope", F.when(F.col("scope") == "project", F.col("project")).alias("project"),
        tags.alias("tags"), F.coalesce(F.nullif("importance", F.lit("")), F.lit("medium")).alias("importance"), F.coalesce(F.col("version").try_cast("int"), F.lit(1)).alias("version"), F.col("body").alias("content"), as_of.alias("updated_at"),
    )


def unindexed(memories: DataFrame, chunks: DataFrame) -> DataFrame:
    """memories with their id and whether the index has them."""
    known = chunks.select(F.col("doc_id").alias("memory_id")).distinct().withColumn("__there", F.lit(True))
    return memories.withColumn("memory_id", ids.memory_id(F.col("scope"), F.col("project"), F.col("name"))).join(known, "memory_id", "left").withColumn("indexed", F.col("__there").isNotNull()).drop("__there")


def read_with_fallback(requests: DataFrame, index: DataFrame, files: DataFrame, key: str = "name") -> DataFrame:
    """Index row, else file row marked stale, else a miss."""
    a = index.select(key, F.col("body").alias("__index"))
    b = files.select(key, F.col("body").alias("__file"))
    joined = requests.join(a, key, "left").join(b, key, "left")
    return joined.select(key, F.coalesce("__index", "__file").alias("body"), F.when(F.col("__index").isNotNull(), "index").when(F.col("__file").isNotNull(), "stale").otherwise("missing").alias("source"))


def memory_list(memories: DataFrame, scope: str = "all", project: str = "", tag: str = "", importance: str = "") -> DataFrame:
    """Memories of a scope with filters."""
    kept = memories if scope == "all" else memories.filter(F.col("scope") == scope)
    if project:
        kept = kept.filter((F.col("scope") == "global") | (F.col("project") == project))
    if tag:
        kept = kept.filter(F.array_contains("tags", tag))
    return kept.filter(F.col("importance") == importance) if importance else kept


def routed(requests: DataFrame) -> DataFrame:
    """The operation each request row stands for, or its error (M15): exactly one routing key."""
    keys = [c for c in ("id", "path", "type", "query", "name") if c in requests.columns]
    given = F.size(F.array_compact(F.array(*[F.when(F.coalesce(F.col(k), F.lit("")) != "", F.lit(k)) for k in keys])))
    key = F.coalesce(*[F.when(F.coalesce(F.col(k), F.lit("")) != "", F.lit(k)) for k in keys])
    return requests.withColumn("route", F.when(given == 1, F.concat("verb", F.lit("_by_"), key))).withColumn("error", F.when(given == 0, "no routing key").when(given > 1, "several routing keys"))


def collection_stats(rows: DataFrame) -> DataFrame:
    """Rows in all, by type and by namespace, in one pass (A1)."""
    kind, space = F.coalesce("type", F.lit("unknown")), F.coalesce("namespace", F.lit("unknown"))
    named = rows.select(kind.alias("type"), space.alias("namespace"))
    facets = named.select(F.explode(F.array(F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")), F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")), F.struct(F.lit("namespace").alias("facet"), F.col("namespace").alias("value")))).alias("f"))
    return facets.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def sample_rows(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return rows.orderBy(key).limit(n)


def storage_size(spark, path: str) -> DataFrame:
    """Bytes of a table's files (A3)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.sum("length").alias("n_bytes"), F.count(F.lit(1)).alias("n_files"))


def by_tenant(rows: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    return rows.groupBy(tenant).agg(F.count(F.lit(1)).alias("n"))
