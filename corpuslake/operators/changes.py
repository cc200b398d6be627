"""Change records and structured search: audit tags, histories, date ranges, relevance of keyword hits, link graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.text import links
from corpuslake.sources.tables import new_path, written

# Operations and trigger modes with their letters.
OPERATIONS = {"create": "C", "edit": "E", "delete": "D", "move": "M", "user": "U"}
MODES = {"conversational": "c", "agent": "a"}
SENSITIVE_WORDS = ("salary", "diagnosis", "password", "therapy", "medical")


def audit_tag(app: str, operation: Column, mode: Column, entry_id: Column) -> Column:
    """[app:<op><mode>] or [app:<op><mode>:<entry>]; the user's own changes carry no mode."""
    op = F.element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), operation)
    by = F.when(operation == "user", "").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), mode))
    return F.concat(F.lit(f"[{app}:"), op, by, F.coalesce(F.concat(F.lit(":"), entry_id), F.lit("")), F.lit("]"))


def parsed_tag(app: str, message: Column) -> Column:
    """struct(op, mode, entry_id) of the first tag of a message, nulls without one."""
    pattern = rf"\[{app}:([A-Z])([a-z]?)(?::(\d{{14}}))?\]"
    part = lambda i: F.nullif(F.regexp_extract(message, pattern, i), F.lit(""))
    return F.struct(part(1).alias("op"), part(2).alias("mode"), part(3).alias("entry_id"))


def subject(app: str, operation: Column, description: Column) -> Column:
    return F.when(operation == "user", F.concat(F.lit("User updates: "), description)).otherwise(F.concat(F.lit(app + " "), F.upper(operation), F.lit(": "), description))


def history(changes: DataFrame, app: str = "audit", operation: str = "", since: Column | None = None, path: str = "", limit: int = 0) -> DataFrame:
    """Changes by operation, time and file, newest first (F15, F16): filtered before the limit."""
    kept = changes
    if operation:
        kept = kept.filter(parsed_tag(app, F.concat_ws("\n", "subject", "body"))["op"] == OPERATIONS[operation])
    if since is not None:
        kept = kept.filter(F.col("ts") >= since)
    if path:
        kept = kept.filter(F.exists("files", lambda f: f["path"] == path))
    return kept.orderBy(F.desc("ts"), "commit_hash").limit(limit) if limit else kept


def file_histories(changes: DataFrame, most: int = 5) -> DataFrame:
    """The latest changes of every file (F16)."""
    each = changes.select("commit_hash", "ts", F.explode("files.path").alias("path"))
    w = Window.partitionBy("path").orderBy(F.desc("ts"), "commit_hash")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def audit_errors(operation: Column, description: Column, entry_id: Column, mode: Column) -> Column:
    """Field -> what is wrong with an audit row."""
    checks = F.create_map(
        F.lit("operation"), F.when(~F.coalesce(operation.isin(*OPERATIONS), F.lit(False)), "unknown operation"),
        F.lit("description"), F.when(F.coalesce(F.trim(description), F.lit("")) == "", "empty description"),
        F.lit("entry_id"), F.when(~F.coalesce(entry_id.rlike(r"^\d{14}$"), F.lit(True)), "not 14 digits"),
        F.lit("mode"), F.when((operation != "user") & ~F.coalesce(mode.isin(*MODES), F.lit(False)), "unknown mode"),
    )
    return F.map_filter(checks, lambda k, v: v.isNotNull())


def change_stats(stat_lines: DataFrame, line: str = "stat") -> DataFrame:
    """Files, insertions and deletions of summary lines."""
    n = lambda word: F.coalesce(F.regexp_extract(line, rf"(\d+) {word}", 1).try_cast("long"), F.lit(0))
    return stat_lines.agg(F.sum(n("files? changed")).alias("files"), F.sum(n("insertion")).alias("insertions"), F.sum(n("deletion")).alias("deletions"))


def outside_request(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame, requested: DataFrame) -> DataFrame:
    """Changed paths that a request does not name, sorted."""
    return staged.union(unstaged).union(untracked).distinct().join(requested, "path", "left_anti").orderBy("path")


def scrubbed(changes: DataFrame, patterns: list[str], last: int) -> DataFrame:
    """Bodies of the latest n changes without the lines that match."""
    recent = changes.orderBy(F.desc("ts"), "commit_hash").limit(last).select("commit_hash", F.lit(True).alias("__recent"))
    bad = lambda x: F.lit(False) if not patterns else x.rlike("|".join(f"(?:{p})" for p in patterns))
    clean = F.array_join(F.filter(F.split("body", "\n"), lambda x: ~bad(x)), "\n")
    return changes.join(recent, "commit_hash", "left").withColumn("body", F.when(F.col("__recent"), clean).otherwise(F.col("body"))).drop("__recent")


def reverted(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """For each path of a change, the version before it as a new version."""
    w = Window.partitionBy("path").orderBy("version")
    before = versions.withColumn("previous", F.lag("content").over(w)).withColumn("last", F.max("version").over(Window.partitionBy("path")))
    return before.join(changes.select("path", "version"), ["path", "version"]).select("path", (F.col("last") + 1).alias("version"), F.col("previous").alias("content"), F.when(F.col("previous").isNull(), "removed").otherwise("restored").alias("outcome"))


def moved(docs: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents under their new paths, outcome of each move) (M14): sources must exist, targets must be free."""
    there = docs.select(F.col("path").alias("src")).withColumn("__src", F.lit(True))
    taken = docs.select(F.col("path").alias("dst")).withColumn("__dst", F.lit(True))
    judged = moves.join(there, "src", "left").join(taken, "dst", "left")
    outcome = F.when(F.col("__src").isNull(), "error: no such document").when(F.col("__dst").isNotNull(), "error: target exists").otherwise("moved")
    judged = judged.select("src", "dst", outcome.alias("outcome"))
    good = judged.filter("outcome = 'moved'").select(F.col("src").alias("path"), F.col("dst"))
    return docs.join(good, "path", "left").withColumn("path", F.coalesce("dst", "path")).drop("dst"), judged


def date_range(spec: Column, as_of: Column) -> Column:
    """struct(start, end, error) of `7d`, `2024`, `today`, a date or `date..date`."""
    day = F.to_date(as_of)
    n = F.regexp_extract(spec, r"^(\d+)d$", 1).try_cast("int")
    year = F.regexp_extract(spec, r"^(\d{4})$", 1).try_cast("int")
    one = F.regexp_extract(spec, r"^(\d{4}-\d{2}-\d{2})$", 1).try_cast("date")
    a, b = F.regexp_extract(spec, r"^(\d{4}-\d{2}-\d{2})\.\.", 1).try_cast("date"), F.regexp_extract(spec, r"\.\.(\d{4}-\d{2}-\d{2})$", 1).try_cast("date")
    start = F.when(spec == "today", day).when(n.isNotNull(), F.date_sub(day, n)).when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1))).otherwise(F.coalesce(one, a))
    end = F.when(spec == "today", day).when(n.isNotNull(), day).when(year.isNotNull(), F.make_date(year, F.lit(12), F.lit(31))).otherwise(F.coalesce(one, b))
    return F.struct(start.alias("start"), end.alias("end"), F.when(start.isNull() | end.isNull() | (start > end), "bad date range").alias("error"))


def sensitive_hint(query: Column) -> Column:
    """Why a query may want sensitive directories."""
    return F.when(F.lower(query).rlike(r"\b(" + "|".join(SENSITIVE_WORDS) + r")\b"), "sensitive word").when(query.rlike(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), "looks like a name")


def structured(docs: DataFrame, text: str = "", start: str = "", end: str = "", types: tuple = (), any_tags: tuple = (), all_tags: tuple = (), no_tags: tuple = (), directories: tuple = (), sensitive: tuple = (), include_sensitive: bool = False) -> DataFrame:
    """Any of the filters, at least one."""
    given = [
        (bool(text), lambda: F.contains(F.lower("content"), F.lit(text.lower()))), (bool(start), lambda: F.col("updated_at") >= start), (bool(end), lambda: F.col("updated_at") < end),
        (bool(types), lambda: F.col("type").isin(*types)), (bool(any_tags), lambda: F.arrays_overlap("tags", F.array(*map(F.lit, any_tags)))),
        (bool(all_tags), lambda: F.size(F.array_except(F.array(*map(F.lit, all_tags)), F.col("tags"))) == 0), (bool(no_tags), lambda: ~F.arrays_overlap("tags", F.array(*map(F.lit, no_tags)))),
        (bool(directories), lambda: F.col("directory").isin(*directories)),
    ]
    used = [make() for present, make in given if present]
    if not used:
        raise ValueError("a structured search needs at least one filter")
    if sensitive and not include_sensitive:
        used.append(~F.col("directory").isin(*sensitive))
    for condition in used:
        docs = docs.filter(condition)
    return docs


def keyword_relevance(phrase: str, title: Column, content: Column, updated: Column, as_of: Column) -> Column:
    """1.0/0.9 for the phrase in title/content, 0.7/0.5 for any of its words, +0.1 within a week (T4)."""
    words = [w for w in phrase.lower().split() if w]
    t, c = F.lower(title), F.lower(content)
    any_in = lambda x: F.lit(False) if not words else x.rlike("|".join(f"\\Q{w}\\E" for w in words))
    base = F.when(F.contains(t, F.lit(phrase.lower())), 1.0).when(F.contains(c, F.lit(phrase.lower())), 0.9).when(any_in(t), 0.7).when(any_in(c), 0.5).otherwise(0.0)
    fresh = F.when(F.datediff(as_of, updated).between(0, 7), 0.1).otherwise(0.0)
    return F.when(base > 0, F.least(F.lit(1.0), base + fresh)).otherwise(0.0)


def page(hits: DataFrame, offset: int, limit: int, score: str = "relevance", key: str = "doc_id") -> DataFrame:
    """One page by falling score, with the total and whether more follow."""
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy(F.desc(score), key).offset(offset).limit(limit).join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def hybrid(semantic: DataFrame, keyword: DataFrame, key: str = "doc_id") -> DataFrame:
    """Both hit lists in one: semantic relevance gains 0.15, the greater counts."""
    a, b = semantic.select(key, F.col("relevance").alias("__s")), keyword.select(key, F.col("relevance").alias("__k"))
    found = F.least(F.lit(1.0), F.greatest("__k", F.col("__s") + 0.15))
    return a.join(b, key, "full_outer").select(key, F.round(found, 4).alias("relevance"), F.when(F.col("__s").isNotNull() & F.col("__k").isNotNull(), "both").when(F.col("__s").isNotNull(), "semantic").otherwise("keyword").alias("source"))


def edges(docs: DataFrame, source: str = "path", content: str = "content") -> DataFrame:
    """(src, dst) of the wiki links of documents."""
    return docs.select(F.col(source).alias("src"), F.explode(links(F.col(content))).alias("dst"))


HUB_EDGES = 100_000  # edges of a node that one task follows


def _dealt(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with a chunk, nodes of several chunks with their number)."""
    hubs = graph.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / HUB_EDGES).cast("int").alias("chunks")).filter("chunks > 1")
    return graph.join(hubs, "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk")), hubs


def reachable(graph: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): nodes at most so many links away, at their least depth (J10). `start` has one column.

    Each round's frontier is written, so a round's plan holds the edges, one frontier and one scan of what was seen, at any depth;
    a hub's edges are followed in chunks. It ends early when a round finds nothing. Null nodes lead nowhere."""
    spark = graph.sparkSession
    path = new_path(spark, "reached")
    graph = graph.filter("src IS NOT NULL AND dst IS NOT NULL")
    edges, hubs = (written(x, name) for x, name in zip(_dealt(graph), ("reach-edges", "reach-hubs")))
    first = start.select(F.col(start.columns[0]).alias("start"), F.col(start.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct()
    first.write.parquet(f"{path}/0")
    seen = lambda rounds: spark.read.schema(first.schema).parquet(*[f"{path}/{r}" for r in rounds])
    done = 0
    for d in range(1, depth + 1):
        asked = seen([d - 1]).select("start", F.col("node").alias("src")).join(hubs, "src", "left")
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
        nexts = asked.join(edges, ["src", "chunk"]).select("start", F.col("dst").alias("node")).distinct()
        nexts.join(seen(range(d)), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)).write.parquet(f"{path}/{d}")
        done = d
        if seen([d]).isEmpty():
            break
    return seen(range(1, done + 1)) if done else seen([0]).limit(0)


def result_summary(hits: DataFrame) -> DataFrame:
    """Total, date range and counts by type of search results."""
    by_type = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))
    counts = hits.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("updated_at").alias("a"), F.max("updated_at").alias("b"))
    return counts.agg(F.sum("n").alias("total"), F.min("a").alias("first"), F.max("b").alias("last"), by_type.alias("by_type"))


def browsed(rows: DataFrame, sort: str, reverse: bool = False, limit: int = 20, numeric: tuple = ("importance_score", "retrieval_count")) -> DataFrame:
    """Sorted, then cut (T5); numeric keys count as 0 where missing."""
    key = F.coalesce(F.col(sort).try_cast("double"), F.lit(0.0)) if sort in numeric else F.col(sort)
    return rows.orderBy(key.desc() if reverse else key.asc(), "doc_id").limit(limit)


def directory_listing(paths: DataFrame) -> DataFrame:
    """(directory, entry, kind) of every directory at once."""
    parts = F.split("path", "/")
    level = F.explode(F.sequence(F.lit(1), F.size(parts)))
    each = paths.select(parts.alias("p"), level.alias("i"))
    return each.select(F.array_join(F.slice("p", 1, F.col("i") - 1), "/").alias("directory"), F.element_at("p", F.col("i")).alias("entry"), F.when(F.col("i") == F.size("p"), "file").otherwise("dir").alias("kind")).distinct()


def existence(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """Whether each wanted path is a file, a directory or neither."""
    listed = directory_listing(paths).select(F.concat_ws("/", F.nullif("directory", F.lit("")), "entry").alias("path"), "kind")
    return wanted.join(listed, "path", "left").select("path", F.coalesce(F.col("kind") == "file", F.lit(False)).alias("is_file"), F.coalesce(F.col("kind") == "dir", F.lit(False)).alias("is_dir"))
