"""Conversation mining: transcript lines to turns, gates and budgets, extraction requests and responses, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.text import token_set, truncated
from corpuslake.operators import similarity
from corpuslake.options import Mining
from corpuslake.sources.tables import written

MOST_FILES = 10
NO_FILES_FROM = ("Bash", "WebSearch", "WebFetch")
ACTIVITIES = ("coding", "debugging", "planning", "research", "review", "writing", "configuration", "discussion", "other")


def lines_of(files: DataFrame, start: int = 0, most: int = 500) -> DataFrame:
    """(session_id, body) -> (session_id, line_idx, raw): from a line on, at most so many lines that are not blank (S3)."""
    rows = files.select("session_id", F.posexplode(F.split("body", "\n")).alias("line_idx", "raw")).filter((F.col("line_idx") >= start) & (F.trim("raw") != ""))
    w = Window.partitionBy("session_id").orderBy("line_idx")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def _got(value: Column | str, at: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value) if isinstance(value, str) else value, at, kind)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Transcript lines with their JSON value as a VARIANT column `value` (null: not JSON, or a key occurs twice in one
    object). Written as Parquet, the value is shredded, and messages() then reads only the fields that it needs."""
    return lines.withColumn("value", F.try_parse_json("raw"))


def messages(lines: DataFrame) -> DataFrame:
    """Transcript lines, raw or from parsed_lines(), as messages (X20): role, text, tools, files, tokens, and the blocks that are
    `malformed` (no object with a type), as JSON. Content is a text, whatever it begins with, or a list of blocks; other
    lines and bad JSON go (line_errors() has the latter). A line is parsed once."""
    read = lines if "value" in lines.columns else parsed_lines(lines)
    block = lambda b: F.struct(
        _got(b, "$.type", "string").alias("type"), F.coalesce(_got(b, "$.text", "string"), F.lit("")).alias("text"), _got(b, "$.name", "string").alias("name"),
        F.array_remove(F.array_compact(F.array(*[_got(b, f"$.input.{key}", "string") for key in ("file_path", "relative_path", "path")])), "").alias("files"), b.alias("whole"),
    )
    fields = read.select(
        "session_id", "line_idx", _got("value", "$.type", "string").alias("role"), F.transform(_got("value", "$.message.content", "array<variant>"), block).alias("blocks"),
        F.coalesce(_got("value", "$.message.content", "string"), F.lit("")).alias("plain"),
        *[F.coalesce(_got("value", f"$.message.usage.{key}", "bigint"), F.lit(0)).alias(key) for key in ("input_tokens", "output_tokens")],
    )
    said = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    uses = F.filter("blocks", lambda b: b["type"] == "tool_use")
    files = F.flatten(F.transform(F.filter(uses, lambda b: ~F.coalesce(b["name"], F.lit("")).isin(*NO_FILES_FROM)), lambda b: b["files"]))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    message = F.struct(
        "role", F.trim(F.when(F.col("blocks").isNotNull(), said).otherwise(F.col("plain"))).alias("text"),
        F.coalesce(F.array_distinct(F.transform(uses, lambda b: F.coalesce(b["name"], F.lit("unknown")))), none).alias("tools"),
        F.coalesce(F.array_distinct(files), none).alias("files"), "input_tokens", "output_tokens",
        F.coalesce(F.transform(F.filter("blocks", lambda b: b["type"].isNull()), lambda b: F.to_json(b["whole"])), none).alias("malformed"),
    )
    # a filter on the role alone would be pushed below the parsing and parse again
    kept = fields.select("session_id", "line_idx", F.inline_outer(F.when(F.col("role").isin("user", "assistant"), F.array(message))))
    return kept.filter(F.col("role").isNotNull())


def line_errors(lines: DataFrame) -> DataFrame:
    """(session_id, line_idx, raw) of the lines that are not JSON."""
    return parsed_lines(lines).filter(F.col("value").isNull() & (F.trim("raw") != "")).select("session_id", "line_idx", "raw")


def turns(said: DataFrame, session: str = "session_id", at: str = "line_idx") -> DataFrame:
    """User/assistant messages as turns (W1): an assistant message closes a turn if the message before it is a user's;
    files seen so far, in first-seen order, at most ten (W2). One window over the session's messages."""
    w = Window.partitionBy(session).orderBy(at)
    talk = said.filter(F.col("role").isin("user", "assistant"))
    before = talk.withColumn("b", F.lag(F.struct(F.col("role").alias("role"), F.col("text").alias("text"), F.col(at).alias("at"))).over(w))
    closed = before.filter((F.col("role") == "assistant") & (F.col("b.role") == "user"))
    if "files" not in said.columns:
        none = F.expr("CAST(array() AS ARRAY<STRING>)")
        closed = closed.withColumn("tools", none).withColumn("files", none).withColumn("input_tokens", F.lit(0).cast("long")).withColumn("output_tokens", F.lit(0).cast("long"))
    first = closed.select(session, at, F.posexplode("files").alias("p", "file")).groupBy(session, "file").agg(F.min(F.struct(at, "p")).alias("seen"))
    ten = first.withColumn("rn", F.row_number().over(Window.partitionBy(session).orderBy("seen"))).filter(F.col("rn") <= MOST_FILES)
    listed = ten.groupBy(F.col(session).alias("__s")).agg(F.array_sort(F.collect_list(F.struct("rn", F.col(f"seen.{at}").alias("seen"), "file"))).alias("__seen"))
    joined = closed.join(listed, F.col(session) == F.col("__s"), "left")
    seen = F.coalesce(F.transform(F.filter("__seen", lambda x: x["seen"] <= F.col(at)), lambda x: x["file"]), F.expr("CAST(array() AS ARRAY<STRING>)"))
    return joined.select(
        session, F.row_number().over(w).alias("turn_no"), F.col("b.text").alias("user_text"), F.col("text").alias("assistant_text"), F.col("tools").alias("tool_names"),
        seen.alias("files"), "input_tokens", "output_tokens", F.col("b.at").alias("start_line"), F.col(at).alias("end_line"),
    )


def turn_chars() -> Column:
    return F.length("user_text") + F.length("assistant_text")


def substantive(turn_rows: DataFrame, least: int = Mining().least_turn_chars) -> DataFrame:
    return turn_rows.filter(turn_chars() >= least)


def session_totals(turn_rows: DataFrame, options: Mining = Mining(), session: str = "session_id") -> DataFrame:
    """Characters, tokens, tools, gate and content budget of each session."""
    out = turn_rows.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(turn_chars()).alias("chars"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tool_names")))).alias("tools"),
    )
    budget = F.least(F.lit(options.base_budget) + F.floor(F.col("output_tokens") * options.budget_per_token), F.lit(options.most_budget))
    return out.withColumn("passes", F.col("chars") >= options.least_turn_chars).withColumn("budget", budget.cast("long"))


def best_turn(turn_rows: DataFrame, least: int = 200, session: str = "session_id") -> DataFrame:
    """The turn with most characters, tools and files; the earliest of equal ones."""
    score = turn_chars() + 100 * F.size("tool_names") + F.when(F.size("files") > 0, 200).otherwise(0)
    rows = substantive(turn_rows, least).withColumn("score", score)
    return rows.groupBy(session).agg(F.min(F.struct((-F.col("score")).alias("order"), "turn_no")).alias("x")).select(session, F.col("x.turn_no").alias("turn_no"), (-F.col("x.order")).alias("score"))


def budgeted(turn_rows: DataFrame, options: Mining = Mining(), session: str = "session_id") -> DataFrame:
    """Each turn's texts under the session's budget (W5): short turns whole, the rest shared by length, a quarter for
    the user."""
    w = Window.partitionBy(session)
    long_turn = turn_chars() > options.short_turn_chars
    out = F.sum("output_tokens").over(w)
    budget = F.least(F.lit(options.base_budget) + F.floor(out * options.budget_per_token), F.lit(options.most_budget))
    shorts = F.sum(F.when(long_turn, 0).otherwise(turn_chars())).over(w)
    longs = F.sum(F.when(long_turn, turn_chars()).otherwise(0)).over(w)
    share = F.greatest(F.lit(options.short_turn_chars), F.floor(F.greatest(budget - shorts, F.lit(0)) * turn_chars() / longs)).cast("int")
    user = F.greatest(F.lit(50), F.floor(share / 4)).cast("int")
    rows = turn_rows.withColumn("share", F.when(long_turn, share)).withColumn("user_share", F.when(long_turn, user))
    cut = lambda c, n: F.when(F.col("share").isNull(), F.col(c)).otherwise(truncated(F.col(c), n))
    return rows.withColumn("user_cut", cut("user_text", F.col("user_share"))).withColumn("assistant_cut", cut("assistant_text", F.col("share") - F.col("user_share")))


def opening(said: DataFrame, session: str = "session_id", at: str = "line_idx", within: int = 50, chars: int = 300) -> DataFrame:
    """The first user message among a session's first lines."""
    return said.filter((F.col("role") == "user") & (F.col(at) < within) & (F.col("text") != "")).groupBy(session).agg(F.left(F.min_by("text", at), F.lit(chars)).alias("opening"))


def requests(turn_rows: DataFrame, said: DataFrame, session: str = "session_id", at: str = "line_idx") -> DataFrame:
    """Extraction requests (S13, X36): one prompt for each session from its budgeted turns and its opening."""
    block = F.format_string("### Turn %d\nUser: %s\nAssistant: %s\nTools: %s", "turn_no", "user_cut", "assistant_cut", F.coalesce(F.nullif(F.array_join("tool_names", ", "), F.lit("")), F.lit("None")))
    rows = budgeted(turn_rows, session=session).groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("turns"))
    return rows.join(opening(said, session, at), session, "left").select(session, F.concat(F.lit("Opening: "), F.coalesce("opening", F.lit("")), F.lit("\n\n"), "turns").alias("prompt"))


def turn_requests(turn_rows: DataFrame, project: Column, branch: Column, session: str = "session_id", user_chars: int = 500, assistant_chars: int = 1500) -> DataFrame:
    """One request for each turn (X36): project, branch, both texts within their caps, tools and files."""
    named = lambda title, c: F.concat(F.lit(f"{title}: "), F.coalesce(F.nullif(c, F.lit("")), F.lit("none")), F.lit("\n"))
    prompt = F.concat(
        named("Project", project), named("Branch", branch), named("User", truncated(F.col("user_text"), user_chars)), named("Assistant", truncated(F.col("assistant_text"), assistant_chars)),
        named("Tools", F.array_join("tool_names", ", ")), named("Files", F.array_join("files", ", ")),
    )
    return turn_rows.select(session, "turn_no", prompt.alias("prompt"))


def _answer() -> Column:
    """A response without its fence, as VARIANT; null if it is not JSON."""
    return F.try_parse_json(F.regexp_replace(F.trim("raw_json"), r"\A```(?:json)?\s*|\s*```\z", ""))


def _texts(value: Column, at: str) -> Column:
    return F.coalesce(_got(value, at, "array<string>"), F.expr("CAST(array() AS ARRAY<STRING>)"))


def _observed(responses: DataFrame, session: str) -> DataFrame:
    """(session, answer, items): the list form or the single form as one list of VARIANT."""
    read = responses.select(session, "raw_json", _answer().alias("answer"))
    single = F.when(_got("answer", "$.has_observation", "boolean"), F.array("answer"))
    return read.select(session, "raw_json", "answer", F.coalesce(_got("answer", "$.observations", "array<variant>"), single).alias("items"))


def observations(responses: DataFrame, session: str = "session_id", most: int = Mining().most_observations) -> DataFrame:
    """Responses -> at most three observations each (X22): the list form or the single form, fences stripped, scores
    clamped, scopes checked. A response is parsed once; what can't be read is in response_errors()."""
    item = lambda o: F.struct(
        F.trim(_got(o, "$.content", "string")).alias("content"), _got(o, "$.importance_score", "string").alias("score"), _texts(o, "$.tags").alias("tags"), _got(o, "$.scope", "string").alias("scope"),
    )
    read = _observed(responses, session).select(session, F.transform("items", item).alias("items"))
    rows = read.select(session, F.posexplode_outer(F.slice(F.filter("items", lambda o: o["content"] != ""), 1, most)).alias("n", "o")).filter(F.col("o").isNotNull())
    score = F.least(F.greatest(F.coalesce(F.col("o.score").try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return rows.select(session, "n", F.col("o.content").alias("content"), score.alias("importance_score"), F.col("o.tags").alias("tags"), F.when(F.col("o.scope").isin("global", "project"), F.col("o.scope")).otherwise("").alias("scope"))


def response_errors(responses: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, error, found) of responses that are not JSON, and of observations without a content, as JSON. Blank
    responses are no errors."""
    bad = F.filter("items", lambda o: _got(o, "$.content", "string").isNull())
    error = lambda name, found: F.struct(F.lit(name).alias("error"), found.alias("found"))
    broken = F.when(F.col("answer").isNull() & (F.trim("raw_json") != ""), F.array(error("not JSON", F.col("raw_json"))))
    all_of = F.coalesce(broken, F.transform(bad, lambda o: error("no content", F.to_json(o))))
    return _observed(responses, session).select(session, F.inline_outer(all_of)).filter(F.col("error").isNotNull())


def worklogs(responses: DataFrame, session: str = "session_id") -> DataFrame:
    """Responses -> at most one worklog each, with defaults (X23). A response is parsed once."""
    read = responses.select(session, _answer().alias("answer"))
    one = read.select(session, F.coalesce(*[_got("answer", at, "variant") for at in ("$.worklog", "$.worklogs[0]")]).alias("w"))
    stream, activity = F.trim(_got("w", "$.workstream", "string")), _got("w", "$.activity_type", "string")
    log = F.struct(
        F.trim(_got("w", "$.task_summary", "string")).alias("task_summary"), F.coalesce(F.nullif(stream, F.lit("")), F.lit("misc")).alias("workstream"),
        F.when(activity.isin(*ACTIVITIES), activity).otherwise("other").alias("activity_type"), _texts(F.col("w"), "$.tags").alias("tags"),
    )
    return one.select(session, F.inline_outer(F.array(log))).filter(F.col("task_summary") != "")


def fresh_worklogs(new: DataFrame, stored: DataFrame, session: str = "session_id", least: float = 0.7, key: str = "worklog_id", at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): a new worklog goes if a stored one of its session, or a new one before it (by at, then key), is as
    similar as that (J7, V5, X19). Its score is that of its nearest such worklog, null where none is similar enough.

    Equal word sets are one; different ones are found by the similarity join within the session, stored ones not among
    each other. Worklogs without words stay."""
    words = F.array_sort(token_set(F.col("task_summary")))
    types = new.schema[at or key].dataType, new.schema[key].dataType
    place = lambda is_new, a, k: F.struct(F.lit(is_new).alias("new"), a.alias("at"), k.alias("key"))
    named = lambda rows, where: rows.withColumns({"__place": where, "__words": words}).withColumn("__set", F.sha2(F.array_join("__words", " "), 256))
    fresh = named(new, place(1, F.col(at or key), F.col(key)))
    known = named(stored, place(0, F.lit(None).cast(types[0]), F.lit(None).cast(types[1])))
    columns = [F.col(session).alias("within"), "__set", "__words", "__place"]
    sets = fresh.select(*columns).union(known.select(*columns)).groupBy("within", "__set").agg(F.min("__place").alias("first"), F.any_value("__words").alias("words"), F.count(F.lit(1)).alias("n"))
    sets = written(sets.filter(F.size("words") > 0).withColumn("kind", F.struct("first", "__set")), "worklog-sets")
    before = lambda a, b: (b["first"]["new"] == 1) & (a["first"] < b["first"])
    near = similarity.links(sets, least, before).groupBy("within", F.col("b").alias("kind")).agg(F.max("similarity").alias("__score"))
    firsts = sets.select("within", "__set", "first", "kind").join(near, ["within", "kind"], "left").select(F.col("within").alias("__of"), F.col("__set").alias("__in"), "first", "__score")
    met = fresh.join(firsts, (F.col(session) == F.col("__of")) & (F.col("__set") == F.col("__in")), "left")
    judged = met.select(*[F.col(f"`{c}`") for c in new.columns], F.when(F.col("first") < F.col("__place"), 1.0).otherwise(F.col("__score")).alias("score"))
    return judged.filter(F.coalesce("score", F.lit(0.0)) < least), judged.filter(F.col("score") >= least)


def workstreams(rows: DataFrame, most: int = 30) -> DataFrame:
    """Distinct workstreams but `misc` of the latest worklogs, sorted."""
    return rows.orderBy(F.desc("created_at"), "worklog_id").limit(most).filter("workstream <> 'misc'").agg(F.array_sort(F.collect_set("workstream")).alias("workstreams"))


def cost(rows: DataFrame, by: str, options: Mining = Mining()) -> DataFrame:
    """Dollars of extraction by session, day or backend."""
    dollars = F.col("input_tokens") / 1e6 * options.dollars_in + F.col("output_tokens") / 1e6 * options.dollars_out
    return rows.groupBy(by).agg(F.round(F.sum(dollars), 6).alias("dollars"))


def tokens_in_text(usage: Column, which: str) -> Column:
    """N of "N in, M out" texts, 0 where there is none."""
    return F.coalesce(F.regexp_extract(usage, rf"(\d+)\s*{which}\b", 1).try_cast("long"), F.lit(0))
