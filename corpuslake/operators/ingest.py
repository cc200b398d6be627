"""Corpus ingest: parse, chunk, describe and score documents; find what is missing or changed in the chunk table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpuslake.functions import ids, scoring, text
from corpuslake.options import SECRETS, Chunking, Scoring

SKIPPED_DIRECTORIES = ("templates", ".git", ".obsidian")
SENSITIVE_DIRECTORIES = ("people", "documents")
DIRECTORY_TYPES = {"journal": "journal", "notes": "note", "work": "work", "inbox": "inbox"}
_MARK = "\u0001"
_PIECES = "ARRAY<STRUCT<heading: STRING, level: INT, body: STRING>>"


def parsed(docs: DataFrame) -> DataFrame:
    """(path, content) with format, front matter map, body and title (S2, X10-X14, X17); other formats go."""
    kept = docs.filter(text.file_format(F.col("path")).isNotNull() & (F.trim("content") != ""))
    return _read(kept)


def _read(docs: DataFrame) -> DataFrame:
    fmt = text.file_format(F.col("path"))
    read = docs.withColumn("fmt", fmt).withColumn("front", text.front_matter(F.col("content"), F.col("fmt"))).withColumn("body", text.strip_front_matter(F.col("content"), F.col("fmt")))
    return read.withColumn("title", text.title(F.col("body"), F.col("path"), F.col("fmt")))


def top_directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")


def indexable(path: Column, include_sensitive: bool = False) -> Column:
    """False for non-content and, unless asked for, sensitive top directories."""
    skipped = SKIPPED_DIRECTORIES + (() if include_sensitive else SENSITIVE_DIRECTORIES)
    return ~top_directory(path).isin(*skipped)


def path_problems(path: Column, forbidden: tuple = (".git", ".ssh")) -> Column:
    """Names of what is wrong with a path (F5): absolute, escaping the root at some point, forbidden parts."""
    parts = F.split(path, "/")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda a, p: F.struct((a["now"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("least")),
        lambda a: a["least"],
    )
    return F.array_compact(F.array(F.when(path.startswith("/"), "absolute"), F.when(depth < 0, "escapes_root"), F.when(F.arrays_overlap(parts, F.array(*map(F.lit, forbidden))), "forbidden_part")))


def _masked(body: Column, fmt: Column) -> Column:
    """Heading marks inside closed code fences are put out of reach of the heading pattern."""
    fence = F.when(fmt == "org", r"(?msi)^#\+BEGIN_\w+.*?^#\+END_\w+[ \t]*$").otherwise(r"(?ms)^(`{3,}|~{3,}).*?\n.*?^\1\s*$")
    blocks = F.regexp_extract_all(body, fence, F.lit(0))
    hide = lambda block: F.regexp_replace(block, r"(?m)^(#|\*)", _MARK + "$1")
    masked = F.aggregate(F.array_distinct(blocks), body, lambda acc, block: F.replace(acc, block, hide(block)))
    may_have = F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~")) | (fmt == "org")
    return F.when(may_have, masked).otherwise(body)


_TRIM = r"\A\s+|\s+\z"


def _sections(body: Column, fmt: Column, options: Chunking) -> Column:
    """array<struct(heading, level, body, long)>: the text cut at the headings of the given levels; `long` sections are
    to be packed by paragraphs."""
    low, high = min(options.levels), max(options.levels)
    at = F.when(fmt == "org", rf"(?m)(?=^\*{{{low - 1},{high - 1}}}[ \t]+\S)").otherwise(rf"(?m)(?=^#{{{low},{high}}}[ \t]+\S)")
    mark = F.when(fmt == "org", rf"\A(\*{{{low - 1},{high - 1}}})[ \t]+(\S[^\n]*)").otherwise(rf"\A(#{{{low},{high}}})[ \t]+(\S[^\n]*)")
    kept = F.filter(F.split(_masked(body, fmt), at), lambda s: s.rlike(r"\S"))
    part = lambda s, i: F.call_function("regexp_extract", s, mark, F.lit(i))
    return F.transform(kept, lambda s: F.struct(F.trim(part(s, 2)).alias("heading"), F.length(part(s, 1)).alias("marks"), F.replace(s, F.lit(_MARK), F.lit("")).alias("body")))


def _packed(paragraphs: Column, most: int) -> Column:
    """Paragraphs, joined greedily up to `most` characters: the fold holds what is done and the piece that still grows."""
    grown = F.aggregate(
        paragraphs,
        F.expr("named_struct('done', CAST(array() AS ARRAY<STRING>), 'now', CAST(NULL AS STRING))"),
        lambda a, p: F.when(a["now"].isNull(), F.struct(a["done"].alias("done"), p.alias("now")))
        .when(F.length(a["now"]) + 2 + F.length(p) <= most, F.struct(a["done"].alias("done"), F.concat(a["now"], F.lit("\n\n"), p).alias("now")))
        .otherwise(F.struct(F.array_append(a["done"], a["now"]).alias("done"), p.alias("now"))),
        lambda a: F.array_append(a["done"], a["now"]),
    )
    return F.when(F.size(paragraphs) > 0, grown)


def with_chunks(docs: DataFrame, options: Chunking = Chunking(), into: str = "pieces") -> DataFrame:
    """docs(body, fmt) with heading-aware chunks (X15) as array<struct(heading, level, body)>: sections at the given heading
    levels, closed code fences respected; oversize sections by paragraphs; small pieces joined to the one before.

    Each step is a column of its own, so that nothing is computed twice; texts that are one chunk skip them all."""
    whole = F.regexp_replace("body", _TRIM, "")
    small = F.length("__whole") < options.least_chars
    read = docs.withColumn("__whole", whole).withColumn("__sections", F.when(~small, _sections(F.col("body"), F.col("fmt"), options)))
    is_long = lambda s: (F.length(s["body"]) > options.most_chars) | ((s["heading"] == "") & (F.col("__n") <= 1))
    paragraphs = lambda s: F.filter(F.transform(F.split(s["body"], r"\n\n+"), lambda p: F.regexp_replace(p, _TRIM, "")), lambda p: p != "")
    level = lambda s: s["marks"] + F.when((F.col("fmt") == "org") & (s["heading"] != ""), 1).otherwise(0)
    read = read.withColumn("__n", F.size("__sections"))
    read = read.withColumn("__cut", F.transform("__sections", lambda s: F.struct(s["heading"].alias("heading"), level(s).alias("level"), s["body"].alias("body"), F.when(is_long(s), paragraphs(s)).alias("paragraphs"))))
    read = read.withColumn("__parts", F.transform("__cut", lambda s: F.struct(s["heading"].alias("heading"), s["level"].alias("level"), F.coalesce(_packed(s["paragraphs"], options.most_chars), F.array(s["body"])).alias("parts"))))
    named = lambda s: F.transform(s["parts"], lambda p, i: F.struct(F.when((i > 0) & (s["heading"] != ""), F.concat(s["heading"], F.lit(" (cont.)"))).otherwise(s["heading"]).alias("heading"), s["level"].alias("level"), p.alias("body")))
    read = read.withColumn("__raw", F.flatten(F.transform("__parts", named)))
    piece = lambda p, body: F.struct(p["heading"].alias("heading"), p["level"].alias("level"), body.alias("body"))
    merged = F.aggregate(
        "__raw",
        F.expr(f"named_struct('done', CAST(array() AS {_PIECES}), 'now', CAST(NULL AS STRUCT<heading: STRING, level: INT, body: STRING>))"),
        lambda a, p: F.when(a["now"].isNull(), F.struct(a["done"].alias("done"), piece(p, p["body"]).alias("now")))
        .when(F.length(F.regexp_replace(p["body"], _TRIM, "")) < options.least_chars, F.struct(a["done"].alias("done"), piece(a["now"], F.concat(a["now"]["body"], F.lit("\n\n"), p["body"])).alias("now")))
        .otherwise(F.struct(F.array_append(a["done"], a["now"]).alias("done"), piece(p, p["body"]).alias("now"))),
        lambda a: F.when(a["now"].isNotNull(), F.array_append(a["done"], a["now"])).otherwise(a["done"]),
    )
    read = read.withColumn("__merged", merged)
    one = F.array(F.struct(F.lit("").alias("heading"), F.lit(0).alias("level"), F.col("__whole").alias("body")))
    out = F.coalesce(F.transform("__merged", lambda p: piece(p, F.regexp_replace(p["body"], _TRIM, ""))), one)
    return read.withColumn(into, out).select(*[F.col(f"`{c}`") for c in docs.columns], into)


def chunk_rows(docs: DataFrame, as_of: Column, scoring_options: Scoring = Scoring(), options: Chunking = Chunking(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed documents as rows of the chunk table: ids, metadata and importance (X16, X2, M1), and the columns to keep."""
    directory = top_directory(F.col("path"))
    types = F.create_map(*[F.lit(x) for kv in DIRECTORY_TYPES.items() for x in kv])
    vault_type = F.coalesce(F.try_element_at("front", F.lit("type")), F.try_element_at(types, directory), F.nullif(directory, F.lit("")), F.lit("document"))
    created = F.try_element_at("front", F.lit("created")).try_cast("timestamp")
    each = with_chunks(docs, options).withColumn("total", F.size("pieces"))
    rows = each.select("*", F.posexplode("pieces").alias("chunk_index", "piece")).withColumn("concepts", scoring.concept_bonus(F.col("piece.body"), scoring_options))
    stated = F.try_element_at("front", F.lit("importance"))
    return rows.select(
        ids.chunk_id(F.col("path"), F.when(F.col("total") > 1, F.col("chunk_index"))).alias("doc_id"), F.col("path").alias("parent_file"),
        F.lit("vault::").alias("namespace"), F.lit("vault").alias("type"), vault_type.alias("vault_type"), directory.alias("directory"), "title",
        F.array_remove(F.split(F.coalesce(F.try_element_at("front", F.lit("tags")), F.lit("")), ","), "").alias("tags"),
        F.coalesce(stated, F.lit("medium")).alias("importance"),
        F.round(scoring.importance_with(F.col("concepts"), vault_type, stated, created, F.lit(0), as_of, scoring_options), 4).alias("importance_score"),
        "chunk_index", F.col("total").alias("chunk_total"), F.col("piece.heading").alias("chunk_heading"), F.col("piece.body").alias("content"), created.alias("created_at"), *keep,
    )


#: What can become of a document in a rebuild.
OUTCOMES = ("indexed", "skipped", "error: no path", "error: unknown format", "error: no content", "error: blank")


def _outcome(include_sensitive: bool) -> Column:
    path, content = F.col("path"), F.col("content")
    return (
        F.when(path.isNull(), "error: no path").when(~indexable(path, include_sensitive), "skipped").when(text.file_format(path).isNull(), "error: unknown format")
        .when(content.isNull(), "error: no content").when(F.trim(content) == "", "error: blank").otherwise("indexed")
    )


def rebuilt(docs: DataFrame, as_of: Column, include_sensitive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunk table, what became of each document) of a full rebuild (M3): indexed, skipped directory, blank, unknown format,
    no path, or no content. Every document has one outcome."""
    judged = docs.withColumn("outcome", _outcome(include_sensitive))
    return chunk_rows(parsed(judged.filter("outcome = 'indexed'").drop("outcome")), as_of), judged.select("path", "outcome")


def rebuilt_into(docs: DataFrame, path: str, as_of: Column, include_sensitive: bool = False) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """rebuilt() as one job over one scan (M3): chunks and documents that failed are two folders of the table at `path`, and
    the counts by outcome, of documents and of chunks come from the job itself.

    Gives (chunk table, (path, outcome) of documents not indexed, counts). The job has no shuffle, so a task that runs
    again is counted once. A document that is not indexed is one row without content."""
    of_documents, of_rows = Observation(), Observation()
    counted = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    judged = docs.select("path", "content").withColumn("outcome", _outcome(include_sensitive)).observe(of_documents, F.count(F.lit(1)).alias("documents"), *counted)
    good = F.col("outcome") == "indexed"
    rows = chunk_rows(_read(judged.withColumn("content", F.when(good, F.col("content")))), as_of, keep=("outcome",))
    rows = rows.observe(of_rows, F.count_if(good).alias("chunks")).withColumn("part", F.when(good, "chunks").otherwise("failed"))
    rows.write.partitionBy("part").parquet(path)
    stored = docs.sparkSession.read.schema(rows.schema).parquet(path)
    chunks = stored.filter("part = 'chunks'").drop("part", "outcome")
    return chunks, stored.filter("part = 'failed'").select(F.col("parent_file").alias("path"), "outcome"), {**of_documents.get, **of_rows.get}


def not_indexed(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without a chunk."""
    return docs.join(chunks.select(F.col("parent_file").alias("path")).distinct(), "path", "left_anti")


def sync(chunks: DataFrame, docs: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """The chunk table after changed files were chunked anew and vanished ones dropped."""
    paths = changes.select("path").distinct()
    kept = chunks.join(paths.select(F.col("path").alias("parent_file")), "parent_file", "left_anti")
    fresh = chunk_rows(parsed(docs.join(paths, "path", "left_semi")), as_of)
    return kept.unionByName(fresh, allowMissingColumns=True)


def sync_table(table, docs: DataFrame, changes: DataFrame, as_of: Column, batch: tuple[str, int] | None = None) -> int:
    """sync() on a chunk table that is a sources.keyed.KeyedTable by parent_file: the changed files' chunks, or none for
    those that vanished, are all that is written, in one version; a batch that comes again changes nothing."""
    paths = changes.select("path").distinct()
    fresh = chunk_rows(parsed(docs.join(paths, "path", "left_semi")), as_of)
    return table.replace(fresh, paths.select(F.col("path").alias("parent_file")), batch)


def secrets(content: Column, patterns: tuple = SECRETS) -> Column:
    """Names of the secret shapes that occur."""
    return F.array_compact(F.array(*[F.when(content.rlike(p), name) for name, p in patterns]))


def quarantined(df: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(clean rows, rows with detections)."""
    scanned = df.withColumn("detections", secrets(F.col(content)))
    return scanned.filter(F.size("detections") == 0).drop("detections"), scanned.filter(F.size("detections") > 0)


def hashed_vectors(chunks: DataFrame, content: str = "content", features: int = 1 << 12) -> DataFrame:
    """Embedding without a model (V1): hashed term frequencies by inverse document frequency, unit length."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    words = chunks.withColumn("__words", text.token_set(F.coalesce(F.col(content), F.lit(""))))
    counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features).transform(words)
    weighed = IDF(inputCol="__tf", outputCol="__idf").fit(counted).transform(counted)
    return Normalizer(inputCol="__idf", outputCol="vector").transform(weighed).drop("__words", "__tf", "__idf")


def edited(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Exact-string edits, appends and writes (M12): edits(path, op, old, new, every); (path, content, outcome)."""
    both = docs.join(edits, "path", "full_outer")
    found = F.when(F.length("old") > 0, (F.length("content") - F.length(F.replace("content", F.col("old"), F.lit("")))) / F.length("old")).otherwise(0).cast("int")
    outcome = (
        F.when(F.col("op").isNull(), "unchanged").when(F.col("op") == "write", "written").when(F.col("content").isNull(), "error: no such document")
        .when(F.col("op") == "append", "appended").when(F.col("old") == F.col("new"), "error: nothing to change").when(found == 0, "error: not found")
        .when((found > 1) & ~F.coalesce("every", F.lit(False)), "error: not unique").otherwise("edited")
    )
    after = both.withColumn("outcome", outcome)
    content = F.when(F.col("outcome") == "written", F.col("new")).when(F.col("outcome") == "appended", F.concat("content", F.lit("\n"), "new")).when(F.col("outcome") == "edited", F.replace("content", F.col("old"), F.col("new"))).otherwise(F.col("content"))
    return after.select("path", content.alias("content"), "outcome")


def unions(frames: list[DataFrame]) -> DataFrame:
    """Rows of several roots or tiers in one search space."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
