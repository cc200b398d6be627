"""Benchmark decontamination: a hash set of the benchmark's normalised word windows is broadcast, every
document window probes it, and each hit is verified on the words before it counts.

Words: A-Z lower-cased, then maximal runs outside `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. A window is 13 consecutive
words of an item; a shorter item (with a word) is one window. Defined results. Null or empty text: no words, no
hit. Items without words never match; repeated items count once by item_id. Repeated documents each get the
result of their own text: rows are told apart by id and text hash. Input columns other than id and text are
never read. Main path: SQL functions only.

Scale: one pass over the documents, whose windows stay inside the stage that makes them (explode, probe,
filter). Only the windows' hashes are broadcast, in blocks of at most some `BLOCK_WINDOWS` (8 bytes each, however long their
words and however many items have them): a larger benchmark takes one such pass a block, dealt by hash, and the
blocks' hits are put together. The few rows that met a hash then join the written table of windows on hash and words; Spark chooses how,
by its size. One base row for each document and those rows are all that is shuffled; long documents cost what their words cost.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.shared import small, written

WINDOW = 13
BLOCK_WINDOWS = 250_000
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def _window(words: Column, start: Column, length: Column | int) -> Column:
    return F.slice(words, start, length)


def _hash(words: Column, start: Column, length: Column | int) -> Column:
    return F.xxhash64(F.lit(length) if isinstance(length, int) else length, _window(words, start, length))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(hash, length, gram, items): one row for each distinct window, with the items that hold it."""
    items = benchmark.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window)))
    at = items.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    grams = at.select("item", "length", _hash(F.col("words"), F.col("start"), F.col("length")).alias("hash"), F.array_join(_window(F.col("words"), F.col("start"), F.col("length")), " ").alias("gram"))
    return grams.groupBy("hash", "length", "gram").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each document: id, text_hash, n_words, n_hit, items (strings, sorted), spans (start word,
    length), contaminated (a twentieth of the words or more are hit)."""
    sized = benchmark.select(F.size(words_of(F.col(item_text))).alias("w")).filter("w > 0")
    facts = sized.agg(F.sum(F.greatest(F.col("w") - window + 1, F.lit(1))).alias("windows"), F.array_sort(F.collect_set(F.least("w", F.lit(window)))).alias("lengths")).first()
    known = written(benchmark_windows(benchmark, item_id, item_text, window), "benchmark-windows")
    blocks = max(1, -(-(facts["windows"] or 0) // block_windows))

    read = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words_of(F.col(text)).alias("words"))
    n = F.size("words")
    # size 0 marks the base row, which every document keeps
    sizes = F.array(*map(F.lit, [0, *facts["lengths"]]))
    rows = read.select("id", "text_hash", "words", F.explode(F.filter(sizes, lambda size: size <= n)).alias("size"))
    last = F.when(F.col("size") > 0, n - F.col("size")).otherwise(0)
    rows = rows.select("id", "text_hash", "words", "size", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    probe = F.when(F.col("size") > 0, _hash(F.col("words"), F.col("start") + 1, F.col("size")))
    rows = rows.withColumn("probe", probe)
    passes = []
    for block in range(blocks):
        # two numbers a window, whatever its words and however many items have it
        part = F.broadcast(known.filter(F.pmod("hash", F.lit(blocks)) == block).select("hash").distinct())
        met = rows.join(part, F.col("probe") == F.col("hash"), "left" if block == 0 else "inner")
        met = met.filter((F.col("size") == 0) | F.col("hash").isNotNull()) if block == 0 else met
        gram = F.when(F.col("size") > 0, F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " "))
        # base rows never meet a window, so any number spreads them
        met = met.select("id", "text_hash", "size", "start", gram.alias("said"), F.coalesce("probe", F.xxhash64("id", "text_hash")).alias("probe"), F.when(F.col("size") == 0, F.size("words")).alias("n_words"))
        passes.append(met if blocks == 1 else written(met, "benchmark-hits"))
    # now the few rows that met a hash are held against the words
    met, windows = reduce(DataFrame.union, passes), known.select("hash", "length", "gram", "items")
    same = (F.col("probe") == F.col("hash")) & (F.col("said") == F.col("gram")) & (F.col("size") == F.col("length"))
    hits = met.join(windows, same, "left").filter((F.col("size") == 0) | F.col("items").isNotNull()).select("id", "text_hash", "size", "start", "items", "n_words")

    hit = F.when(F.col("size") > 0, F.struct("start", "size"))
    docs_hit = hits.groupBy("id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("size") == 0).alias("copies"),
        F.array_sort(F.collect_set(hit)).alias("spans"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda x: x.cast("string")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("total")),
        lambda a, s: F.struct(F.greatest(a["to"], s["start"] + s["size"]).alias("to"), (a["total"] + F.greatest(s["start"] + s["size"] - F.greatest(a["to"], s["start"]), F.lit(0))).alias("total")),
        lambda a: a["total"].cast("long"),
    )
    found = docs_hit.select("id", "text_hash", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), "items", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    bad = small(contamination(docs, benchmark, doc_id, text).filter("contaminated").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "benchmark-leaks")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col("__hash"))
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the hit words taken out of the text; what stands between the words stays."""
    spans = contamination(docs, benchmark, doc_id, text).filter("n_hit > 0").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).distinct()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__hash"))
    # hit words by hashing and one sort, so that a long text costs what its words cost
    hit = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    both = docs.join(spans, same, "left").withColumn("__said", F.when(F.col("__spans").isNotNull(), F.transform(F.regexp_extract_all(body, F.lit(f"({RAW_WORD})"), 1), lambda w, i: F.struct(i.alias("at"), w.alias("word")))))
    both = both.withColumn("__hit", hit).withColumn("__left", F.array_except(F.transform("__said", lambda w: w["at"]), F.col("__hit")))
    left = F.transform("__left", lambda i: F.get("__said", i))
    gone = F.transform("__hit", lambda i: F.struct(i.alias("at"), F.lit("").alias("word")))
    kept = F.transform(F.array_sort(F.concat(left, gone)), lambda w: w["word"])
    joined = F.array_join(F.zip_with(F.split(body, RAW_WORD), kept, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")
    cut = both.withColumn(text, F.when(F.col("__spans").isNotNull(), joined).otherwise(F.col(f"`{text}`")))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(13, len(w)) AS size FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), h AS (
  SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
