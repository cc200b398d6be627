"""Queries on keyed tables: changes are written as deltas and merged when the table is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import ingest
from corpuslake.plans.base import AS_OF, query, table
from corpuslake.plans.lifecycle import CHUNK_SQL, _notes
from corpuslake.sources.keyed import KeyedTable
from corpuslake.sources.tables import new_path
from corpuslake.streaming import jobs


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _changed(spark, sf_dir) -> KeyedTable:
    """All documents; then every hundredth is written anew and once more under a new id, one in a hundred is deleted, a
    batch is repeated, and what the deltas touch is compacted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    made = KeyedTable.create(docs, new_path(spark, "keyed-documents"), "doc_id", buckets=16)
    some = docs.filter("doc_id % 100 = 0")
    made.upsert(some.withColumn("lang", F.lit("new")).union(some.select(F.col("doc_id") + 1000000000, F.lit("added"), "text")), ("edits", 0))
    made.delete(docs.filter("doc_id % 100 = 7"))
    made.upsert(some.withColumn("lang", F.lit("never")), ("edits", 0))
    made.compact(share=0.001)
    made.upsert(docs.filter("doc_id % 100 = 9").withColumn("text", F.lit(None).cast("string")), ("edits", 1))
    return made


CHANGED_SQL = """SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN 'new' ELSE lang END AS lang, CASE WHEN doc_id % 100 <> 9 THEN md5(text) END AS digest FROM documents WHERE doc_id % 100 <> 7
UNION ALL SELECT doc_id + 1000000000, 'added', md5(text) FROM documents WHERE doc_id % 100 = 0"""


@query("s4_keyed_upsert", CHANGED_SQL)
def keyed_upsert(spark, sf_dir):
    return _changed(spark, sf_dir).read().select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("s4_keyed_versions", """WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 100 = 0) AS a, count(*) FILTER (doc_id % 100 = 7) AS d, count(*) FILTER (doc_id % 100 = 9 AND text IS NOT NULL) AS b, count(text) AS t, count(text) FILTER (doc_id % 100 = 0) AS ta, count(text) FILTER (doc_id % 100 = 7) AS td FROM documents)
SELECT 0 AS version, n AS n_rows, t AS n_texts FROM c UNION ALL SELECT 1, n + a, t + ta FROM c UNION ALL SELECT 2, n + a - d, t + ta - td FROM c UNION ALL SELECT 3, n + a - d, t + ta - td FROM c UNION ALL SELECT 4, n + a - d, t + ta - td - b FROM c""")
def keyed_versions(spark, sf_dir):
    """Every snapshot as its readers see it: the repeated batch made none, compaction changed no row."""
    made = _changed(spark, sf_dir)
    counts = [made.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_texts")) for v in made.versions()]
    return ingest.unions(counts)


@query("s5_keyed_lookup", "SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 20 = 0")
def keyed_lookup(spark, sf_dir):
    return _changed(spark, sf_dir).lookup(table(spark, sf_dir, "documents").filter("doc_id % 20 = 0")).select("doc_id", "lang")


@query("m2_keyed_unindex", "SELECT doc_id, source AS parent_file FROM documents WHERE source <> 'src3' OR source IS NULL")
def keyed_unindex(spark, sf_dir):
    """All rows of a file go by its key, however many these are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("parent_file"))
    made = KeyedTable.create(docs, new_path(spark, "keyed-chunks"), "parent_file", buckets=8)
    made.delete(spark.createDataFrame([("src3",), ("nowhere",)], "parent_file string"))
    return made.read()


SYNCED_SQL = f"WITH {CHUNK_SQL} SELECT doc_id, parent_file, md5(content) AS digest FROM described WHERE directory = 'work' AND CAST(regexp_extract(parent_file, '[0-9]+') AS BIGINT) % 10 <> 4 UNION ALL SELECT doc_id || '#chunk-0', parent_file, 'old' FROM described WHERE directory <> 'work'"


def _old_chunks(spark, sf_dir) -> KeyedTable:
    """A chunk of old content for each file."""
    files, rows = _notes(spark, sf_dir), ingest.chunk_rows(ingest.parsed(_notes(spark, sf_dir)), _as_of())
    old = files.select(F.concat(F.lit("vault::"), "path", F.lit("#chunk-0")).alias("doc_id"), F.col("path").alias("parent_file"), F.lit("old").alias("content"))
    return KeyedTable.create(rows.limit(0).unionByName(old, allowMissingColumns=True), new_path(spark, "keyed-index"), "parent_file", buckets=16)


def _digests(made: KeyedTable):
    return made.read().select("doc_id", "parent_file", F.when(F.col("content") == "old", "old").otherwise(F.md5(F.col("content").cast("binary"))).alias("digest"))


@query("j13_keyed_sync", SYNCED_SQL)
def keyed_sync(spark, sf_dir):
    """Half of the files changed, a tenth vanished: their chunks are replaced in one version, others are not written."""
    made, files = _old_chunks(spark, sf_dir), _notes(spark, sf_dir)
    ingest.sync_table(made, files.filter("p_partkey % 10 <> 4").select("path", "content"), files.filter("p_partkey % 2 = 0").select("path"), _as_of())
    return _digests(made)


@query("r6_keyed_sync_stream", SYNCED_SQL)
def keyed_sync_stream(spark, sf_dir):
    """The changes come in three batches, one of them twice."""
    made, files, source = _old_chunks(spark, sf_dir), _notes(spark, sf_dir), new_path(spark, "keyed-changes")
    changed = files.filter("p_partkey % 2 = 0").select("p_partkey", "path")
    for rest in range(3):
        changed.filter(F.col("p_partkey") % 3 == rest).select("path").coalesce(1).write.mode("append").parquet(source)
    handle = jobs.keyed_sync_handler(made, lambda: files.filter("p_partkey % 10 <> 4").select("path", "content"), _as_of())
    jobs.each_batch(spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).parquet(source), handle, new_path(spark, "keyed-offsets"))
    handle(files.select("path"), 1)
    return _digests(made)
