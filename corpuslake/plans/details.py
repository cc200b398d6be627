"""Queries of single expressions and small operators that the larger ones are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import ids, scoring, text
from corpuslake.operators import ingest, lifecycle, search, tasks
from corpuslake.plans.base import AS_OF, CHUNKS_SQL, DAYS_SQL, chunks, query, table
from corpuslake.plans.lifecycle import _files, _memories
from corpuslake.sources import tables


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("f4_skip_predicate", "SELECT doc_id FROM documents WHERE lang NOT IN ('fr', 'de')")
def skip_predicate(spark, sf_dir):
    lang = F.when(F.col("lang") == "fr", "templates").when(F.col("lang") == "de", "people").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").filter(ingest.indexable(F.concat(lang, F.lit("/x.md")))).select("doc_id")


@query("f25_memory_filter", "SELECT 'mem-' || s_suppkey AS name FROM supplier WHERE s_suppkey % 2 = 0 AND s_acctbal <= 5000")
def memory_filter(spark, sf_dir):
    return lifecycle.memory_list(_memories(spark, sf_dir), scope="global", importance="low").select("name")


@query("u4_union_of_scopes", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'global' ELSE 'project' END AS scope, count(*) AS n FROM supplier GROUP BY 1")
def union_of_scopes(spark, sf_dir):
    rows = _memories(spark, sf_dir)
    roots = [rows.filter("scope = 'global'").drop("scope").withColumn("scope", F.lit("global")), rows.filter("scope = 'project'").drop("scope").withColumn("scope", F.lit("project"))]
    return ingest.unions(roots).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("u5_ordered_distinct", "SELECT p_partkey, p_brand || ',' || p_type AS parts FROM part")
def ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.array("p_brand", "p_type", "p_brand", "p_type")), ",").alias("parts"))


@query("x1_relevance", f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(round(greatest(0, least(1, 1 - (doc_id % 21) / 10.0 / 2 + CASE importance WHEN 'high' THEN 0.1 WHEN 'low' THEN -0.05 ELSE 0 END + CASE WHEN {DAYS_SQL} <= 1 THEN 0.08 WHEN {DAYS_SQL} <= 7 THEN 0.05 ELSE 0 END)), 4) AS DOUBLE) AS relevance FROM chunks")
def relevance(spark, sf_dir):
    score = scoring.relevance(F.col("doc_id") % 21 / 10, F.col("importance"), F.col("updated_at"), F.lit(None).cast("double"), _as_of())
    return chunks(spark, sf_dir).select("doc_id", F.round(score, 4).alias("relevance"))


@query("x3_type_weights", "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 0.65 WHEN 'view' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS weight FROM events")
def type_weights(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "journal").when(F.col("event_type") == "view", "decision").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", scoring.type_weight(kind).alias("weight"))


@query("x4_recency", f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(round(0.1 * exp(-0.693 * greatest({DAYS_SQL}, 0) / 7.0), 4) AS DOUBLE) AS bonus FROM chunks")
def recency(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", scoring.recency_bonus(F.col("updated_at"), _as_of()).alias("bonus"))


@query("x5_retrieval_bonus", f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(CASE WHEN retrieval_count > 0 THEN least(0.1, round(log2(retrieval_count + 1) / 10, 4)) ELSE 0 END AS DOUBLE) AS bonus FROM chunks")
def retrieval_bonus(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", scoring.retrieval_bonus(F.col("retrieval_count")).alias("bonus"))


@query("x6_stated_importance", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN NULL ELSE 0.25 END AS DOUBLE) AS score FROM part")
def stated_importance(spark, sf_dir):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "7").when(k == 1, " High ").when(k == 2, "huge").otherwise("0.25")
    return table(spark, sf_dir, "part").select("p_partkey", scoring.named_importance(said).alias("score"))


@query("x12_strip_blocks", "SELECT p_partkey, p_name AS body FROM part")
def strip_blocks(spark, sf_dir):
    org = F.col("p_partkey") % 2 == 0
    content = F.when(org, F.concat(F.lit(":PROPERTIES:\n:A: 1\n:END:\n"), "p_name")).otherwise(F.concat(F.lit("---\na: 1\n---\n"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_front_matter(content, F.when(org, "org").otherwise("markdown")).alias("body"))


@query("x13_generate_blocks", "SELECT p_partkey, '---' || chr(10) || 'brand: ' || p_brand || chr(10) || 'kind: ' || p_type || chr(10) || '---' || chr(10) AS block FROM part")
def generate_blocks(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.front_matter_block(F.create_map(F.lit("kind"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))).alias("block"))


@query("x24_prompt_text", "SELECT conv_id, turn, trim(text) AS prompt FROM conversations")
def prompt_text(spark, sf_dir):
    named = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("prompt")))).otherwise(F.to_json(F.struct(F.lit(" ").alias("prompt"), F.col("text").alias("user_prompt"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search.prompt_text(named).alias("prompt"))


@query("x25_xml_escape", "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.xml_escaped(F.col("text")).alias("escaped"))


@query("x37_memory_paths", "SELECT 'mem-' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'memories/mem-' ELSE 'projects/proj-' || (s_suppkey % 5) || '/mem-' END || s_suppkey || '.md' AS path FROM supplier")
def memory_paths(spark, sf_dir):
    return _memories(spark, sf_dir).select("name", ids.memory_path(F.col("scope"), F.col("project"), F.col("name")).alias("path"))


@query("m5_ephemeral_insert", r"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'invalid' WHEN regexp_matches(text, '(?i)\b(?:token|secret|api_key)\s*=\s*"[0-9a-f]{32,}"') THEN 'rejected' ELSE 'stored' END AS outcome FROM documents""")
def ephemeral_insert(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "saga").otherwise("observation").alias("type"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"), F.lit(0.0).alias("importance_score"))
    none = spark.range(0).select(F.lit("").alias("doc_id"), F.lit("").alias("type"))
    return lifecycle.inserted(none, rows, _as_of())[1].select("doc_id", "outcome")


@query("m13_document_delete", "SELECT 'n' || (doc_id % 50) || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 6 <> 0")
def document_delete(spark, sf_dir):
    files = _files(spark, sf_dir).select("doc_id", "path")
    asked = files.filter("doc_id % 3 = 0").select("path", (F.col("doc_id") % 2 == 0).alias("confirm"))
    return lifecycle.deleted(files, asked, "path")[0].select("path")


@query("m20_inbox_routing", "SELECT doc_id, CASE lang WHEN 'en' THEN 'notes' WHEN 'fr' THEN 'work' WHEN 'de' THEN 'journal' ELSE 'inbox' END AS folder FROM documents")
def inbox_routing(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "note").when(F.col("lang") == "fr", "work").when(F.col("lang") == "de", "journal").otherwise("riddle")
    return table(spark, sf_dir, "documents").select("doc_id", tasks.destination(kind).alias("folder"))


@query("n5_chunk_table")
def chunk_table(spark, sf_dir):
    """Chunks under a SQL name; equal to x15_chunking's count (tests/test_ingest.py checks the chunks)."""
    from corpuslake.functions import sql_names

    sql_names.chunk_view(ingest.parsed(_files(spark, sf_dir)))
    return spark.sql("SELECT doc_id, chunk_index, chunk.heading, length(chunk.body) AS n_chars FROM chunk_rows")


@query("v1_hashed_vectors")
def hashed_vectors(spark, sf_dir):
    """Of each vector: features, their sum, and the feature of greatest weight; tests/test_ingest.py recomputes them."""
    from pyspark.ml.functions import vector_to_array

    rows = ingest.hashed_vectors(chunks(spark, sf_dir).select("doc_id", "content")).select("doc_id", vector_to_array("vector").alias("v"))
    return rows.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).alias("n_features"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), (F.array_position("v", F.array_max("v")) - 1).alias("top_feature"))


@query("n2_embedded", r"SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces FROM documents")
def embedded(spark, sf_dir):
    """A model plug-in whose vectors are two counts."""
    rows = tables.embedded(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), lambda texts: [(len(t), t.count(" ")) for t in texts])
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("n_chars"), F.col("embedding")[1].cast("double").alias("n_spaces"))
