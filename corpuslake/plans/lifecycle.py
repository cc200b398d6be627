"""Queries of the lifecycle family: documents as ephemeral rows, customers and suppliers as memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import ids, text
from corpuslake.operators import ingest, lifecycle
from corpuslake.plans.base import AS_OF, CHUNKS_SQL, chunks, query, table
from corpuslake.sources import tables


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _ephemeral(spark, sf_dir):
    rows = chunks(spark, sf_dir).filter("type <> 'vault'").withColumnRenamed("updated_at", "created_at")
    return rows.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).withColumn("session_id", (F.col("doc_id") % 10).cast("string")).withColumn("promoted", F.col("doc_id") % 11 == 0).withColumn("name", F.concat(F.lit("Row "), F.col("doc_id"))).withColumn("project_path", F.concat(F.lit("/home/p"), F.col("doc_id") % 4))


EPHEMERAL_SQL = f"""{CHUNKS_SQL}, eph AS (SELECT doc_id, parent_file, directory, content, importance, importance_score, updated_at AS created_at, type, retrieval_count, 's' || (doc_id % 3) AS source,
  CAST(doc_id % 10 AS VARCHAR) AS session_id, doc_id % 11 = 0 AS promoted, floor((epoch_us(TIMESTAMP '2024-02-10 00:00:00') - epoch_us(updated_at)) / 86400000000.0) AS age FROM chunks WHERE type <> 'vault'),
judged AS (SELECT *, coalesce(importance_score, 0.5) >= 0.85 AS c1, coalesce(retrieval_count, 0) > 3 AS c2, age >= 30 AND coalesce(importance_score, 0.5) >= 0.7 AS c3 FROM eph)"""


@query("a10_promotion_scan", f"""WITH {EPHEMERAL_SQL} SELECT doc_id, c1 OR c2 OR c3 AS eligible, CASE WHEN NOT (c1 OR c2 OR c3) THEN 'no criterion met' ELSE array_to_string(list_filter([CASE WHEN c1 THEN printf('importance %.2f >= 0.85', coalesce(importance_score, 0.5)) END, CASE WHEN c2 THEN printf('retrievals %.2f > 3', retrieval_count) END,
  CASE WHEN c3 THEN printf('age %dd >= 30d + importance %.2f >= 0.7', CAST(age AS BIGINT), coalesce(importance_score, 0.5)) END], lambda x: x IS NOT NULL), '; ') END AS reason FROM judged""")
def promotion_scan(spark, sf_dir):
    return lifecycle.promotion(_ephemeral(spark, sf_dir), _as_of()).select("doc_id", "eligible", "reason")


OUTCOME_SQL = "CASE WHEN promoted THEN 'already promoted' WHEN NOT (c1 OR c2 OR c3) THEN 'not eligible' ELSE 'promoted' END"


@query("m9_promote", f"WITH {EPHEMERAL_SQL} SELECT doc_id, {OUTCOME_SQL} AS outcome FROM judged")
def promote(spark, sf_dir):
    return lifecycle.promoted(_ephemeral(spark, sf_dir), _as_of())[1].select("doc_id", "outcome")


@query("s10_promotion_files", rf"""WITH {EPHEMERAL_SQL} SELECT type || 's/p' || (doc_id % 4) || '/' || type || '-row-' || doc_id || '-20240210-000000-' || doc_id || '.md' AS path, type AS vault_type, 'p' || (doc_id % 4) AS project,
  '---' || chr(10) || 'promoted_from: ' || doc_id || chr(10) || 'type: ' || type || chr(10) || '---' || chr(10) || chr(10) || content AS document FROM judged WHERE {OUTCOME_SQL} = 'promoted'""")
def promotion_files(spark, sf_dir):
    """Written as one folder for each type and project, and read back."""
    path = tables.new_path(spark, "promotions")
    tables.write_promotions(lifecycle.promotion_files(lifecycle.promoted(_ephemeral(spark, sf_dir), _as_of())[0]), path)
    return spark.read.parquet(path)


@query("m9_durable_rows", rf"""WITH {EPHEMERAL_SQL} SELECT 'vault::' || type || 's/p' || (doc_id % 4) || '/' || type || '-row-' || doc_id || '-20240210-000000-' || doc_id || '.md' AS doc_id, 'vault' AS type, type AS vault_type, md5(content) AS digest, CAST(doc_id AS VARCHAR) AS promoted_from FROM judged WHERE {OUTCOME_SQL} = 'promoted'""")
def durable_rows(spark, sf_dir):
    """The rows that the promotion makes."""
    return lifecycle.promoted(_ephemeral(spark, sf_dir), _as_of())[0].select("doc_id", "type", "vault_type", F.md5(F.col("content").cast("binary")).alias("digest"), "promoted_from")


@query("x34_promotion_targets", rf"""WITH {EPHEMERAL_SQL} SELECT type || 's/p' || (doc_id % 4) || '/' || type || '-row-' || doc_id || '-20240210-000000-' || doc_id || '.md' AS path, 'p' || (doc_id % 4) AS project FROM judged WHERE {OUTCOME_SQL} = 'promoted'""")
def promotion_targets(spark, sf_dir):
    return lifecycle.promoted(_ephemeral(spark, sf_dir), _as_of())[0].select("path", "project")


@query("t1_ephemeral_list", f"WITH {EPHEMERAL_SQL}, k AS (SELECT * FROM eph WHERE type = 'observation' AND coalesce(importance_score, 0.5) >= 0.3) SELECT doc_id, (SELECT count(*) FROM k) AS total FROM k ORDER BY coalesce(importance_score, 0.5) DESC, doc_id LIMIT 20")
def ephemeral_list(spark, sf_dir):
    return lifecycle.ephemeral_list(_ephemeral(spark, sf_dir), kind="observation", least=0.3).select("doc_id", "total")


@query("f10_ephemeral_filter", f"WITH {EPHEMERAL_SQL}, k AS (SELECT * FROM eph WHERE source = 's1' AND session_id = '4') SELECT doc_id FROM k ORDER BY created_at, doc_id LIMIT 50")
def ephemeral_filter(spark, sf_dir):
    return lifecycle.ephemeral_list(_ephemeral(spark, sf_dir), source="s1", session="4", sort_by="created", ascending=True, limit=50).select("doc_id")


@query("t9_promotion_browse", f"WITH {EPHEMERAL_SQL} SELECT doc_id, importance_score, CAST(age AS BIGINT) AS age_days, retrieval_count, CASE WHEN c1 OR c2 OR c3 THEN '*' ELSE '' END AS star FROM judged ORDER BY coalesce(importance_score, 0.5) DESC, doc_id LIMIT 10")
def promotion_browse(spark, sf_dir):
    return lifecycle.browse(_ephemeral(spark, sf_dir), _as_of())


@query("s4_upsert", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id + 1000000000, 'added' FROM documents WHERE doc_id % 10 = 0")
def upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    some = docs.filter("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("lang"))
    return lifecycle.upsert(lifecycle.upsert(docs, some), some.select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit("added").alias("lang")))


@query("j3_lookup", "SELECT o_orderkey, c.c_name IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c_custkey = o_custkey")
def lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    people = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"))
    found, missing = lifecycle.lookup(people, orders, "key")
    return found.select("o_orderkey", F.lit(True).alias("found")).union(missing.select("o_orderkey", F.lit(False)))


@query("m8_delete", "SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 'not_found' WHEN doc_id % 2 = 0 THEN 'deleted' ELSE 'preview' END AS outcome FROM documents WHERE doc_id % 7 = 0")
def delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    asked = docs.filter("doc_id % 7 = 0").withColumn("confirm", F.col("doc_id") % 2 == 0)
    return lifecycle.deleted(docs.filter("doc_id % 14 <> 0"), asked)[1]


@query("m2_unindex", "SELECT doc_id FROM documents WHERE source <> 'src3'")
def unindex(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("doc_id", "parent_file")
    gone = rows.filter("parent_file = 'src3'").select("parent_file").distinct()
    return lifecycle.deleted(rows, gone, "parent_file")[0].select("doc_id")


@query("m4_retrieval_counts", f"WITH {CHUNKS_SQL}, s AS (SELECT l_partkey AS doc_id, count(*) * 0.25 AS add FROM lineitem GROUP BY l_partkey) SELECT c.doc_id, CAST(round(retrieval_count + coalesce(add, 0), 2) AS DOUBLE) AS retrieval_count FROM chunks c LEFT JOIN s ON s.doc_id = c.doc_id")
def retrieval_counts(spark, sf_dir):
    served = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.lit(0.25).alias("increment"))
    return lifecycle.with_retrievals(chunks(spark, sf_dir), served, _as_of()).select("doc_id", "retrieval_count")


@query("m6_read_and_count", f"WITH {CHUNKS_SQL} SELECT doc_id, retrieval_count + CASE WHEN doc_id % 9 = 0 THEN 1.0 ELSE 0.0 END AS retrieval_count FROM chunks")
def read_and_count(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    served = rows.filter("doc_id % 9 = 0").select("doc_id", F.lit(1.0).alias("increment"))
    return lifecycle.with_retrievals(rows, served, _as_of()).select("doc_id", "retrieval_count")


@query("m7_merge_update", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 'changed' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE source END AS source FROM documents")
def merge_update(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = docs.filter("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "").otherwise("changed").alias("lang"), F.lit("moved").alias("source"))
    return lifecycle.merged(docs, new)


@query("f12_row_validation", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown type' WHEN o_orderkey % 5 = 1 THEN 'name required' WHEN o_orderkey % 5 = 2 THEN 'score out of range' WHEN o_orderkey % 5 = 3 THEN 'relationship needs two names' ELSE '' END AS errors FROM orders")
def row_validation(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "tale").when(k == 1, "plan").when(k == 3, "relationship").otherwise("observation").alias("type"), F.when(k == 1, " ").otherwise("a b").alias("name"), F.when(k == 2, 1.5).otherwise(0.5).alias("score"))
    return rows.select("o_orderkey", F.array_join(lifecycle.row_errors(F.col("type"), F.col("name"), F.col("score")), ",").alias("errors"))


@query("f13_memory_validation", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'bad name' WHEN 1 THEN 'bad scope' WHEN 2 THEN 'project required' ELSE '' END AS errors FROM customer")
def memory_validation(spark, sf_dir):
    k = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "-Bad Name").otherwise("good-name").alias("name"), F.when(k == 1, "galaxy").when(k == 2, "project").otherwise("global").alias("scope"))
    return rows.select("c_custkey", F.array_join(lifecycle.memory_errors(F.col("name"), F.col("scope"), F.lit("high"), F.lit("")), ",").alias("errors"))


@query("w7_versions", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version, strftime(min(o_orderdate) OVER (PARTITION BY o_custkey), '%Y-%m-%d') AS created FROM orders")
def versions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return lifecycle.versioned(rows, ("o_custkey",), "at").select("o_orderkey", "version", F.date_format("created_at.o_orderdate", "yyyy-MM-dd").alias("created"))


def _memories(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "global").otherwise("project").alias("scope"), F.concat(F.lit("Proj "), F.col("s_suppkey") % 5).alias("project"), F.concat(F.lit("mem-"), F.col("s_suppkey")).alias("name"), F.when(F.col("s_acctbal") > 5000, "high").otherwise("low").alias("importance"), F.array(F.concat(F.lit("t"), F.col("s_suppkey") % 3)).alias("tags"), F.lit(1).alias("version"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("modified_at"), F.col("s_name").alias("body"))


@query("m10_memory_upsert", "SELECT 'mem-' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'written' ELSE 'exists' END AS outcome, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM supplier")
def memory_upsert(spark, sf_dir):
    stored = _memories(spark, sf_dir)
    new = stored.drop("version", "created_at").withColumn("overwrite", F.substring_index("name", "-", -1).cast("int") % 3 == 0).withColumn("modified_at", _as_of())
    snapshot, outcomes = lifecycle.memory_upsert(stored, new)
    return outcomes.select("name", "outcome").join(snapshot.select("name", "version"), "name")


@query("j4_stale_index", "SELECT 'mem-' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'memory::global::mem-' ELSE 'memory::proj-' || (s_suppkey % 5) || '::mem-' END || s_suppkey AS memory_id, s_suppkey % 4 <> 1 AS indexed FROM supplier")
def stale_index(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    index = memories.filter(F.substring_index("name", "-", -1).cast("int") % 4 != 1).select(ids.memory_id(F.col("scope"), F.col("project"), F.col("name")).alias("doc_id"))
    return lifecycle.unindexed(memories, index).select("name", "memory_id", "indexed")


@query("j5_read_with_fallback", "SELECT 'mem-' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'index' WHEN s_suppkey % 3 = 1 THEN 'stale' ELSE 'missing' END AS source FROM supplier")
def read_with_fallback(spark, sf_dir):
    memories = _memories(spark, sf_dir).withColumn("k", F.substring_index("name", "-", -1).cast("int") % 3)
    return lifecycle.read_with_fallback(memories.select("name"), memories.filter("k = 0"), memories.filter("k < 2")).select("name", "source")


@query("s14_memory_list", "SELECT 'mem-' || s_suppkey AS name FROM supplier WHERE (s_suppkey % 2 = 0 OR s_suppkey % 5 = 3) AND s_suppkey % 3 = 1 AND s_acctbal > 5000")
def memory_list(spark, sf_dir):
    return lifecycle.memory_list(_memories(spark, sf_dir), project="Proj 3", tag="t1", importance="high").select("name")


@query("m11_memory_delete", "SELECT 'mem-' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'preview' ELSE 'deleted' END AS outcome FROM supplier")
def memory_delete(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    asked = memories.select("name", (F.col("scope") != "global").alias("confirm"))
    return lifecycle.deleted(memories, asked, "name")[1]


@query("m15_routed_requests", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'read_by_id' WHEN 1 THEN 'read_by_name' END AS route, CASE p_partkey % 4 WHEN 2 THEN 'no routing key' WHEN 3 THEN 'several routing keys' END AS error FROM part")
def routed_requests(spark, sf_dir):
    k = F.col("p_partkey") % 4
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("read").alias("verb"), F.when(k.isin(0, 3), "x").alias("id"), F.when(k.isin(1, 3), F.col("p_name")).alias("name"))
    return lifecycle.routed(rows).select("p_partkey", "route", "error")


@query("a1_collection_stats", f"WITH {CHUNKS_SQL} SELECT 'total' AS facet, '' AS value, count(*) AS n FROM chunks UNION ALL SELECT 'type', type, count(*) FROM chunks GROUP BY type UNION ALL SELECT 'namespace', coalesce(vault_type, 'unknown'), count(*) FROM chunks GROUP BY 2")
def collection_stats(spark, sf_dir):
    return lifecycle.collection_stats(chunks(spark, sf_dir).withColumn("namespace", F.col("vault_type")))


@query("a2_sample_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 7")
def sample_rows(spark, sf_dir):
    return lifecycle.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), 7)


@query("a3_storage_size")
def storage_size(spark, sf_dir):
    return lifecycle.storage_size(spark, f"{sf_dir}/documents.parquet")


@query("a34_rows_by_tenant", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def rows_by_tenant(spark, sf_dir):
    return lifecycle.by_tenant(table(spark, sf_dir, "documents"), "source")


@query("x7_parse_ids", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'vault' WHEN 1 THEN 'memory' ELSE 'obs' END AS namespace, CASE p_partkey % 3 WHEN 0 THEN 'vault::' WHEN 1 THEN 'memory::global::' ELSE 'obs::' END AS full_prefix, CASE p_partkey % 3 WHEN 0 THEN 'notes/n' ELSE 'n' END || p_partkey AS content_id, CASE p_partkey % 3 WHEN 2 THEN 'ephemeral' ELSE 'durable' END AS tier, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey % 7 AS INTEGER) END AS chunk FROM part")
def parse_ids(spark, sf_dir):
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, F.concat(F.lit("notes/n"), "p_partkey", F.lit("#chunk-"), F.col("p_partkey") % 7)).when(k == 1, F.concat(F.lit("memory::global::n"), "p_partkey")).otherwise(F.concat(F.lit("obs::n"), "p_partkey")).alias("doc_id"))
    return rows.select("p_partkey", ids.parsed(F.col("doc_id")).alias("x")).select("p_partkey", "x.*")


@query("x8_build_ids", "SELECT p_partkey, 'vault::' || 'n/' || p_partkey || '#chunk-' || (p_partkey % 5) AS chunk_id, 'memory::big-one::part-' || p_partkey AS memory_id, CASE WHEN 'b-' || (p_partkey % 9) < 'b-5' THEN 'rel::b-' || (p_partkey % 9) || '::b-5' ELSE 'rel::b-5::b-' || (p_partkey % 9) END AS relationship_id FROM part")
def build_ids(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", ids.chunk_id(F.concat(F.lit("n/"), k), k % 5).alias("chunk_id"), ids.memory_id(F.lit("project"), F.lit(" Big_One!"), F.concat(F.lit("Part "), k)).alias("memory_id"), ids.relationship_id(F.concat(F.lit("B "), k % 9), F.lit("b 5")).alias("relationship_id"))


@query("x9_slug", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ' -- ' || p_type)), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" -- "), "p_type")).alias("slug"))


@query("x10_front_matter", "SELECT p_partkey, p_brand AS brand, p_type AS kind, 'a,b' || p_size AS tags, 'Title ' || p_partkey AS title, 'body of ' || p_name AS body FROM part")
def front_matter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("content", F.concat(F.lit("---\nbrand: old\nbrand: "), "p_brand", F.lit("\nkind: \""), "p_type", F.lit("\"\ntags:\n  - a\n  - b"), "p_size", F.lit("\n---\n# Title "), "p_partkey", F.lit("\nbody of "), "p_name"))
    parsed = ingest.parsed(rows.select("p_partkey", F.concat(F.lit("notes/"), "p_partkey", F.lit(".md")).alias("path"), "content"))
    return parsed.select("p_partkey", F.col("front")["brand"].alias("brand"), F.col("front")["kind"].alias("kind"), F.col("front")["tags"].alias("tags"), "title", F.element_at(F.split("body", "\n"), 2).alias("body"))


@query("x11_org_properties", "SELECT p_partkey, p_brand AS brand, 'Org ' || p_partkey AS title FROM part")
def org_properties(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("notes/"), "p_partkey", F.lit(".org")).alias("path"), F.concat(F.lit(":PROPERTIES:\n:BRAND: "), "p_brand", F.lit("\n:END:\n#+TITLE: Org "), "p_partkey", F.lit("\ntext")).alias("content"))
    return ingest.parsed(rows).select("p_partkey", F.col("front")["brand"].alias("brand"), "title")


@query("x18_truncate", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS head FROM documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 100).alias("head"))


@query("x26_levels", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.9 THEN 'critical' WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM lineitem")
def levels(spark, sf_dir):
    from corpuslake.functions.scoring import level

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", level(F.col("l_discount") * 10).alias("level"))


@query("f5_path_audit", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'escapes_root' WHEN 1 THEN 'absolute' WHEN 2 THEN 'forbidden_part' ELSE '' END AS problems FROM orders")
def path_audit(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    path = F.when(k == 0, F.concat(F.lit("a/../../"), "o_orderkey")).when(k == 1, F.concat(F.lit("/etc/"), "o_orderkey")).when(k == 2, F.lit("x/.git/config")).otherwise("a/./b/../c.md")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(ingest.path_problems(path), ",").alias("problems"))


@query("f11_secret_scan", r"""SELECT doc_id, regexp_matches(text, '(?i)\b(?:token|secret|api_key)\s*=\s*"[0-9a-f]{32,}"') AS rejected FROM documents""")
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(ingest.secrets(F.col("text"))) > 0).alias("rejected"))


DOCS_AS_FILES = "'n' || (doc_id % 50) || '/' || doc_id || '.md'"


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("# Doc "), "doc_id", F.lit("\n\nintro\n\n## First\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n## Second\n\n"), F.left("text", F.lit(400)))
    return docs.select("doc_id", F.concat(F.lit("n"), F.col("doc_id") % 50, F.lit("/"), "doc_id", F.lit(".md")).alias("path"), body.alias("content"))


@query("x15_chunking")
def chunking(spark, sf_dir):
    """Heading-aware chunks of all documents; held against a plain loop in tests/test_ingest.py."""
    return ingest.chunk_rows(ingest.parsed(_files(spark, sf_dir)), _as_of()).select("doc_id", "chunk_index", "chunk_total", "chunk_heading", F.length("content").alias("n_chars"))


@query("m3_rebuild", f"SELECT 'n' || (doc_id % 50) AS directory, count(*) AS n_files FROM documents WHERE doc_id % 50 <> 7 GROUP BY 1")
def rebuild(spark, sf_dir):
    docs = _files(spark, sf_dir).filter(~ingest.top_directory(F.col("path")).isin("n7"))
    rows = ingest.rebuilt(docs, _as_of())[0]
    return rows.groupBy("directory").agg(F.countDistinct("parent_file").alias("n_files"))


OUTCOME_OF_DOC_SQL = "CASE WHEN doc_id % 9 = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'error: unknown format' WHEN doc_id % 5 = 0 THEN 'error: blank' WHEN doc_id % 11 = 0 THEN 'error: no content' ELSE 'indexed' END"


def _mixed_files(spark, sf_dir):
    k = F.col("doc_id")
    path = F.concat(F.when(k % 9 == 0, "templates/").otherwise("notes/"), k, F.when(k % 7 == 0, ".pdf").otherwise(".md"))
    content = F.when(k % 5 == 0, "  ").when(k % 11 == 0, F.lit(None)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), content.alias("content"))


@query("m3_rebuild_report", f"SELECT {OUTCOME_OF_DOC_SQL} AS outcome, count(*) AS n FROM documents GROUP BY 1")
def rebuild_report(spark, sf_dir):
    return ingest.rebuilt(_mixed_files(spark, sf_dir), _as_of())[1].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("m3_rebuild_counts", f"SELECT {OUTCOME_OF_DOC_SQL} AS outcome, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'documents', count(*) FROM documents HAVING count(*) > 0")
def rebuild_counts(spark, sf_dir):
    """The counts that the rebuild's own job gathers while it writes chunks and failures."""
    counts = ingest.rebuilt_into(_mixed_files(spark, sf_dir), tables.new_path(spark, "rebuild"), _as_of())[2]
    return spark.createDataFrame([(name, n) for name, n in counts.items() if n and name != "chunks"], "outcome string, n long")


@query("m3_failed_rows", f"SELECT CASE WHEN doc_id % 9 = 0 THEN 'templates/' ELSE 'notes/' END || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.pdf' ELSE '.md' END AS path, {OUTCOME_OF_DOC_SQL} AS outcome FROM documents WHERE {OUTCOME_OF_DOC_SQL} <> 'indexed'")
def failed_rows(spark, sf_dir):
    """The side output of that job, read back."""
    return ingest.rebuilt_into(_mixed_files(spark, sf_dir), tables.new_path(spark, "rebuild"), _as_of())[1]


def _notes(spark, sf_dir):
    """Parts as short notes: Markdown with a block, Markdown without one, org."""
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 2 == 0, "work/").otherwise("other/"), k, F.when(k % 3 == 2, ".org").otherwise(".md"))
    block = F.concat(F.lit("---\ntype: incident-log\nimportance: high\ntags: [a, b]\ncreated: 2024-01-05\n---\n# About "), k, F.lit("\n"), "p_name")
    content = F.when(k % 3 == 0, block).when(k % 3 == 1, F.concat("p_name", F.lit(" of "), "p_brand")).otherwise(F.concat(F.lit("#+TITLE: Org "), k, F.lit("\n"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), content.alias("content"))


NOTES_SQL = """notes AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'work' ELSE 'other' END AS directory, CASE WHEN p_partkey % 2 = 0 THEN 'work/' ELSE 'other/' END || p_partkey || CASE WHEN p_partkey % 3 = 2 THEN '.org' ELSE '.md' END AS path,
  CASE WHEN p_partkey % 3 = 2 THEN 'org' ELSE 'markdown' END AS fmt, CASE p_partkey % 3 WHEN 0 THEN 'About ' || p_partkey WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE 'Org ' || p_partkey END AS title,
  CASE p_partkey % 3 WHEN 0 THEN '# About ' || p_partkey || chr(10) || p_name WHEN 1 THEN p_name || ' of ' || p_brand ELSE '#+TITLE: Org ' || p_partkey || chr(10) || p_name END AS body FROM part)"""


@query("s2_document_parse", f"WITH {NOTES_SQL} SELECT p_partkey, fmt, title, body, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END AS n_keys FROM notes")
def document_parse(spark, sf_dir):
    return ingest.parsed(_notes(spark, sf_dir)).select("p_partkey", "fmt", "title", "body", F.coalesce(F.size("front"), F.lit(0)).alias("n_keys"))


@query("x14_titles", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Head ' || p_name WHEN 1 THEN 'Set ' || p_name WHEN 2 THEN 'Star ' || p_name ELSE 'My Note ' || p_partkey END AS title FROM part")
def titles(spark, sf_dir):
    k = F.col("p_partkey") % 4
    org = k.isin(1, 2)
    content = F.when(k == 0, F.concat(F.lit("intro\n# Head "), "p_name", F.lit("\n# Other"))).when(k == 1, F.concat(F.lit("* first\n#+title: Set "), "p_name")).when(k == 2, F.concat(F.lit("text\n* Star "), "p_name")).otherwise("no heading")
    path = F.concat(F.lit("d/my_note-"), "p_partkey", F.when(org, ".org").otherwise(".md"))
    return table(spark, sf_dir, "part").select("p_partkey", text.title(content, path, F.when(org, "org").otherwise("markdown")).alias("title"))


@query("x17_formats", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'org' WHEN 2 THEN 'markdown' END AS fmt FROM part")
def formats(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, (".md", ".ORG", ".markdown", ".txt", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.file_format(F.concat(F.lit("a/b"), "p_partkey", end)).alias("fmt"))


CHUNK_SQL = f"""{NOTES_SQL}, described AS (SELECT 'vault::' || path AS doc_id, path AS parent_file, directory, title, trim(body) AS content, CASE WHEN p_partkey % 3 = 0 THEN 'incident-log' WHEN directory = 'work' THEN 'work' ELSE 'other' END AS vault_type,
  CASE WHEN p_partkey % 3 = 0 THEN 'a,b' ELSE '' END AS tags, CASE WHEN p_partkey % 3 = 0 THEN 'high' ELSE 'medium' END AS importance,
  CASE WHEN p_partkey % 3 = 0 THEN 0.8 + round(0.1 * exp(-0.693 * 36 / 7.0), 4) WHEN directory = 'work' THEN 0.6 ELSE 0.5 END AS score FROM notes)"""


@query("x16_chunk_metadata", f"WITH {CHUNK_SQL} SELECT doc_id, directory, vault_type, title, tags, importance, CAST(round(score, 4) AS DOUBLE) AS importance_score FROM described")
def chunk_metadata(spark, sf_dir):
    rows = ingest.chunk_rows(ingest.parsed(_notes(spark, sf_dir)), _as_of())
    return rows.select("doc_id", "directory", "vault_type", "title", F.array_join("tags", ",").alias("tags"), "importance", "importance_score")


@query("m1_reindex", f"WITH {CHUNK_SQL} SELECT doc_id, parent_file, md5(content) AS digest FROM described WHERE directory = 'work' UNION ALL SELECT doc_id || '#chunk-0', parent_file, 'old' FROM described WHERE directory <> 'work'")
def reindex(spark, sf_dir):
    """Every file has an old chunk row; the changed files' rows give way to their chunks."""
    files = _notes(spark, sf_dir)
    old = files.select(F.concat(F.lit("vault::"), "path", F.lit("#chunk-0")).alias("doc_id"), F.col("path").alias("parent_file"), F.lit("old").alias("content"))
    after = ingest.sync(old, files.select("path", "content"), files.filter("p_partkey % 2 = 0").select("path"), _as_of())
    return after.select("doc_id", "parent_file", F.when(F.col("content") == "old", "old").otherwise(F.md5(F.col("content").cast("binary"))).alias("digest"))


@query("x35_memory_rows", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'memory::global::mem-' ELSE 'memory::proj-' || (s_suppkey % 5) || '::mem-' END || s_suppkey AS doc_id, 'a|t' || (s_suppkey % 3) AS tags, CASE WHEN s_suppkey % 4 = 1 THEN 1 ELSE s_suppkey END AS version, CASE WHEN s_suppkey % 3 = 0 THEN 'medium' ELSE 'low' END AS importance, s_name AS content FROM supplier")
def memory_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    writes = table(spark, sf_dir, "supplier").select(
        F.when(k % 2 == 0, "global").otherwise("project").alias("scope"), F.concat(F.lit("Proj "), k % 5).alias("project"), F.concat(F.lit("mem-"), k).alias("name"), F.concat(F.lit("a, t"), k % 3, F.lit(",")).alias("tags"),
        F.when(k % 3 == 0, "").otherwise("low").alias("importance"), F.when(k % 4 == 1, "first").otherwise(k.cast("string")).alias("version"), F.col("s_name").alias("body"),
    )
    return lifecycle.memory_rows(writes, _as_of()).select("doc_id", F.array_join("tags", "|").alias("tags"), F.col("version").cast("long").alias("version"), "importance", "content")


@query("j2_incremental_scan", f"SELECT {DOCS_AS_FILES} AS path FROM documents WHERE doc_id % 4 = 0")
def incremental_scan(spark, sf_dir):
    files = _files(spark, sf_dir)
    known = files.filter("doc_id % 4 <> 0").select(F.col("path").alias("parent_file"))
    return ingest.not_indexed(files, known).select("path")


@query("j13_index_sync", f"SELECT {DOCS_AS_FILES} AS parent_file, CASE WHEN doc_id % 10 = 1 THEN 'fresh' ELSE 'kept' END AS state FROM documents WHERE doc_id % 10 <> 2")
def index_sync(spark, sf_dir):
    files = _files(spark, sf_dir)
    old = files.select(F.col("path").alias("parent_file"), F.lit("kept").alias("state"))
    changes = files.filter("doc_id % 10 in (1, 2)").select("path")
    return ingest.sync(old, files.filter("doc_id % 10 <> 2"), changes, _as_of()).select("parent_file", F.coalesce("state", F.lit("fresh")).alias("state")).distinct()


@query("m12_document_edits", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'written' WHEN 1 THEN 'appended' WHEN 2 THEN 'error: not found' ELSE 'unchanged' END AS outcome FROM documents")
def document_edits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    k = F.col("path") % 4
    edits = docs.filter(k != 3).select("path", F.when(k == 0, "write").when(k == 1, "append").otherwise("edit").alias("op"), F.when(k == 2, "\u0002").otherwise("").alias("old"), F.lit("x").alias("new"), F.lit(False).alias("every"))
    return ingest.edited(docs, edits).select(F.col("path").alias("doc_id"), "outcome")


@query("m12_edited_texts", """WITH d AS (SELECT doc_id, text, split_part(text, ' ', 2) AS old FROM documents), n AS (SELECT *, CASE WHEN length(old) > 0 THEN (length(text) - length(replace(text, old, ''))) // length(old) ELSE 0 END AS n FROM d),
o AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'unchanged' WHEN old = 'edited!' THEN 'error: nothing to change' WHEN n = 0 THEN 'error: not found' WHEN n > 1 AND doc_id % 4 <> 1 THEN 'error: not unique' ELSE 'edited' END AS outcome FROM n)
SELECT doc_id, outcome, md5(CASE WHEN outcome = 'edited' THEN replace(text, old, 'edited!') ELSE text END) AS digest FROM o""")
def edited_texts(spark, sf_dir):
    """Each text's second word is replaced, everywhere in every fourth document, else only where it stands once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    edits = docs.filter("path % 4 <> 0").select("path", F.lit("edit").alias("op"), F.split_part("content", F.lit(" "), F.lit(2)).alias("old"), F.lit("edited!").alias("new"), (F.col("path") % 4 == 1).alias("every"))
    return ingest.edited(docs, edits).select(F.col("path").alias("doc_id"), "outcome", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("u1_union_of_tiers", f"WITH {CHUNKS_SQL} SELECT type, count(*) AS n FROM chunks GROUP BY type")
def union_of_tiers(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    both = ingest.unions([rows.filter("type = 'vault'"), rows.filter("type <> 'vault'").drop("vault_type")])
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
