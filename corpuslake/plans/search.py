"""Queries of the search family over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import scoring
from corpuslake.operators import search
from corpuslake.options import CONCEPTS, INTENTS, SYNONYMS, Search
from corpuslake.plans.base import AS_OF, CHUNKS_SQL, DAYS_SQL, chunks, query, table


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


NEAR_SQL = """near AS (
  SELECT q.vec_id AS query_id, r.vec_id AS doc_id, greatest(0, least(2, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))) AS distance
  FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0
), top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rn FROM near) WHERE rn <= 15
)"""
BOOST_SQL = f"""CASE WHEN {DAYS_SQL} <= 1 THEN 0.08 WHEN {DAYS_SQL} <= 7 THEN 0.05 ELSE 0.0 END"""
RELEVANCE_SQL = f"""round(greatest(0.0, least(1.0, 1.0 - distance / 2.0 + CASE WHEN importance_score IS NOT NULL THEN (importance_score - 0.5) * 0.24 ELSE CASE importance WHEN 'critical' THEN 0.12 WHEN 'high' THEN 0.10 WHEN 'low' THEN -0.05 ELSE 0.0 END END + {BOOST_SQL})), 6)"""


def ranked_sql(fetched: int = 15, n: int = 5) -> str:
    """CTEs up to `ranked`: the n best files of each query among its nearest chunks."""
    return f"""{CHUNKS_SQL}, {NEAR_SQL.replace("rn <= 15", f"rn <= {fetched}")}, scored AS (
  SELECT query_id, c.*, distance, {RELEVANCE_SQL} AS relevance FROM top JOIN chunks c ON c.doc_id = top.doc_id
), one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_file ORDER BY relevance DESC, round(distance, 6), doc_id) AS best FROM scored) WHERE best = 1
), ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, parent_file) AS rank FROM one) WHERE rank <= {n}
)"""


RANKED_SQL = ranked_sql()
PREVIEW_SQL = r"""CASE WHEN length(f) <= 150 THEN f ELSE (CASE WHEN strpos(reverse(left(f, 150)), ' ') > 0 AND 150 - strpos(reverse(left(f, 150)), ' ') > 75 THEN left(f, 150 - strpos(reverse(left(f, 150)), ' ')) ELSE left(f, 150) END) || '...' END"""


def budget_sql(source: str) -> str:
    """CTEs up to `picked`: the two-bin fold over the rows of a CTE, one step of a recursion a row."""
    return f"""ordered AS (
  SELECT query_id, doc_id, type = 'vault' AS v, CASE WHEN type = 'vault' THEN 120 ELSE greatest(length(content), 50) END AS cost, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM {source}
), fold(query_id, i, vl, ol, doc_id, v, took) AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST(4000 AS BIGINT), CAST(4000 AS BIGINT), CAST(NULL AS BIGINT), FALSE, FALSE FROM ordered
  UNION ALL
  SELECT o.query_id, o.i, vl - CASE WHEN vl >= cost AND (o.v OR ol < cost) THEN cost ELSE 0 END, ol - CASE WHEN ol >= cost AND (NOT o.v OR vl < cost) THEN cost ELSE 0 END,
    o.doc_id, o.v, vl >= cost OR ol >= cost FROM fold JOIN ordered o ON o.query_id = fold.query_id AND o.i = fold.i + 1
), picked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) AS INTEGER) AS place, doc_id, CASE WHEN v THEN 'reference' ELSE 'full' END AS mode FROM fold WHERE took
)"""


def _ranked(spark, sf_dir, n: int = 5):
    options = Search(n_results=n)
    found = search.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), min(3 * n, options.most_fetched))
    return search.reranked(found, chunks(spark, sf_dir), _as_of(), options)


@query("j1_nearest_chunks", f"WITH {RANKED_SQL} SELECT query_id, doc_id, parent_file, relevance, CAST(rank AS INTEGER) AS rank FROM ranked")
def nearest_chunks(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "doc_id", "parent_file", "relevance", "rank")


@query("v3_exact_top_k", f"WITH {NEAR_SQL} SELECT query_id, doc_id, round(distance, 6) AS distance FROM top")
def exact_top_k(spark, sf_dir):
    return search.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), 15).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


@query("t6_adhoc_search", f"WITH {NEAR_SQL} SELECT query_id, doc_id, round(1 - distance, 6) AS relevance, CAST(rn AS INTEGER) AS rank FROM top WHERE rn <= 10")
def adhoc_search(spark, sf_dir):
    from pyspark.sql import Window

    found = search.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), 10)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id")
    return found.select("query_id", "doc_id", F.round(1 - F.col("distance"), 6).alias("relevance"), F.row_number().over(w).alias("rank"))


@query("v4_index_search")
def index_search(spark, sf_dir):
    """Recall against v3_exact_top_k is measured in tests/test_search.py."""
    index = search.Index(_vectors(spark, sf_dir))
    return index.search(_asked(spark, sf_dir), 15).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


@query("j6_near_duplicate_vectors", f"""WITH near AS (
  SELECT q.vec_id AS query_id, r.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS s
  FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND r.vec_id % 20 <> 0
), best AS (SELECT query_id, max(round(s, 6)) AS s FROM near GROUP BY query_id)
SELECT query_id, s AS similarity, s >= 0.95 AS duplicate FROM best""")  # fmt: skip
def near_duplicate_vectors(spark, sf_dir):
    """New observations (every 20th vector) against the stored ones: dropped at 0.95."""
    stored = _vectors(spark, sf_dir).filter("doc_id % 20 <> 0")
    best = search.nearest(_asked(spark, sf_dir), stored, 1).select("query_id", F.round(1 - F.col("distance"), 6).alias("similarity"))
    return best.withColumn("duplicate", F.col("similarity") >= 0.95)


@query("a33_dedup_audit", f"""WITH near AS (
  SELECT q.vec_id AS query_id, max(round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6)) AS s
  FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND r.vec_id % 20 <> 0 GROUP BY q.vec_id
) SELECT CASE WHEN s >= 0.95 THEN 'dropped' ELSE 'stored' END AS outcome, count(*) AS n, round(avg(s), 5) AS mean_similarity FROM near GROUP BY 1""")  # fmt: skip
def dedup_audit(spark, sf_dir):
    rows = near_duplicate_vectors(spark, sf_dir)
    return rows.groupBy(F.when(F.col("duplicate"), "dropped").otherwise("stored").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 5).alias("mean_similarity"))


@query("f1_metadata_filter", f"WITH {CHUNKS_SQL} SELECT doc_id FROM chunks WHERE directory = 'en' AND type = 'vault' AND importance = 'high' AND list_contains(tags, 'work')")
def metadata_filter(spark, sf_dir):
    return chunks(spark, sf_dir).filter(search.metadata_filter("en", "vault", "high", ("work",))).select("doc_id")


@query("f2_type_alias", f"WITH {CHUNKS_SQL} SELECT doc_id FROM chunks WHERE vault_type = 'note'")
def type_alias(spark, sf_dir):
    return chunks(spark, sf_dir).filter(search.metadata_filter(kind="note")).select("doc_id")


@query("f3_sensitive_exclusion", f"WITH {CHUNKS_SQL} SELECT count(*) FILTER (directory NOT IN ('fr', 'de')) AS n_kept, count(*) FILTER (directory IN ('fr', 'de')) AS n_skipped FROM chunks")
def sensitive_exclusion(spark, sf_dir):
    hidden = F.col("directory").isin("fr", "de")
    return chunks(spark, sf_dir).agg(F.count_if(~hidden).alias("n_kept"), F.count_if(hidden).alias("n_skipped"))


@query("f6_relevance_threshold", f"WITH {RANKED_SQL} SELECT query_id, doc_id, relevance FROM ranked WHERE relevance >= 0.75")
def relevance_threshold(spark, sf_dir):
    return _ranked(spark, sf_dir).filter("relevance >= 0.75").select("query_id", "doc_id", "relevance")


@query("f7_skip_reason", r"""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 10 THEN 'short' WHEN starts_with(trim(text), '/') THEN 'slash_cmd'
  WHEN regexp_replace(lower(trim(text)), '[.!?]+$', '') IN ('thank you', 'sounds good', 'go ahead') THEN 'confirmation' WHEN starts_with(trim(text), '```') THEN 'code_block' END AS reason FROM conversations WHERE role = 'user'""")
def skip_reason(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", search.skip_reason(F.col("text")).alias("reason"))


@query("f14_preview", r"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents), h AS (SELECT *, left(f, 150) AS head FROM x)
SELECT doc_id, CASE WHEN length(f) <= 150 THEN f ELSE (CASE WHEN strpos(reverse(head), ' ') > 0 AND 150 - strpos(reverse(head), ' ') > 75 THEN left(head, 150 - strpos(reverse(head), ' ')) ELSE head END) || '...' END AS preview FROM h""")
def preview_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return search.previewed(docs).select("doc_id", "preview")


def _expansion_sql() -> str:
    """The tables of synonyms and intents written out; a word is bounded by what is no letter, digit or underscore."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    edges = lambda p: p.removeprefix(r"\b").removesuffix(r"\b")
    has = lambda p: rf"regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])({edges(p)})($|[^\p{{L}}\p{{N}}_])')"
    terms = ", ".join(f"CASE WHEN {has(trigger)} THEN {listed(words)} ELSE [] END" for trigger, words in SYNONYMS.items())
    extra = "CASE " + " ".join(f"WHEN {has(p)} THEN {listed(words)}" for p, _, words in INTENTS) + " ELSE [] END"
    intent = "CASE " + " ".join(f"WHEN {has(p)} THEN '{name}'" for p, name, _ in INTENTS) + " END"
    return rf"""WITH q AS (SELECT conv_id, turn, lower(CASE turn % 4 WHEN 0 THEN 'how to deploy the ' WHEN 1 THEN 'why did the db ' WHEN 2 THEN 'should we log the test ' ELSE 'ui ' END || text) AS low FROM conversations WHERE role = 'user'),
x AS (SELECT *, flatten([{terms}, {extra}]) AS l, string_split_regex(low, '\s+') AS own FROM q)
SELECT conv_id, turn, array_to_string(list_slice(list_filter(l, lambda w, i: list_position(l, w) = i AND NOT list_contains(own, w)), 1, 5), ',') AS terms, {intent} AS intent FROM x"""


@query("j8_query_expansion", _expansion_sql())
def query_expansion(spark, sf_dir):
    """A head and the user's whole text."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    head = F.when(F.col("turn") % 4 == 0, "how to deploy the ").when(F.col("turn") % 4 == 1, "why did the db ").when(F.col("turn") % 4 == 2, "should we log the test ").otherwise("ui ")
    asked = turns.withColumn("text", F.concat(head, F.col("text")))
    return search.expanded(asked).select("conv_id", "turn", F.array_join("terms", ",").alias("terms"), "intent")


@query("j9_concept_scoring", r"""WITH x AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(the|der|que)($|[^\p{L}\p{N}_])') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(token|license)($|[^\p{L}\p{N}_])') THEN 0.15 ELSE 0 END AS b FROM documents) SELECT doc_id, CAST(round(least(b, 0.2), 4) AS DOUBLE) AS bonus FROM x""")
def concept_scoring(spark, sf_dir):
    from corpuslake.options import Scoring

    options = Scoring(concepts=((r"\b(the|der|que)\b", 0.1), (r"\b(token|license)\b", 0.15)))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(scoring.concept_bonus(F.col("text"), options), 4).alias("bonus"))


CONCEPTS_SQL = " + ".join(rf"CASE WHEN regexp_matches(content, '(?i)(^|[^\p{{L}}\p{{N}}_])({p.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')})($|[^\p{{L}}\p{{N}}_])') THEN {bonus} ELSE 0 END" for p, bonus in CONCEPTS)
IMPORTANCE_SQL = f"""WITH {CHUNKS_SQL} SELECT doc_id, round(greatest(0, least(1, CASE vault_type WHEN 'note' THEN 0.55 ELSE 0.5 END + least(0.2, {CONCEPTS_SQL})
  + round(0.1 * exp(-0.693 * greatest({DAYS_SQL}, 0) / 7.0), 4) + CASE WHEN retrieval_count > 0 THEN least(0.1, round(log2(retrieval_count + 1) / 10, 4)) ELSE 0 END)), 4) AS importance_score FROM chunks"""


@query("x2_importance", IMPORTANCE_SQL)
def importance(spark, sf_dir):
    rows = chunks(spark, sf_dir, concepts=scoring.concept_bonus(F.col("text")))
    score = scoring.importance_with(F.col("concepts"), F.col("vault_type"), F.lit(None).cast("string"), F.col("updated_at"), F.col("retrieval_count"), _as_of())
    return rows.select("doc_id", F.round(score, 4).alias("importance_score"))


@query("s11_context_block", rf"""WITH {RANKED_SQL}, p AS (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS f FROM ranked), v AS (
  SELECT *, CASE WHEN length(f) <= 150 THEN f ELSE (CASE WHEN strpos(reverse(left(f, 150)), ' ') > 0 AND 150 - strpos(reverse(left(f, 150)), ' ') > 75 THEN left(f, 150 - strpos(reverse(left(f, 150)), ' ')) ELSE left(f, 150) END) || '...' END AS preview FROM p)
SELECT query_id, '<context>' || chr(10) || string_agg('<memory source="' || parent_file || '" relevance="' || printf('%.2f', relevance) || '">' || replace(replace(replace(preview, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</memory>', chr(10) ORDER BY relevance DESC, doc_id) || chr(10) || '</context>' AS block, count(*) AS n_matches FROM v GROUP BY query_id""")
def context_blocks(spark, sf_dir):
    return search.context_block(search.previewed(_ranked(spark, sf_dir)))


@query("s12_telemetry", rf"""WITH {RANKED_SQL}, p AS (SELECT query_id, relevance, trim(regexp_replace(content, '\s+', ' ', 'g')) AS f FROM ranked),
m AS (SELECT query_id, count(*) AS n_matches, round(max(relevance), 4) AS best, sum(length({PREVIEW_SQL})) AS used FROM p GROUP BY query_id)
SELECT vec_id AS query_id, CAST(length('what about ' || vec_id) AS INTEGER) AS prompt_chars, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, best, CAST(coalesce(used, 0) AS BIGINT) AS used FROM embeddings LEFT JOIN m ON query_id = vec_id WHERE vec_id % 20 = 0""")
def telemetry(spark, sf_dir):
    """Telemetry rows written as JSON lines and read back."""
    from corpuslake.sources import tables

    prompts = _asked(spark, sf_dir).select("query_id", F.concat(F.lit("what about "), "query_id").alias("text"))
    path = tables.new_path(spark, "telemetry")
    tables.write_telemetry(search.telemetry(prompts, search.previewed(_ranked(spark, sf_dir))), path)
    rows = tables.telemetry(spark, path)
    return rows.select(F.col("query_id").cast("long").alias("query_id"), "prompt_chars", F.col("n_matches").cast("long").alias("n_matches"), F.round(F.get("scores", F.lit(0)), 4).alias("best"), F.col("used").cast("long").alias("used"))


@query("a29_telemetry_report", f"""WITH {RANKED_SQL} SELECT count(*) AS n_scores, round(avg(relevance), 4) AS mean_score, round(min(relevance), 4) AS least, round(max(relevance), 4) AS most FROM ranked""")
def telemetry_report(spark, sf_dir):
    ranked = search.previewed(_ranked(spark, sf_dir))
    prompts = ranked.select("query_id").distinct().withColumn("text", F.lit(""))
    return search.telemetry_report(search.telemetry(prompts, ranked))


@query("w6_two_bin_budget", f"WITH RECURSIVE {ranked_sql(60, 20)}, {budget_sql('ranked')} SELECT query_id, place, doc_id, mode FROM picked")
def two_bin_budget(spark, sf_dir):
    """Also held against a plain loop in tests/test_search.py."""
    ranked = _ranked(spark, sf_dir, 20).withColumn("is_vault", F.col("type") == "vault")
    return search.within_budget(ranked)


@query("a4_best_chunk", f"WITH {RANKED_SQL} SELECT query_id, parent_file, doc_id, relevance FROM one")
def best_chunk(spark, sf_dir):
    found = search.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), 15)
    return search.best_of_files(search.scored(found, chunks(spark, sf_dir), _as_of())).select("query_id", "parent_file", "doc_id", "relevance")


@query("w4_result_rank", f"WITH {ranked_sql(60, 20)} SELECT query_id, CAST(rank AS INTEGER) AS rank, parent_file FROM ranked")
def result_rank(spark, sf_dir):
    return _ranked(spark, sf_dir, 20).select("query_id", "rank", "parent_file")


@query("t2_clamped_top", f"SELECT 100 AS asked, query_id, doc_id FROM (WITH {ranked_sql(60, 20)} SELECT * FROM ranked) UNION ALL SELECT 0, query_id, doc_id FROM (WITH {ranked_sql(15, 1)} SELECT * FROM ranked)")
def clamped_top(spark, sf_dir):
    """A hundred results are cut to twenty of at most sixty fetched, none are raised to one."""
    near = lambda k: search.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), k)
    many, none = Search(n_results=100), Search(n_results=0)
    rows = lambda n, found, options: search.reranked(found, chunks(spark, sf_dir), _as_of(), options).select(F.lit(n).alias("asked"), "query_id", "doc_id")
    return rows(100, near(min(many.overfetch * many.n_results, many.most_fetched)), many).union(rows(0, near(15), none))


@query("v2_cosine_distance", "SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_distance(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(scoring.cosine_distance(F.col("embedding"), F.col("next")), 6).alias("distance"))


@query("v4_index_recall", "SELECT count(*) AS n_queries, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0")
def index_recall(spark, sf_dir):
    """The index's answers against the exact ones: is at least nine tenths of them found."""
    exact, found = (f(spark, sf_dir).select("query_id", "doc_id") for f in (exact_top_k, index_search))
    met = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))
