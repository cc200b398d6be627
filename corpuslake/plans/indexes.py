"""Queries on the quantised and the filtered index over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import filtered, ingest, quantised, search
from corpuslake.plans.base import CHUNKS_SQL, chunks, query, table
from corpuslake.plans.search import _asked, _vectors
from corpuslake.sources.tables import new_path


def _clustered(spark, sf_dir):
    """The vectors drawn to one of twenty of their own."""
    rows = _vectors(spark, sf_dir)
    centres = rows.filter("doc_id < 20").select(F.col("doc_id").alias("c"), F.col("embedding").alias("centre"))
    near = F.zip_with("centre", "embedding", lambda a, b: (a + b * 0.4).cast("float"))
    return rows.join(F.broadcast(centres), F.col("doc_id") % 20 == F.col("c")).select("doc_id", near.alias("embedding"))  # 20 rows


def _every_twentieth(rows):
    return rows.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


@query("v4_quantised_search")
def quantised_search(spark, sf_dir):
    """Held against the exact search by v4_quantised_recall."""
    return quantised.QuantisedIndex(_vectors(spark, sf_dir)).search(_asked(spark, sf_dir), 15).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


def quantised_figures(spark, sf_dir):
    """(data, n_queries, recall, share): what the index finds of the exact neighbours, and the greatest share of the
    vector bytes that a query touches, on the given vectors and on clustered ones."""
    out = []
    for name, rows in (("given", _vectors(spark, sf_dir)), ("clustered", _clustered(spark, sf_dir))):
        asked, index = _every_twentieth(rows), quantised.QuantisedIndex(rows)
        exact = search.nearest(asked, rows, 15).select("query_id", "doc_id")
        met = exact.join(index.search(asked, 15).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
        recall = met.agg(F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
        out.append(recall.crossJoin(index.bytes_share(asked).agg(F.max("share").alias("share"))).select(F.lit(name).alias("data"), "n_queries", "recall", "share"))  # one row each
    return ingest.unions(out)


@query("v4_quantised_figures")
def quantised_figures_query(spark, sf_dir):
    return quantised_figures(spark, sf_dir)


@query("v4_quantised_recall", "SELECT data, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS n_queries, TRUE AS enough, TRUE AS under_a_fifth FROM (VALUES ('given'), ('clustered')) v(data)")
def quantised_recall(spark, sf_dir):
    return quantised_figures(spark, sf_dir).select("data", "n_queries", (F.col("recall") >= 0.9).alias("enough"), (F.col("share") < 0.2).alias("under_a_fifth"))


def _filters(rows, k):
    """Each query's own tenant, number of results and filter."""
    of = lambda c, **cases: F.coalesce(*[F.when(c == int(i[1:]), v) for i, v in cases.items()], F.lit(""))
    i = (k / 20).cast("long")
    conditions = filtered.wanted_values(of(i % 4, _0="en", _1="de"), of(i % 3, _0="vault", _1="note"), of(i % 5, _0="high"), F.when(i % 2 == 0, F.array(F.lit("work"))))
    return rows.withColumns({"tenant_id": k % 3, "n": (i % 7).cast("int"), "wanted": conditions})


FILTERED_SQL = f"""WITH {CHUNKS_SQL}, r AS (SELECT c.*, embedding, CASE WHEN c.doc_id % 10 < 6 THEN 0 ELSE c.doc_id % 3 END AS tenant_id FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id),
q AS (SELECT vec_id AS query_id, embedding, vec_id % 3 AS tenant_id, vec_id // 20 AS i FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT query_id, r.doc_id, i % 7 AS n, greatest(0, least(2, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))) AS distance FROM q JOIN r ON r.tenant_id = q.tenant_id
  AND (CASE i % 4 WHEN 0 THEN directory = 'en' WHEN 1 THEN directory = 'de' ELSE TRUE END) AND (CASE i % 3 WHEN 0 THEN type = 'vault' WHEN 1 THEN vault_type = 'note' ELSE TRUE END) AND (i % 5 <> 0 OR importance = 'high') AND (i % 2 <> 0 OR list_contains(tags, 'work')))
SELECT query_id, doc_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rn FROM near) WHERE rn <= n"""


@query("j1_filtered", FILTERED_SQL)
def filtered_search(spark, sf_dir):
    """One tenant has over half of the rows; each query filters by its own directory, type, importance and tag."""
    path = new_path(spark, "tenant-blocks")
    rows = chunks(spark, sf_dir).join(_vectors(spark, sf_dir), "doc_id").withColumn("tenant_id", F.when(F.col("doc_id") % 10 < 6, 0).otherwise(F.col("doc_id") % 3))
    filtered.write_index(rows, path, filtered.row_values())
    asked = _filters(_asked(spark, sf_dir), F.col("query_id"))
    return filtered.filtered_nearest(spark, asked, path).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


@query("j1_one_tenant", f"""WITH r AS (SELECT doc_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE source = 'src3'), q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT query_id, doc_id, greatest(0, least(2, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))) AS distance FROM q, r)
SELECT query_id, doc_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rn FROM near) WHERE rn <= 5""")
def one_tenant(spark, sf_dir):
    """All queries ask one source's rows; the other sources' folders are not read."""
    path = new_path(spark, "source-blocks")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant_id")).join(_vectors(spark, sf_dir), "doc_id")
    filtered.write_index(rows, path, F.array().cast("array<string>"))
    asked = _asked(spark, sf_dir).withColumns({"tenant_id": F.lit("src3"), "n": F.lit(5), "wanted": F.array().cast("array<string>")})
    return filtered.filtered_nearest(spark, asked, path).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))
