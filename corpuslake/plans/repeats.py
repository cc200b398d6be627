"""Queries on near repeats of vectors: a radius join in batch, and against the stored rows of earlier batches in a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import ingest, radius
from corpuslake.plans.base import query
from corpuslake.plans.indexes import _clustered
from corpuslake.plans.search import _asked, _vectors
from corpuslake.sources.tables import new_path, written
from corpuslake.streaming import jobs

PARTS = 4  # the rows come in so many batches, by id


def _sql(pairs: str, asked: str) -> str:
    similarity = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6)"
    return f"""WITH near AS (SELECT q.vec_id AS query_id, r.vec_id AS doc_id, {similarity} AS s FROM embeddings q JOIN embeddings r ON {pairs}),
best AS (SELECT query_id, doc_id, s FROM near WHERE s >= 0.95 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) = 1)
SELECT vec_id AS query_id, doc_id, s AS similarity FROM embeddings LEFT JOIN best ON query_id = vec_id WHERE {asked}"""


def _judged(queries, rows, pivots):
    place = lambda df, key, at: written(radius.placed(df.withColumn("at", at), pivots, "at", key), "placed")
    return radius.repeats(place(queries, "query_id", F.lit(1)), place(rows, "doc_id", F.lit(0)), pivots)


@query("j6_repeats", _sql("q.vec_id % 20 = 0 AND r.vec_id % 20 <> 0", "vec_id % 20 = 0"))
def stored_repeats(spark, sf_dir):
    """New observations (every 20th vector): the stored one that each repeats, if any."""
    stored = _vectors(spark, sf_dir).filter("doc_id % 20 <> 0")
    return _judged(_asked(spark, sf_dir), stored, radius.fit_pivots(stored)).select("query_id", "doc_id", "similarity")


@query("j6_repeat_figures")
def repeat_figures(spark, sf_dir):
    """(data, n_queries, n_repeats, skipped): every row against all rows before it, on the given vectors and on clustered
    ones; `skipped` is the share of all pairs of rows that were ruled out without a product."""
    out = []
    for name, rows in (("given", _vectors(spark, sf_dir)), ("clustered", _clustered(spark, sf_dir))):
        pivots = radius.fit_pivots(rows)
        every = written(radius.placed(rows.withColumn("at", F.lit(0)), pivots, "at"), "placed")
        n = F.count(F.lit(1))
        found = radius.repeats(every, every, pivots).agg(n.alias("n_queries"), F.count("doc_id").alias("n_repeats"), F.round(1 - F.sum("compared") / (n * n), 4).alias("skipped"))
        out.append(found.select(F.lit(name).alias("data"), "n_queries", "n_repeats", "skipped"))
    return ingest.unions(out)


EARLIER_SQL = _sql(f"(r.vec_id % {PARTS}, r.vec_id) < (q.vec_id % {PARTS}, q.vec_id)", "TRUE")


@query("r7_near_repeats", EARLIER_SQL)
def near_repeats(spark, sf_dir):
    """Every row against all rows before it, in one job."""
    rows = _vectors(spark, sf_dir)
    pivots = radius.fit_pivots(rows)
    every = written(radius.placed(rows.withColumn("at", F.col("doc_id") % PARTS), pivots, "at"), "placed")
    return radius.repeats(every, every, pivots).select("query_id", "doc_id", "similarity")


@query("r7_near_stream", EARLIER_SQL)
def near_stream(spark, sf_dir):
    """The same as the rows come: each batch against the stored rows and its own earlier ones. Pivots are of the first batch."""
    rows, path, offsets = _vectors(spark, sf_dir), new_path(spark, "arriving"), new_path(spark, "arriving-offsets")
    store = None
    for part in range(PARTS):
        rows.filter(F.col("doc_id") % PARTS == part).write.parquet(f"{path}/{part}")
        store = store or radius.RepeatStore(spark, new_path(spark, "repeats"), radius.fit_pivots(spark.read.parquet(f"{path}/0")))
        jobs.each_batch(spark.readStream.schema(rows.schema).parquet(f"{path}/*"), jobs.near_repeat_handler(store), offsets)
    return store.judged().select("query_id", "doc_id", "similarity")
