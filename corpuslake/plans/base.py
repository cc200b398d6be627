"""Registration of queries and the driver's tables seen as this library's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its DuckDB twin."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, **made: Column) -> DataFrame:
    """documents (with labels) as chunks: source is the parent file, language the directory; with columns made of the
    documents' own before the join."""
    docs, labels = table(spark, sf_dir, "documents").withColumns(made), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id", F.col("source").alias("parent_file"), F.col("lang").alias("directory"), F.col("text").alias("content"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("importance"),
        F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.2).cast("double").alias("importance_score"),
        F.timestamp_add("DAY", (F.col("doc_id") % 40).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("updated_at"),
        F.when(F.col("doc_id") % 3 == 0, "vault").when(F.col("doc_id") % 3 == 1, "observation").otherwise("pattern").alias("type"),
        F.when(F.col("doc_id") % 3 == 0, "note").alias("vault_type"),
        F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, "work"), F.when(F.col("doc_id") % 5 == 0, "idea"), F.when(F.col("doc_id") % 7 == 0, "home")), lambda x: x.isNotNull()).alias("tags"),
        (F.col("doc_id") % 6).cast("double").alias("retrieval_count"), *made,
    )


AS_OF = "2024-02-10 00:00:00"

CHUNKS_SQL = """chunks AS (
  SELECT d.doc_id, source AS parent_file, lang AS directory, text AS content,
    CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS importance,
    CAST(CASE quality WHEN 1 THEN 0.8 WHEN 0 THEN 0.2 END AS DOUBLE) AS importance_score,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d.doc_id % 40 AS INTEGER)) AS updated_at,
    CASE d.doc_id % 3 WHEN 0 THEN 'vault' WHEN 1 THEN 'observation' ELSE 'pattern' END AS type,
    CASE WHEN d.doc_id % 3 = 0 THEN 'note' END AS vault_type,
    list_filter([CASE WHEN d.doc_id % 2 = 0 THEN 'work' END, CASE WHEN d.doc_id % 5 = 0 THEN 'idea' END, CASE WHEN d.doc_id % 7 = 0 THEN 'home' END], lambda x: x IS NOT NULL) AS tags,
    CAST(d.doc_id % 6 AS DOUBLE) AS retrieval_count
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
DAYS_SQL = "(epoch_us(TIMESTAMP '2024-02-10 00:00:00') - epoch_us(updated_at)) / 86400000000.0"
