"""SQL names of the library's expressions: SQL functions that Catalyst inlines (N4), and chunks as a lateral table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFINITIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION slug(s STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(s)), '[^\\\\w\\\\s-]', ''), '[\\\\s_]+', '-'), '-+', '-'), '^-+|-+$', '')",
    "CREATE OR REPLACE TEMPORARY FUNCTION relevance(d DOUBLE, boost DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(1D, 1D - d / 2D + boost))",
    "CREATE OR REPLACE TEMPORARY FUNCTION retrieval_bonus(n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN least(0.1D, round(log2(n + 1) / 10, 4)) ELSE 0D END",
    "CREATE OR REPLACE TEMPORARY FUNCTION id_tier(id STRING) RETURNS STRING RETURN CASE WHEN split_part(id, '::', 1) IN ('obs', 'pattern', 'summary', 'code', 'rel', 'hint', 'plan', 'learning', 'decision', 'worklog') AND contains(id, '::') THEN 'ephemeral' ELSE 'durable' END",
    "CREATE OR REPLACE TEMPORARY FUNCTION word_jaccard(a STRING, b STRING) RETURNS DOUBLE RETURN coalesce(try_divide(size(array_intersect(split(lower(a), ' '), split(lower(b), ' '))), size(array_union(split(lower(a), ' '), split(lower(b), ' ')))), 0D)",
)


def register(spark: SparkSession) -> None:
    for statement in DEFINITIONS:
        spark.sql(statement)


def chunk_view(docs: DataFrame, view: str = "chunk_rows") -> DataFrame:
    """Chunks of parsed documents as rows, under a SQL name."""
    from corpuslake.operators.ingest import with_chunks

    chunked = with_chunks(docs)
    rows = chunked.select(*docs.columns, F.posexplode("pieces").alias("chunk_index", "chunk"))
    rows.createOrReplaceTempView(view)
    return rows
