"""Readers and writers: note files, change logs, task snapshots, telemetry, promotion files, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_SCHEMA = "id STRING, content STRING, description STRING, labels ARRAY<STRING>, priority INT, project_id STRING, section_id STRING, parent_id STRING, is_completed BOOLEAN, created_at TIMESTAMP, due STRUCT<date: DATE, string: STRING, is_recurring: BOOLEAN, timezone: STRING>, duration STRUCT<amount: INT, unit: STRING>, deadline DATE"
CHANGE_SCHEMA = "commit_hash STRING, subject STRING, body STRING, ts TIMESTAMP, files ARRAY<STRUCT<path: STRING, status: STRING>>"
TELEMETRY_SCHEMA = "query_id STRING, prompt_chars INT, n_matches INT, scores ARRAY<DOUBLE>, used INT"
TRANSCRIPT_SCHEMA = "session_id STRING, line_idx BIGINT, raw STRING"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and the session is local, a temporary one, which
    becomes it. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def notes(spark: SparkSession, root: str, names: str = "*.{md,org}") -> DataFrame:
    """(path, content, modified_at) of the note files below a folder, paths relative to it; blank files go."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    full = F.col("_metadata.file_path")
    rows = files.select(F.regexp_replace(full, rf"^.*?\Q{root.rstrip('/').split(':')[-1]}\E/", "").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"))
    return rows.filter(F.trim("content") != "")


def change_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGE_SCHEMA).json(path)


def task_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Tasks as exported JSON lines (S9), with the due date beside its struct."""
    return spark.read.schema(TASK_SCHEMA).json(path)


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, body) of transcript files; the session is the file's name (S3)."""
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("session_id"), F.col("value").alias("body"))


def write_telemetry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY_SCHEMA).json(path)


def write_promotions(files: DataFrame, path: str) -> None:
    """Promoted documents, one folder for each type and project."""
    files.write.mode("append").partitionBy("vault_type", "project").parquet(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """Extraction requests for whatever answers them."""
    requests.write.mode("append").parquet(path)


def responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("session_id STRING, raw_json STRING, input_tokens BIGINT, output_tokens BIGINT").json(path)


def answered(requests: DataFrame, answer, schema: str = "session_id string, raw_json string") -> DataFrame:
    """Requests through a user's function prompt -> JSON text, a batch at a time."""

    def run(batches):
        for pdf in batches:
            out = pdf[["session_id"]].copy()
            out["raw_json"] = [answer(p) for p in pdf["prompt"]]
            yield out

    return requests.select(F.col("session_id").cast("string").alias("session_id"), "prompt").mapInPandas(run, schema)


def embedded(rows: DataFrame, model, text: str = "content", into: str = "embedding") -> DataFrame:
    """Rows with a user's model applied: a function of a list of texts to a list of vectors."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in model(texts.fillna("").tolist())], dtype=object)

    return rows.withColumn(into, embed(F.col(text)))
