"""Compression classifier: one zstandard dictionary of good and one of bad labelled texts; the difference of a text's
sizes under the two, by the square root of its length, is the evidence, and a logistic calibration turns it into a score.

Learning reads a bounded number of rows: at most PER_CLASS labelled texts a class, those of least id hash, whole. Two
fifths of them make the class's dictionary, every byte of them. The others fit the calibration, so no text calibrates a
dictionary that holds it. Sizes are taken in tasks; only teaching texts and differences reach the driver.
Every text of the table is then scored whole, in one narrow pass.

Defined results. Null text: as empty. Empty texts get the score of the difference 0. Labels other than 0 and
1, null ids and ids without a text teach nothing; repeated rows teach once an id. Without both classes the score is 0.5.
Labels, language, source and id never enter a score. An input column named like the result stays as `<name>_input`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.shared import set_aside, written

PER_CLASS = 1000
LEVEL = 9
FOLDS = 5
CUTOFF = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = field(default=())


@lru_cache(maxsize=4)
def _compressor(data: bytes):
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)


def differences(texts: pd.Series, good: bytes, bad: bytes) -> np.ndarray:
    """Bytes more under the bad dictionary than under the good one, by the square root of the length."""
    with_good, with_bad = _compressor(good), _compressor(bad)
    bodies = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([(len(b), len(with_good.compress(b)), len(with_bad.compress(b))) for b in bodies], float).reshape(-1, 3)
    return (sizes[:, 2] - sizes[:, 1]) / np.sqrt(sizes[:, 0] + 20)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(curve, slope)
        weights = weights + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return weights


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_class: int) -> DataFrame:
    """(label, id, text, teaches): at most per_class whole texts of each label; two fifths, one at least, teach."""
    named = labels.filter(remainder(F.col(doc_id)) != 0).filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("label"))
    there = named.join(docs.select(F.col(doc_id).alias("id")).distinct(), "id")
    least = [F.xxhash64("id"), F.col("id")]
    kept = written(reduce(DataFrame.union, [there.filter(F.col("label") == v).orderBy(*least).limit(per_class) for v in (0, 1)]), "quality-ids")
    w = Window.partitionBy("label").orderBy(*least)  # over at most per_class rows a label from here on
    parts = kept.groupBy("label").agg(F.greatest(F.floor(F.count(F.lit(1)) * 2 / 5), F.lit(1)).alias("teachers"))
    roles = kept.withColumn("rn", F.row_number().over(w)).join(F.broadcast(parts), "label").select("id", "label", (F.col("rn") <= F.col("teachers")).alias("teaches"))
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(roles), "id")
    return written(texts.groupBy("id", "label", "teaches").agg(F.min("text").alias("text")), "quality-sample")


def _dictionary(texts: DataFrame) -> bytes:
    """All different teaching texts, whole: a bounded number of rows."""
    rows = texts.filter("text <> ''").select("text").distinct().orderBy(F.xxhash64("text"), "text").collect()
    return b"".join(r["text"].encode("utf-8", "surrogatepass") + b"\n" for r in rows)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from labelled rows of the folds other than 0."""
    sample = _sample(docs, labels, doc_id, text, label, per_class)
    good, bad = (_dictionary(sample.filter(F.col("teaches") & (F.col("label") == value))) for value in (1, 0))
    if not good or not bad:
        return Model(good, bad)

    @F.pandas_udf(T.DoubleType())
    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series(differences(series, good, bad))

    rest = sample.filter("NOT teaches").select("label", difference("text").alias("d")).collect()  # numbers of at most 2 * per_class rows
    if len({r["label"] for r in rest}) < 2:
        return Model(good, bad)
    x = np.array([(1.0, r["d"]) for r in rest])
    return Model(good, bad, tuple(_logistic(x, np.array([float(r["label"]) for r in rest]))))


def scorer(model: Model):
    """A column function: text -> score."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            if not model.weights or not len(series):
                yield pd.Series(np.full(len(series), 0.5))
                continue
            z = model.weights[0] + model.weights[1] * differences(series, model.good, model.bad)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    docs, (text,) = set_aside(docs, (into,), (text,))
    return docs.withColumn(into, scorer(model)(F.col(f"`{text}`")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
