"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by the extreme-value law.

Learning reads at most PER_CLASS labelled texts a class, whole, those of least id hash. Three fifths teach: in how many of
their different texts a unit stands, toxic and clean, is counted in Spark; a unit is a word or a word's beginning of STEMS
letters. Its score is the log-odds under a Dirichlet prior (PRIOR of the pooled frequencies and FLAT for each unit), moved
towards zero by SHRINK standard errors. Units whose score is not zero then are the lexicon, the only part that is sent to
tasks. A token scores as the unit of it that differs most; any other token, and one that repeats the token before it, costs DRIFT. The rest of the texts fits K and the
logistic calibration.

One scan a text, linear in its words, finds all maximal segments (each is the heaviest stretch around it, none overlap): sums
before and after each positive word are kept with a link to the last candidate that starts lower, so no candidate is
passed twice. In a clean text of n words the greatest segment exceeds S with probability 1 - exp(-K n exp(-L S)); L is the
root of the mean of exp(L score) over clean words, K is fitted on clean texts. Segments with K n exp(-L S) up to EXPECTED
are passages. A text's evidence is the best of the sum statistics of its r greatest normalised segments, in -log p; the
score is a logistic function of its logarithm alone.

Defined results. Null text: as empty. Texts without words have no evidence. Labels other than 0 and 1, null ids and ids
without a text teach nothing; repeated rows teach once an id, equal texts once. Without both classes the score is 0.5.
Labels, language, source and id never enter a score. Texts are read whole. Input columns named like a result stay as
`<name>_input`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.quality_classifier import _logistic, _sample, remainder
from corpuslake.llm.shared import set_aside

PER_CLASS = 5000
PRIOR, FLAT, SHRINK = 500.0, 0.1, 1.8
STEMS = range(4, 9)
REMEMBERED = 200_000  # words whose score a task keeps at hand
DRIFT = 0.2
EXPECTED = 0.05
CUTOFF = 0.5
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    words: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0  # L
    size: float = 1e-3  # K
    weights: tuple[float, ...] = ()


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def units(word: bytes) -> list[bytes]:
    """A word and its beginnings; a whole word ends with a mark that no word has."""
    letters = word.decode("utf-8", "surrogatepass")
    return [word + b"$", *(letters[:k].encode("utf-8", "surrogatepass") for k in STEMS if k < len(letters))]


class Lexicon(dict):
    """Word -> score, 0 if none of its units differs; filled as words come."""

    def __init__(self, of: dict[bytes, float]):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> float:
        score = max((self.of.get(u, 0.0) for u in units(word)), key=abs)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = score
        return score


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, past the last word, score) of a text whose words cost `drift` but for the
    hits (place, score), which are in order of place."""
    found: list[tuple[int, int, float, float, int]] = []  # first, past, sum before, sum after, last candidate that starts lower
    total, at = 0.0, 0
    for place, score in hits:
        total -= drift * (place - at)
        before, total, at = total, total + score, place + 1
        if score <= 0:
            continue
        first, past, low, high = place, at, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((first, past, low, high, j))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def evidence(scores: list[float], n: int, model: Model) -> float:
    """-log p of the best sum statistic of the r greatest normalised segments, r = 1, 2, ..."""
    best = total = 0.0
    for r, score in enumerate(sorted(scores, reverse=True), 1):
        x = model.rate * score - log(max(model.size * n, 1e-12))
        if x <= 0:
            break
        total += x
        best = max(best, total - (r - 1) * log(max(total, 1.0)) + lgamma(r + 1) + lgamma(r) - r * log(2.0))  # each further r is half as likely a choice
    return best


def scan(text: str | None, model: Model, known: Lexicon) -> tuple[int, list[tuple[int, int, float]], float]:
    """(words, all maximal segments, evidence) of a whole text."""
    words = words_of(text)
    found = segments([(i, s) for i, (w, last) in enumerate(zip(words, [b"", *words])) if (s := known[w]) and w != last])
    return len(words), found, evidence([s for _, _, s in found], len(words), model)


def _counts(sample: DataFrame) -> DataFrame:
    """(word, label, texts, tokens) over the different teaching texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(*[c.to_pylist() for c in batch.columns]):
                seen: Counter = Counter()
                for word, n in Counter(words_of(text)).items():
                    seen.update(dict.fromkeys(units(word), n))
                columns = [pa.array(seen.keys(), pa.binary()), pa.array([label] * len(seen), pa.int32()), pa.array([1] * len(seen), pa.int64()), pa.array(seen.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "label", "texts", "tokens"])

    texts = sample.filter("NOT teaches").select("label", "text").distinct()
    return texts.mapInArrow(count, "word binary, label int, texts long, tokens long").groupBy("word", "label").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))


def log_odds(table: DataFrame) -> DataFrame:
    """(word, score, clean): words whose log-odds differ from zero by more than SHRINK standard errors, and how often they
    stand in clean texts, of (word, label, texts, tokens)."""
    of = lambda c, label: F.sum(F.when(F.col("label") == label, F.col(c)).otherwise(0))
    words = table.groupBy("word").agg(of("texts", 1).alias("y1"), of("texts", 0).alias("y0"), of("tokens", 0).alias("clean"))
    sums = table.agg(of("texts", 1).alias("n1"), of("texts", 0).alias("n0"), F.countDistinct("word").alias("kinds"))  # one row
    prior = F.lit(PRIOR) * (F.col("y1") + F.col("y0")) / (F.col("n1") + F.col("n0")) + FLAT
    mass = F.lit(PRIOR) + F.lit(FLAT) * F.col("kinds")
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.col(n) + mass - F.col(y) - prior))
    delta, error = odds("y1", "n1") - odds("y0", "n0"), F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
    score = F.signum(delta) * F.greatest(F.abs(delta) - SHRINK * error, F.lit(0.0))
    return words.crossJoin(F.broadcast(sums)).select("word", score.alias("score"), "clean").filter("score <> 0")


def _rate(scores: np.ndarray, shares: np.ndarray, drift: float = DRIFT) -> float:
    """The positive root of the mean of exp(L score) = 1 over clean words."""
    mean = lambda x: (1 - shares.sum()) * exp(-x * drift) + float(shares @ np.exp(np.minimum(x * scores, 700)))
    low, high = 1e-6, 1e-6
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return max(low, 1e-3)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learns from labelled rows of the folds other than 0."""
    sample = _sample(docs, labels, doc_id, text, label, per_class)
    table = _counts(sample).cache()
    rows = log_odds(table).collect()  # of a bounded sample, and only words that differ
    tokens = table.filter("label = 0").agg(F.sum("tokens")).collect()[0][0] or 0
    both = table.select("label").distinct().count() == 2
    table.unpersist()
    if not both:
        return Model()
    scores = np.array([r["score"] for r in rows])
    rate = _rate(scores, (np.array([r["clean"] for r in rows], float) + 0.5) / (tokens + 0.5 * len(rows) + 1)) if rows else 1.0
    model = Model({bytes(r["word"]): r["score"] for r in rows}, rate)

    def told(m: Model) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Lexicon(m.words)
            for batch in batches:
                found = [scan(t, m, known) for t in batch.column(1).to_pylist()]
                most = [max((s for _, _, s in segs), default=0.0) for _, segs, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(most, pa.float64()), pa.array([e for *_, e in found], pa.float64())], names=["label", "n", "most", "evidence"])

        return sample.filter("teaches").select("label", "text").mapInArrow(run, "label int, n long, most double, evidence double").collect()  # numbers of at most 2 * per_class rows

    clean = [(r["n"], r["most"]) for r in told(model) if r["label"] == 0]
    size = (sum(x > 0 for _, x in clean) + 0.5) / (sum(n * exp(-rate * x) for n, x in clean) + 1.0)
    model = Model(model.words, rate, size)
    rest = told(model)
    if len({r["label"] for r in rest}) < 2:
        return model
    x = np.array([(1.0, log1p(r["evidence"])) for r in rest])
    return Model(model.words, rate, size, tuple(_logistic(x, np.array([float(r["label"]) for r in rest]))))


FOUND = "score double, evidence double, passages array<struct<start: int, end: int, score: double, expected: double>>"


def passages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, evidence and all significant passages (places of words, segment score, expected number)."""
    docs, (text,) = set_aside(docs, ("score", "evidence", "passages"), (text,))

    @F.pandas_udf(FOUND)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Lexicon(model.words)
        for texts in batches:
            out = []
            for t in texts:
                n, found, e = scan(t, model, known)
                z = model.weights[0] + model.weights[1] * log1p(e) if model.weights else 0.0
                sure = [(a, b, s, model.size * n * exp(-model.rate * s)) for a, b, s in found]
                out.append((1 / (1 + exp(-max(-30.0, min(30.0, z)))), e, [dict(zip(("start", "end", "score", "expected"), x)) for x in sure if x[3] <= EXPECTED]))
            yield pd.DataFrame(out, columns=["score", "evidence", "passages"])

    told = docs.withColumn("__told", judged(F.col(f"`{text}`")))
    return told.select("*", "__told.*").drop("__told")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = passages(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
