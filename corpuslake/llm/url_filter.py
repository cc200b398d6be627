"""URL filter: rules by host and path first; for the rest, concatenated host names are segmented into words by a unigram
Viterbi, and a multinomial naive Bayes scores the segmented host and the path's words.

Word counts come from all page titles and all path words, token counts from all pages that a rule decides; both stay
Spark tables of any size. Each distinct run of a host name meets the word counts at those of its own substrings that have
a word's length and hash (a filter of fixed size; the join settles the rest) and is segmented with those words only; weights are joined to the tokens of distinct hosts and distinct paths, and their sums to the pages.

Defined results. Null url, or one without `://`: empty host and path; no rule fits, and the naive Bayes prior decides.
The longest fitting rule wins; of equally long ones a block. Hosts and paths of any length are read whole. Repeated rows are each judged. An
input column `url_filter` stays as `url_filter_input`. Without pages of both
verdicts, undecided pages are allowed. Laplace smoothing over the tokens
of decided pages and one that stands for all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.shared import set_aside, written

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
    fits = [((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1]) for r in ordered]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)])
    return pick([r[0] + r[1] for r in ordered]), pick([r[2] for r in ordered])


@dataclass(frozen=True)
class Words:
    """Unigram model: log probabilities of words; unknown runs cost more by the letter."""

    logs: dict
    unseen: float

    @cached_property
    def sizes(self) -> list[int]:
        return sorted(set(map(len, self.logs)))

    def segment(self, name: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        run = (0.0, 0)  # where an unknown run that ends here starts at best: its cost is linear in its letters
        for end in range(1, len(name) + 1):
            options = [(run[0] + self.unseen - 4.0 * end, run[1])]
            for size in self.sizes:
                if size > end:
                    break
                known = self.logs.get(name[end - size : end])
                if known is not None:
                    options.append((best[end - size][0] + known, end - size))
            best.append(max(options))
            run = max(run, (best[end][0] + 4.0 * end, end))
        out, end = [], len(name)
        while end:
            start = best[end][1]
            out.append(name[start:end])
            end = start
        return out[::-1]


RUNS = r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+"
IS_NUMBER = r"^\p{Nd}+$"


def runs_of(text: Column) -> Column:
    """Runs of letters and of digits."""
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))


def word_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(word, n) of all titles and paths."""
    title = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    _, path = host_and_path(F.col(url))
    said = F.lower(F.concat_ws(" ", title, path))
    return pages.select(F.explode(F.split(said, r"[^\p{L}]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


ODD = 0x9E3779B97F4A7C15
FILTER_BITS = 26  # the word filter has at most 2^26 bits, 8 MB


def _rolled(codes: np.ndarray, inverse: np.ndarray, powers: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of `size` letters: polynomials modulo 2^64."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[: len(codes)], dtype=np.uint64)])
        x = (sums[size:] - sums[: len(sums) - size]) * inverse[: len(codes) - size + 1]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64))])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _word_filter(counts: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, a bit for the hash of each word): at most 2^FILTER_BITS bits, whatever the words."""
    bits = min(FILTER_BITS, max(10, int(16 * n).bit_length()))

    @F.pandas_udf("long")
    def slot(words: pd.Series) -> pd.Series:
        inverse = np.ones(1, np.uint64)
        return pd.Series([int(_rolled(c := _codes(w), inverse, _powers(len(c), ODD), len(c))[0] >> np.uint64(64 - bits)) for w in words], dtype="int64")

    masks = counts.select(slot("word").alias("s")).groupBy(F.shiftright("s", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63 AS INT)))").alias("mask"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    rows = masks.toPandas()
    out[rows["cell"].to_numpy()] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return bits, out


def _pieces(sizes: list[int], bits: int, words: np.ndarray):
    """(no, run) -> (no, word): each run's substrings that may be words - those of a length that words have whose hash
    is in the filter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("no", pa.int64()), ("word", pa.string())])
        inverse_base = pow(ODD, -1, 1 << 64)
        for batch in batches:
            for no, run in zip(*[c.to_pylist() for c in batch.columns]):
                codes = _codes(run)
                powers, inverse = _powers(len(codes), ODD), _powers(len(codes) + 1, inverse_base)
                found: set[str] = set()
                for size in sizes:
                    if size > len(codes):
                        break
                    at = _rolled(codes, inverse, powers, size) >> np.uint64(64 - bits)
                    hit = (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
                    found.update(run[i : i + size] for i in np.flatnonzero(hit).tolist())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([no] * len(found), pa.int64()), pa.array(sorted(found), pa.string())], schema=schema)

    return cut


SALTS, SHORT = 16, 3  # words of up to SHORT letters are in very many runs


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run) distinct runs of letters, (word, n) counts -> (run, words): the likeliest segmentation.

    Rows between are (number of the run, word it holds): they grow with a run's length times the words in it, and the counts of short
    words are met in SALTS parts."""
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.collect_set(F.length("word")).alias("sizes")).first()
    total, unseen = (whole["n"] or 0) + 1, -math.log((whole["n"] or 0) + 1)
    named = written(runs.withColumn("no", F.monotonically_increasing_id()), "url-runs")
    is_short = F.length("word") <= SHORT
    bits, words = _word_filter(counts, whole["words"])
    met = named.select("no", "run").mapInArrow(_pieces(sorted(whole["sizes"]), bits, words), "no long, word string").withColumn("salt", F.when(is_short, F.pmod("no", F.lit(SALTS))).otherwise(0).cast("int"))
    dealt = counts.withColumn("salt", F.explode(F.when(is_short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    own = met.join(dealt, ["word", "salt"]).groupBy("no").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("n"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segment(run: pd.Series, known: pd.Series, n: pd.Series) -> pd.Series:
        none = ((), ())
        out = [Words({w: math.log(c / total) for w, c in zip(*((ws, cs) if ws is not None else none))}, unseen).segment(r) for r, ws, cs in zip(run, known, n)]
        return pd.Series(out, dtype=object)

    return named.join(own, "no", "left").select("run", segment("run", "known", "n").alias("words"))


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host) distinct -> (host, token, n)."""
    each = hosts.select("host", F.explode(runs_of(F.col("host"))).alias("run"))
    is_number = F.col("run").rlike(IS_NUMBER)
    words = segmented(each.filter(~is_number).select("run").distinct(), counts)
    said = each.filter(~is_number).join(words, "run").select("host", F.explode(F.transform("words", lambda x: F.concat(F.lit("h:"), x))).alias("token"))
    last = hosts.select("host", F.concat(F.lit("t:"), F.element_at(F.split("host", r"\."), -1)).alias("token"))
    return said.union(each.filter(is_number).select("host", F.lit("h:#").alias("token"))).union(last).groupBy("host", "token").agg(F.count(F.lit(1)).alias("n"))


def path_tokens(path: Column) -> Column:
    return F.transform(runs_of(F.lower(path)), lambda x: F.concat(F.lit("p:"), F.when(x.rlike(IS_NUMBER), "#").otherwise(x)))


def weights(tallied: DataFrame) -> tuple[DataFrame, float]:
    """(token, block, allow) -> ((token, odds): exact log odds of block, those of a token that no decided page has)."""
    whole = tallied.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("n")).first()
    block, allow = (whole["block"] or 0) + whole["n"] + 1, (whole["allow"] or 0) + whole["n"] + 1
    other = math.log(allow / block)
    return tallied.select("token", (F.ln(F.col("block") + 1) - F.ln(F.col("allow") + 1) + other).alias("odds")), other


def judged(pages: DataFrame, url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with a struct column `url_filter`: host, path, rule, verdict, score (log odds of block; null by rule)."""
    pages, (url, html) = set_aside(pages, ("url_filter",), (url, html))
    host, path = host_and_path(F.col(url))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    read = pages.withColumn("__host", host).withColumn("__path", path).withColumn("__rule", rule).withColumn("__verdict", verdict)
    is_block, is_allow = F.col("verdict") == "block", F.col("verdict") == "allow"
    urls = written(read.groupBy(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("n")), "url-distinct")
    by_host = urls.groupBy("host").agg(F.sum(F.when(is_block, F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(is_allow, F.col("n")).otherwise(0)).alias("allow"))
    classes = by_host.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    if classes["block"] and classes["allow"]:
        prior = math.log(classes["block"] / classes["allow"])
        hosts = written(host_tokens(urls.select("host").distinct(), written(word_counts(pages, url, html), "url-words")), "url-host-tokens")
        in_hosts = hosts.join(by_host.filter("block + allow > 0"), "host").select("token", (F.col("n") * F.col("block")).alias("block"), (F.col("n") * F.col("allow")).alias("allow"))
        in_paths = urls.filter("verdict IS NOT NULL").select(F.explode(path_tokens(F.col("path"))).alias("token"), F.when(is_block, F.col("n")).otherwise(0).alias("block"), F.when(is_allow, F.col("n")).otherwise(0).alias("allow"))
        odds, other = weights(written(in_hosts.union(in_paths).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-tokens"))
        asked = urls.filter("verdict IS NULL")
        scored = lambda rows, by, into: rows.join(odds, "token", "left").groupBy(by).agg(F.sum(F.col("n") * F.coalesce("odds", F.lit(other))).alias(into))
        of_host = scored(hosts.join(asked.select("host").distinct(), "host", "left_semi"), "host", "__of_host")
        of_path = scored(asked.select("path").distinct().select("path", F.explode(path_tokens(F.col("path"))).alias("token")).groupBy("path", "token").agg(F.count(F.lit(1)).alias("n")), "path", "__of_path")
        # rounded: the order of a sum must not turn a verdict
        both = asked.join(of_host, "host", "left").join(of_path, "path", "left").select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.round(F.lit(prior) + F.coalesce("__of_host", F.lit(0.0)) + F.coalesce("__of_path", F.lit(0.0)), 9).alias("__score"))
        on = (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p"))
        decided = read.join(both, on, "left")
    else:
        decided = read.withColumn("__score", F.lit(-1.0))
    column = F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
        F.coalesce(F.col("__verdict"), F.when(F.col("__score") > 0, F.lit("block")).otherwise("allow")).alias("verdict"),
        F.when(F.col("__verdict").isNull(), F.col("__score")).alias("score"),
    )
    return decided.select(*[F.col(f"`{c}`") for c in pages.columns], column.alias("url_filter"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.select("page_id", *[F.col(f"url_filter.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])
