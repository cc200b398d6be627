"""Rule bitmask ledger: every rule is evaluated once per document and leaves one failure bit and its
measurements; versioned policies and ablations are then bit operations on the ledger.

Defined results. Null or empty text: no words, all counts 0, fails `few_words`. Words are maximal runs of
bytes other than space and \\x09-\\x0D, so `bytes.split()` finds them. Ties and repeated rows: each row is
judged by itself. Columns of the input other than the text pass through unread, also where their names equal
those of the measurements (nested in one struct column); a column named like that struct stays as `<name>_input`.
A very long text is measured whole; the measuring holds its words and five-word windows, some thirty times its bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.shared import set_aside

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: The rules; a rule's position is its bit. Thresholds are integers, so that they compare without rounding.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the keep decision: a document goes if one of these rules failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
DEFAULT = Policy("default-1", ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words"))

MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def _repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, covered = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + WINDOW - max(at, covered)
            covered = at + WINDOW
    return total


def _measure(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    letters = b"".join(words)
    lines = [line for line in data.split(b"\n") if line.split()]
    return (
        len(words),
        len(letters) - sum(map(letters.count, _CONTINUATION)) if not letters.isascii() else len(letters),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
    )


#: The bytes that continue a code point in UTF-8.
_CONTINUATION = [bytes([b]) for b in range(0x80, 0xC0)]


@F.pandas_udf(MEASURES)
def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in texts:
        yield pd.DataFrame([_measure(t) for t in series], columns=MEASURES.fieldNames())


def failure_bits(values: str) -> Column:
    """The rules as one bitmask over the measurements in the struct column `values`."""
    import re

    names = "|".join(MEASURES.fieldNames())
    on = lambda rule: re.sub(rf"\b({names})\b", rf"`{values}`.\1", rule)
    return F.expr(" | ".join(f"IF({on(rule)}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES)))


def ledger(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """docs with one more struct column `into`: the measurements and `bits`. One narrow pass, no shuffle."""
    docs, (text,) = set_aside(docs, (into,), (text,))
    measured = docs.withColumn(into, measures(F.col(f"`{text}`")))
    return measured.withColumn(into, F.col(into).withField("bits", failure_bits(into)))


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The documents that pass the policy, with the columns they came with."""
    into = "__ledger"
    return ledger(docs, text, into).filter(passes(F.col(f"{into}.bits"), policy)).drop(into)


def ablations(books: DataFrame, policy: Policy = DEFAULT, bits: str = "ledger.bits") -> DataFrame:
    """For each rule of a policy, from the bits alone: how many documents it rejects, how many it alone
    rejects, and how many the policy would keep without it. Sums of bit tests: one row per task is shuffled."""
    b, one = F.col(bits), F.lit(1)
    sums = [F.count(one).alias("n_docs"), F.count_if(passes(b, policy)).alias("n_kept")]
    for r in policy.rules:
        rest = Policy("", tuple(x for x in policy.rules if x != r))
        fails = b.bitwiseAND(F.lit(BITS[r]).cast("long")) != 0
        sums += [F.count_if(fails).alias(f"{r}_rejected"), F.count_if(fails & passes(b, rest)).alias(f"{r}_alone"), F.count_if(passes(b, rest)).alias(f"{r}_kept_without")]
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_rejected").alias("n_rejected"), F.col(f"{r}_alone").alias("n_alone"), F.col(f"{r}_kept_without").alias("n_kept_without")) for r in policy.rules]))
    return books.agg(*sums).select("n_docs", "n_kept", rows.alias("x")).select("x.*", "n_docs", "n_kept")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    books = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    v = "ledger."
    return books.select(
        "doc_id",
        *[F.col(v + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(F.col(v + "bits"), BASE)).alias("base_failed"),
        passes(F.col(v + "bits"), DEFAULT).alias("kept"),
        F.col(v + "n_lines").alias("n_lines"),
        F.col(v + "bits").alias("failure_bits"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, t, w, len(w) AS n_words,
    [array_to_string(list_slice(w, i, i + 4), ' ') FOR i IN range(1, len(w) - 3)] AS g,
    list_filter(string_split(t, chr(10)), lambda l: len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 0) AS lines
  FROM d
), g AS (
  SELECT doc_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS pos FROM x
), r AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT x.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM x LEFT JOIN c ON c.doc_id = x.doc_id
), b AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
    + 8 * (100 * n_dup_lines > 40 * n_lines)::INT + 16 * (word_chars > 12 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT AS BIGINT) AS failure_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
  failure_bits = 0 AS kept, n_lines, failure_bits
FROM b
"""


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the policy does, from the ledger's bits."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


ABLATIONS_SQL = f"""
WITH l AS ({OP2_SQL}), r(rule, bit) AS (VALUES {", ".join(f"('{name}', {bit})" for name, bit in BITS.items())})
SELECT rule, count(*) FILTER (failure_bits & bit <> 0) AS n_rejected, count(*) FILTER (failure_bits & bit <> 0 AND failure_bits & ({DEFAULT.mask} - bit) = 0) AS n_alone,
  count(*) FILTER (failure_bits & ({DEFAULT.mask} - bit) = 0) AS n_kept_without, count(*) AS n_docs, count(*) FILTER (failure_bits & {DEFAULT.mask} = 0) AS n_kept
FROM l, r GROUP BY rule
"""
