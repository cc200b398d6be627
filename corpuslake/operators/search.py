"""Semantic search for whole tables of queries: exact and indexed nearest chunks, re-ranking, budgets, context blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import scoring
from corpuslake.functions.text import preview, xml_escaped
from corpuslake.options import ALL_TYPES, CONFIRMATIONS, INTENTS, SELF_PROMPT, SYNONYMS, Search
from corpuslake.sources.tables import new_path

QUERY_BLOCK, ROW_BLOCK = 512, 4096
PASS_BLOCKS = 32  # query blocks that are broadcast at once
QUERY_PART = 128  # queries in one matrix product
HELD = 250_000  # found rows, until those of each query that are too far go
ASKED = 256  # rows an index is measured with


def with_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v) of the rows that can be compared: null keys, null or empty vectors and vectors with null elements go."""
    v = F.col(vector)
    return df.select(F.col(key).alias("k"), v.alias("v")).filter(F.col("k").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _least(found: pa.Table, k: int, by: str = "query_id") -> pa.Table:
    """The k nearest rows of each query, of equal distances those with the least id."""
    order = found.sort_by([(by, "ascending"), ("rounded", "ascending"), ("doc_id", "ascending")])
    q = order.column(by).combine_chunks()
    n = len(q)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = pc.not_equal(q.slice(1), q.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return order.filter(pa.array(np.arange(n) - start < k))


def _block_top(k: int, with_self: bool):
    """(query keys and vectors, row keys in order and vectors) -> each query's k nearest rows of this task. Held: k rows
    a query, however many rows are equally near."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                qk, qv, rk, rv = (batch.column(c)[i].values for c in range(4))
                near = np.clip(1.0 - _unit(qv.to_numpy(zero_copy_only=False), len(qk)) @ _unit(rv.to_numpy(zero_copy_only=False), len(rk)).T, 0.0, 2.0)
                rounded = np.round(near, 9)
                if not with_self:
                    where = pc.index_in(qk, value_set=rk).to_numpy(zero_copy_only=False)  # null where the query is no row
                    own = np.flatnonzero(~np.isnan(where.astype(float)))
                    rounded[own, where[own].astype(int)] = np.inf
                keep = min(k, rounded.shape[1])
                edge = np.partition(rounded, keep - 1, axis=1)[:, keep - 1 : keep]
                below, equal = rounded < edge, rounded == edge
                equal &= np.cumsum(equal, axis=1) <= keep - below.sum(axis=1, keepdims=True)
                row, col = np.nonzero((below | equal) & np.isfinite(rounded))
                held.append(pa.table({"query_id": qk.take(pa.array(row)), "doc_id": rk.take(pa.array(col)), "distance": near[row, col], "rounded": rounded[row, col]}))
                size += len(row)
                if size > 1_000_000:
                    held = [_least(pa.concat_tables(held), k)]
                    size = 0
        if held:
            yield from _least(pa.concat_tables(held), k).drop(["rounded"]).to_batches()

    return top


def _stream_top(k: int, with_self: bool, last_block: int):
    """A task's first row once for each query block, then its other rows as they come -> each query's k nearest rows of this
    task. Held: the pass's queries, one part of a batch of rows, and at most k rows a query beside HELD new ones."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[int, pa.Array, np.ndarray]] = []  # (place of the first query, keys, unit vectors)
        edge = np.zeros(0)  # of each query, what a row must not exceed to be among the k nearest
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            qb = batch.column("qb").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(batch.column("qb_keys").is_valid().to_numpy(zero_copy_only=False)):
                keys, vectors = batch.column("qb_keys")[i].values, batch.column("qb_vectors")[i].values
                blocks.append((len(edge), keys, _unit(vectors.to_numpy(zero_copy_only=False), len(keys))))
                edge = np.append(edge, np.full(len(keys), np.inf))
            rows = batch.select(["k", "v"]).filter(pa.array(~(qb < last_block)))  # the first row counts once all queries are there
            for a in range(0, rows.num_rows, ROW_BLOCK):
                part = rows.slice(a, ROW_BLOCK)
                part = part.take(pc.sort_indices(part.column(0)))
                rk, y = part.column(0), _unit(part.column(1).flatten().to_numpy(zero_copy_only=False), part.num_rows).T
                for first, keys, x in blocks:
                    for c in range(0, len(keys), QUERY_PART):
                        qk = keys[c : c + QUERY_PART]
                        row, col, near, rounded = _block_least(x[c : c + QUERY_PART] @ y, edge[first + c : first + c + len(qk)], k, None if with_self else (qk, rk))
                        if len(row):
                            held.append(pa.table({"q": first + c + row, "query_id": qk.take(pa.array(row)), "doc_id": rk.take(pa.array(col)), "distance": near, "rounded": rounded}))
                            size += len(row)
                        if size > HELD:
                            held, size = [_least(pa.concat_tables(held), k, "q")], 0
                            q, last = held[0].column("q").to_numpy(), held[0].column("rounded").to_numpy()
                            full = np.flatnonzero(np.bincount(q, minlength=len(edge)) == k)
                            edge[full] = last[np.searchsorted(q, full, "right") - 1]
        if held:
            yield from _least(pa.concat_tables(held), k, "q").drop(["q", "rounded"]).to_batches(max_chunksize=100_000)

    return top


def _block_least(products: np.ndarray, edge: np.ndarray, k: int, keys: tuple | None) -> tuple[np.ndarray, ...]:
    """(query, row, distance, rounded distance) of the rows up to each query's edge, the k nearest of each at most; keys: of queries and
    rows, where a query must not meet itself. Lowers the edges. Rows are in key order, so of equal ones the first are taken."""
    near = np.clip(1.0 - products, 0.0, 2.0)
    rounded = np.round(near, 9)
    if keys:
        where = pc.index_in(keys[0], value_set=keys[1]).to_numpy(zero_copy_only=False)  # null where the query is no row
        own = np.flatnonzero(~np.isnan(where.astype(float)))
        rounded[own, where[own].astype(int)] = np.inf
    kept = (rounded <= edge[:, None]) & np.isfinite(rounded)
    many = np.flatnonzero(kept.sum(axis=1) > k)
    if len(many):
        some = rounded[many]
        last = np.partition(some, k - 1, axis=1)[:, k - 1 : k]
        below, equal = some < last, some == last
        equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= k - below.sum(axis=1, keepdims=True)
        kept[many] = below | equal
        edge[many] = last[:, 0]
    row, col = np.nonzero(kept)
    return row, col, near[row, col], rounded[row, col]


def nearest(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "embedding", with_self: bool = True) -> DataFrame:
    """Exact k nearest chunks of each query by cosine distance (J1, V2, V3): (query_id, doc_id, distance).

    Queries are packed into blocks of QUERY_BLOCK, PASS_BLOCKS of which are broadcast at once. Each task's first row brings them to its
    Python worker, once; the other rows follow as they are read, so rows are neither shuffled nor repeated, and a worker's memory
    does not grow with the table. A task passes on k rows a query. More queries take more passes over the rows. Rows and queries
    without a vector are in no result."""
    spark = queries.sparkSession
    asked = with_vectors(queries, query_id, vector)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    named = asked.withColumn("qb", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    pairs = F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv")
    packed = named.groupBy("qb").agg(pairs).select("qb", F.col("kv.k").alias("qb_keys"), F.flatten("kv.v").alias("qb_vectors"))
    path = new_path(spark, "query-blocks")
    packed.write.parquet(path)
    packed = spark.read.schema(packed.schema).parquet(path)
    rows = with_vectors(chunks, doc_id, vector)
    kinds = asked.schema["k"].dataType.simpleString(), rows.schema["k"].dataType.simpleString()
    of_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's place in its task
    found = None
    for low in range(0, blocks, PASS_BLOCKS):
        high = min(blocks, low + PASS_BLOCKS) - 1
        part = F.broadcast(packed.filter(F.col("qb").between(low, high)))
        every = F.sequence(F.lit(low), F.lit(high))
        spread = rows.withColumn("place", of_task).select("k", "v", F.explode_outer(F.when(F.col("place") == 0, every)).alias("qb"))
        met = spread.join(part, "qb", "left").select("qb", "qb_keys", "qb_vectors", "k", "v")
        top = met.mapInArrow(_stream_top(k, with_self, high), f"query_id {kinds[0]}, doc_id {kinds[1]}, distance double")
        found = top if found is None else found.union(top)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def scored(found: DataFrame, chunks: DataFrame, as_of: Column) -> DataFrame:
    """Found chunks with their columns and their relevance."""
    joined = found.join(chunks, "doc_id")
    return joined.withColumn("relevance", F.round(scoring.relevance(F.col("distance"), F.col("importance"), F.col("updated_at"), F.col("importance_score"), as_of), 6))


def best_of_files(rows: DataFrame) -> DataFrame:
    """The most relevant chunk of each file for each query; of equal ones the nearest, then the least id (A4)."""
    best = Window.partitionBy("query_id", "parent_file").orderBy(F.desc("relevance"), F.round("distance", 6), "doc_id")
    return rows.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")


def reranked(found: DataFrame, chunks: DataFrame, as_of: Column, options: Search = Search()) -> DataFrame:
    """Relevance, best chunk of each file, best n results of each query, ranked."""
    rank = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "parent_file")
    n = min(max(options.n_results, 1), options.most_results)
    one = best_of_files(scored(found, chunks, as_of))
    return one.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)


def held_out(sample: list) -> tuple[list, list]:
    """(rows to measure with, rows to fit on): at most ASKED and a quarter of the sample are kept from the fit, where they would be
    nearer to their centroids than the table's other rows are."""
    n = min(ASKED, len(sample) // 4)
    return (sample[:n], sample[n:]) if n else (sample, sample)


class Index:
    """Inverted-file index (V4): centroids fitted on a bounded sample, every row with a vector in the list of its nearest.

    The number of lists follows the rows (four times their square root, an eighth of the sample at most). A query probes
    as many lists as `recall` takes, measured against the exact search over all rows with sample rows that no centroid was fitted on."""

    def __init__(self, chunks: DataFrame, doc_id: str = "doc_id", vector: str = "embedding", sample: int = 20_000, recall: float = 0.95, k: int = 15, rounds: int = 8):
        self.doc_id, self.vector = doc_id, vector
        every = with_vectors(chunks, doc_id, vector)
        n = every.count()
        path = new_path(chunks.sparkSession, "index-sample")  # cut in a task; then at most `sample` rows come back
        every.orderBy(F.xxhash64("k"), "k").limit(sample).write.parquet(path)
        rows = chunks.sparkSession.read.schema(every.schema).parquet(path).orderBy(F.xxhash64("k"), "k").collect()
        asked, fitted = held_out(rows)
        x = _unit(np.array([r["v"] for r in fitted]), len(fitted)) if rows else np.zeros((0, 1))
        centres = x[: max(1, min(int(4 * n**0.5), len(x) // 8))].copy()
        for _ in range(rounds if len(x) else 0):
            near = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            held = np.bincount(near, minlength=len(centres)) > 0
            centres[held] = _unit(sums[held].ravel(), int(held.sum()))
        self.centres = centres
        self.rows = self._listed(chunks, doc_id, 1)
        self.probes = self._probes(asked, every, recall, k) if rows else 1

    def _probes(self, asked: list, every: DataFrame, recall: float, k: int) -> int:
        exact = nearest(every.sparkSession.createDataFrame(asked, every.schema), every, k, "k", "k", "v")
        found = exact.join(self.rows.select(F.col("k").alias("doc_id"), "list"), "doc_id").select("query_id", "list").collect()  # k rows a query of at most ASKED
        order = np.argsort(-(_unit(np.array([r["v"] for r in asked]), len(asked)) @ self.centres.T), axis=1, kind="stable")
        place, of = np.argsort(order, axis=1), {r["k"]: i for i, r in enumerate(asked)}
        needed = np.sort([place[of[r["query_id"]], r["list"]] for r in found])  # place of the list that holds each true neighbour
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1

    def _listed(self, df: DataFrame, key: str, n: int) -> DataFrame:
        centres = self.centres

        @F.pandas_udf("array<int>")
        def lists(vectors: pd.Series) -> pd.Series:
            x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, centres.shape[1]))
            return pd.Series(list(np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)), dtype=object)

        return with_vectors(df, key, self.vector).select("k", "v", F.explode(lists("v")).alias("list"))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", per_block: int = ROW_BLOCK) -> DataFrame:
        """Queries meet the rows of their `probes` nearest lists; the rows and the queries of a list are both cut into
        blocks of bounded size, so neither a long list nor one that many ask for is a hot spot."""
        count = lambda df, size, into: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(into))
        asked = self._listed(queries, query_id, self.probes)
        sizes = F.broadcast(count(self.rows, per_block, "rbs").join(count(asked, QUERY_BLOCK, "qbs"), "list"))  # one row a list
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place = lambda n: F.pmod(F.xxhash64("k"), n).cast("int")
        rows = self.rows.join(sizes, "list").select("list", place("rbs").alias("rb"), spread("qbs").alias("qb"), "k", "v")
        asked = asked.join(sizes, "list").select("list", spread("rbs").alias("rb"), place("qbs").alias("qb"), "k", "v")
        pairs = F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv")
        pack = lambda df, name: df.groupBy("list", "rb", "qb").agg(pairs).select("list", "rb", "qb", F.col("kv.k").alias(f"{name}_keys"), F.flatten("kv.v").alias(f"{name}_vectors"))
        met = pack(asked, "q").join(pack(rows, "r"), ["list", "rb", "qb"]).select("q_keys", "q_vectors", "r_keys", "r_vectors")
        kinds = asked.schema["k"].dataType.simpleString(), rows.schema["k"].dataType.simpleString()
        return _ranked(met.mapInArrow(_block_top(k, True), f"query_id {kinds[0]}, doc_id {kinds[1]}, distance double"), k)


def metadata_filter(directory: str = "", kind: str = "", importance: str = "", tags: tuple = ()) -> Column:
    """Conjunction of the given conditions; empty ones are ignored (F1, F2)."""
    out = F.lit(True)
    if directory:
        out = out & (F.col("directory") == directory)
    if kind:
        out = out & (F.col("type" if kind in ALL_TYPES else "vault_type") == kind)
    if importance:
        out = out & (F.col("importance") == importance)
    for tag in tags:
        out = out & F.array_contains("tags", tag)
    return out


def skip_reason(prompt: Column) -> Column:
    """Why a prompt needs no search, or null (F7); the first reason counts."""
    text = F.trim(prompt)
    plain = F.regexp_replace(F.lower(text), "[.!?]+$", "")
    return (
        F.when(F.length(text) < 10, "short").when(text.startswith("/"), "slash_cmd").when(plain.isin(*CONFIRMATIONS), "confirmation")
        .when(text.startswith("```"), "code_block").when(F.contains(F.left(text, F.lit(100)), F.lit(SELF_PROMPT)), "self_prompt")
    )


def prompt_text(raw: Column, keys: tuple = ("prompt", "user_prompt", "message.text", "message.content", "message")) -> Column:
    """The prompt of an event's JSON text: the first of the keys that has text, else empty."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(raw, f"$.{k}")), F.lit("")) for k in keys], F.lit(""))


def expanded(queries: DataFrame, text: str = "text", most: int = 5, synonyms: dict = SYNONYMS, intents: tuple = INTENTS) -> DataFrame:
    """Synonym terms of the triggers that occur as words, then those of the first matching intent; without words the
    query has already, at most five (J8). The tables are literals: they are options, not data."""
    low = F.lower(F.col(text))
    terms = [F.when(low.rlike(rf"\b{trigger}\b"), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for trigger, words in synonyms.items()]
    intent, extra = F.lit(None).cast("string"), F.array().cast("array<string>")
    for pattern, name, words in reversed(intents):
        intent = F.when(low.rlike(pattern), name).otherwise(intent)
        extra = F.when(low.rlike(pattern), F.array(*map(F.lit, words))).otherwise(extra)
    every = F.array_distinct(F.flatten(F.array(*terms, extra)))
    fresh = F.slice(F.array_except(every, F.split(low, r"\s+")), 1, most)
    return queries.withColumn("terms", fresh).withColumn("intent", intent).withColumn("expanded", F.trim(F.concat_ws(" ", F.col(text), F.array_join(fresh, " "))))


def within_budget(results: DataFrame, options: Search = Search(), by: str = "query_id") -> DataFrame:
    """Two-bin greedy budget by falling relevance: a row pays from its own half, else from the other.

    Rows of a query: (by, doc_id, relevance, is_vault, content). The fold runs over the query's results, which the
    fetch bound limits."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("order"), F.col("doc_id"), F.col("is_vault"), F.greatest(F.length("content"), F.lit(options.least_cost)).alias("cost"))))
    half = options.budget // 2
    start = F.struct(F.lit(half).alias("vault"), F.lit(half).alias("other"), F.expr("CAST(array() AS ARRAY<STRUCT<doc_id: BIGINT, mode: STRING>>)").alias("picked"))

    def step(a, x):
        cost = F.when(x["is_vault"], F.lit(options.reference_cost)).otherwise(x["cost"])
        own = F.when(x["is_vault"], a["vault"]).otherwise(a["other"])
        other = F.when(x["is_vault"], a["other"]).otherwise(a["vault"])
        from_own, from_other = own >= cost, (own < cost) & (other >= cost)
        vault = a["vault"] - F.when((x["is_vault"] & from_own) | (~x["is_vault"] & from_other), cost).otherwise(0)
        rest = a["other"] - F.when((~x["is_vault"] & from_own) | (x["is_vault"] & from_other), cost).otherwise(0)
        item = F.struct(x["doc_id"].cast("long").alias("doc_id"), F.when(x["is_vault"], "reference").otherwise("full").alias("mode"))
        return F.struct(vault.alias("vault"), rest.alias("other"), F.when(from_own | from_other, F.concat(a["picked"], F.array(item))).otherwise(a["picked"]).alias("picked"))

    folded = results.groupBy(by).agg(items.alias("items")).select(by, F.aggregate("items", start, step).alias("a"))
    return folded.select(by, F.posexplode("a.picked").alias("place", "p")).select(by, (F.col("place") + 1).alias("place"), "p.doc_id", "p.mode")


def served(prompts: DataFrame, chunks: DataFrame, vectors: DataFrame, as_of: Column, options: Search = Search(), embed=None) -> tuple[DataFrame, DataFrame]:
    """(prompts that need a search, their matches) (F7, J8, J1, F6, W6): matches with a preview, within each prompt's
    budget, `place` in the order in which the budget was spent."""
    asked = expanded(prompts.filter(skip_reason(F.col("text")).isNull()))
    asked = embed(asked) if embed else asked
    found = reranked(nearest(asked, vectors, min(options.overfetch * options.n_results, options.most_fetched)), chunks, as_of, options)
    found = found.filter(F.col("relevance") >= options.threshold)
    picks = within_budget(found.withColumn("is_vault", F.col("type") == "vault"), options)
    return asked, previewed(found.join(picks, ["query_id", "doc_id"]))


def context_block(matches: DataFrame, by: str = "query_id") -> DataFrame:
    """One escaped block of text for each query, by falling relevance."""
    line = F.concat(F.lit('<memory source="'), xml_escaped(F.col("parent_file")), F.lit('" relevance="'), F.format_number("relevance", 2), F.lit('">'), xml_escaped(F.col("preview")), F.lit("</memory>"))
    rows = matches.select(by, F.struct((-F.col("relevance")).alias("order"), F.col("doc_id"), line.alias("line")).alias("x"))
    return rows.groupBy(by).agg(F.concat(F.lit("<context>\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"), F.lit("\n</context>")).alias("block"), F.count(F.lit(1)).alias("n_matches"))


def telemetry(prompts: DataFrame, matches: DataFrame, by: str = "query_id") -> DataFrame:
    """A row for each prompt: lengths, scores, budget use."""
    scores = matches.groupBy(by).agg(F.sort_array(F.collect_list("relevance"), asc=False).alias("scores"), F.sum(F.length("preview")).alias("used"))
    return prompts.join(scores, by, "left").select(by, F.length("text").alias("prompt_chars"), F.coalesce(F.size("scores"), F.lit(0)).alias("n_matches"), "scores", F.coalesce("used", F.lit(0)).alias("used"))


def telemetry_report(rows: DataFrame) -> DataFrame:
    """Prompts, matches and score distribution of a telemetry table."""
    each = rows.select("n_matches", F.explode_outer("scores").alias("score"))
    return each.agg(F.count("score").alias("n_scores"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.min("score"), 4).alias("least"), F.round(F.max("score"), 4).alias("most"))


def previewed(df: DataFrame, most: int = 150) -> DataFrame:
    return df.withColumn("preview", preview(F.col("content"), F.lit("markdown"), most))
