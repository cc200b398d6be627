import re

from pyspark.sql import functions as F

from corpuslake.operators import search
from corpuslake.options import Search
from corpuslake.plans import search as plans


def test_index_recall(spark, small):
    exact = plans.exact_top_k(spark, small).select("query_id", "doc_id")
    found = plans.index_search(spark, small).select("query_id", "doc_id")
    assert exact.join(found, ["query_id", "doc_id"]).count() >= 0.9 * exact.count()


def test_results_are_sorted_and_one_a_file(spark, small):
    rows = plans.nearest_chunks(spark, small).collect()
    for q in {r.query_id for r in rows}:
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r.relevance for r in mine] == sorted((r.relevance for r in mine), reverse=True)
        assert len({r.parent_file for r in mine}) == len(mine)


def test_budget_equals_a_plain_loop(spark):
    options = Search(budget=1000)
    rows = [(q, d, 1.0 - d / 100 - (q % 3) / 7, (d * q) % 3 == 0, "x" * ((d * 37 + q * 11) % 400)) for q in range(1, 9) for d in range(12)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, relevance double, is_vault boolean, content string")
    got = {(r.query_id, r.place, r.doc_id, r.mode) for r in search.within_budget(df, options).collect()}
    want = set()
    for q in range(1, 9):
        left, place = {True: 500, False: 500}, 0
        for _, d, _, vault, body in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            cost = 120 if vault else max(len(body), 50)
            for half in (vault, not vault):
                if left[half] >= cost:
                    left[half] -= cost
                    place += 1
                    want.add((q, place, d, "reference" if vault else "full"))
                    break
    assert got == want


def test_skip_reasons(spark):
    cases = {"hi": "short", "/commit the changes": "slash_cmd", "Sounds good!!": "confirmation", "```python\nprint(1)\n```": "code_block", "What did we decide about retries?": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.why for r in df.select("t", search.skip_reason(F.col("t")).alias("why")).collect()} == cases


def test_expansion(spark):
    df = spark.createDataFrame([("how to deploy the API",), ("authority",), ("",)], "text string")
    rows = search.expanded(df).collect()
    assert rows[0].terms == ["endpoint", "rest", "http", "request", "deployment"] and rows[0].intent == "how-to"
    assert rows[1].terms == [] and rows[2].terms == []


def test_filters_match_nothing_or_all(spark):
    df = spark.createDataFrame([("en", "vault", "note", "high", ["work"])], "directory string, type string, vault_type string, importance string, tags array<string>")
    assert df.filter(search.metadata_filter()).count() == 1
    assert df.filter(search.metadata_filter(kind="note", tags=("work",))).count() == 1
    assert df.filter(search.metadata_filter(tags=("work", "home"))).count() == 0


def test_query_expansion_reads_whole_texts(spark, tmp_path):
    """Triggers and intents far into the user's own words count."""
    from corpuslake.options import INTENTS, SYNONYMS
    from corpuslake.plans import registry

    long = "plain words without any trigger " * 3
    heads = {0: "how to deploy the ", 1: "why did the db ", 2: "should we log the test ", 3: "ui "}
    said = [(1, 0, long + "then the auth"), (1, 3, long + "when did\nthe API break"), (1, 7, long + "should i"), (1, 2, "short"), (1, 11, long), (1, 15, "apis " * 9 + "k8s")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in said], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def plain(t, x):
        low = (heads[t % 4] + x).lower()
        intent, extra = next(((name, w) for pattern, name, w in INTENTS if re.search(pattern, low)), (None, ()))
        every = [w for k, ws in SYNONYMS.items() if re.search(rf"\b{k}\b", low) for w in ws] + list(extra)
        return ",".join([w for w in dict.fromkeys(every) if w not in low.split()][:5]), intent

    got = {r.turn: (r.terms, r.intent) for r in registry.QUERIES["j8_query_expansion"](spark, str(tmp_path)).collect()}
    assert got == {t: plain(t, x) for _, t, x in said}
    assert got[7][1] == "decision" and got[3][1] == "timeline" and "endpoint" in got[3][0]


def test_importance_reads_the_content(spark, tmp_path):
    from corpuslake.plans import registry

    texts = [(101, "plain words"), (102, "a note on Architecture"), (103, "the outage"), (104, "todo: a design after the incident"), (105, "designs, outages"), (106, None), (107, "TODO")]
    bonus = {101: 0, 102: 0.1, 103: 0.15, 104: 0.2, 105: 0, 106: 0, 107: 0.05}
    tables = {"documents": ([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string"), "labels": ([], "doc_id long, quality int")}
    plain = {"documents": ([(i, "", "en", "s") for i, _ in texts], tables["documents"][1]), "labels": tables["labels"]}
    got = {}
    for name, made in (("whole", tables), ("plain", plain)):
        for table, (rows, schema) in made.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        got[name] = {r.doc_id: r.importance_score for r in registry.QUERIES["x2_importance"](spark, f"{tmp_path}/{name}").collect()}
    assert got["whole"] == {i: round(got["plain"][i] + bonus[i], 4) for i, _ in texts}


def plain_nearest(queries, rows, k, with_self=True):
    import numpy as np

    unit = lambda v: np.array(v, float) / max(np.linalg.norm(v), 1e-30)
    good = lambda v: v is not None and len(v) and all(x is not None for x in v)
    out = set()
    for q, v in queries:
        if q is not None and good(v):
            near = [(round(min(2, max(0, 1 - float(unit(v) @ unit(w)))), 9), d) for d, w in rows if d is not None and good(w) and (with_self or d != q)]
            out |= {(q, d) for _, d in sorted(near)[:k]}
    return out


def test_nearest_with_nulls_ties_and_several_passes(spark, monkeypatch):
    """A vector that a third of the rows share, null and empty vectors, text ids, blocks of two rows."""
    import random

    rng = random.Random(1)
    vector = lambda i: [1.0, 0.5, 0.0] if i % 3 == 0 else None if i % 17 == 1 else [] if i % 19 == 1 else [1.0, None, 2.0] if i % 23 == 1 else [rng.gauss(0, 1) for _ in range(3)]
    rows = [(f"r{i:03d}" if i else None, vector(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id string, embedding array<float>").repartition(3)
    asked = df.withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    monkeypatch.setattr(search, "PASS_BLOCKS", 2)
    for with_self in (True, False):
        got = search.nearest(asked, df, 4, with_self=with_self)
        assert {(r.query_id, r.doc_id) for r in got.collect()} == plain_nearest(rows, rows, 4, with_self)
    index = search.Index(df)
    exact, found = plain_nearest(rows, rows, 4), {(r.query_id, r.doc_id) for r in index.search(asked, 4).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    none = df.limit(0)
    assert search.nearest(asked, none, 4).count() == 0 and search.nearest(none.withColumnRenamed("doc_id", "query_id"), df, 4).count() == 0
    assert search.Index(none).search(asked, 4).count() == 0


def test_rows_are_not_shuffled_by_the_exact_search(spark, small):
    plan = plans.exact_top_k(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(query_id") == 1


def test_index_recall_on_rows_that_no_centroid_was_fitted_on(spark):
    """Noise in 48 dimensions: the queries are other rows than those that shaped the centroids."""
    import numpy as np

    x = np.random.default_rng(8).normal(size=(4000, 48))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>")
    asked = rows.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.doc_id) for r in search.Index(rows).search(asked, 15).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = {(q, int(d)) for q in range(0, 4000, 20) for d in np.argsort(-(x @ x[q]))[:15]}
    assert len(got & exact) >= 0.9 * len(exact)


def test_exact_search_passes_each_row_to_python_once(spark, monkeypatch):
    """Queries in many blocks, some of them empty: what goes to the workers is the rows, and the queries once a task."""
    import numpy as np

    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 8)).round(1)
    x[:900] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    asked = df.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "HELD", 500, raising=False)
    found = search.nearest(asked, df, 7)
    assert {(r.query_id, r.doc_id) for r in found.collect()} == plain_nearest(rows[::20], rows, 7)
    plan = search.nearest(asked, df, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == -(-150 // 2 // search.PASS_BLOCKS)  # no packs of rows that each block would repeat
