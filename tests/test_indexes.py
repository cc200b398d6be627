"""The filtered and the quantised index against plain search."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpuslake.operators import filtered, quantised


def test_bitmaps_come_back():
    rnd = random.Random(1)
    for n in (1, 7, 8, 9, 4096, 70_000):
        for share in (0.0, 0.001, 0.5, 1.0):
            rows = np.array([i for i in range(n) if rnd.random() < share], np.int64)
            assert np.flatnonzero(filtered.mask(filtered.bitmap(rows, n), n)).tolist() == rows.tolist()
    assert len(filtered.bitmap(np.array([5]), 4096)) < len(filtered.bitmap(np.arange(4096), 4096))
    assert not filtered.mask(None, 5).any()


def test_filtered_search_equals_a_plain_one(spark, tmp_path):
    rnd = random.Random(2)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    values = ["a", "b", "c"]
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), vec(), [v for v in values if rnd.random() < 0.5]) for i in range(300)]
    rows += [(i + 300, t, v, s) for i, (_, t, v, s) in enumerate(rows[:30])]  # equal vectors under other ids
    odd = [(1000, 1, None, ["a"]), (1001, 1, [], ["a"]), (None, 1, vec(), ["a"]), (1002, 1, [1.0, None, 0.0, 0.0], ["a"])]
    schema = "id long, tenant_id int, embedding array<double>, has array<string>"
    filtered.write_index(spark.createDataFrame(rows + odd, schema), str(tmp_path / "i"), F.col("has"), doc_id="id")
    asked = [(q, t, vec(), n, w) for q, (t, n, w) in enumerate([(1, 5, ["a"]), (1, 3, ["a", "b", "c"]), (None, 4, []), (2, 500, ["b"]), (9, 5, []), (1, 0, []), (1, -2, ["a"]), (2, 2, ["nothing"]), (1, 4, None)])] + [(99, 1, None, 3, [])]
    got = filtered.filtered_nearest(spark, spark.createDataFrame(asked, "query_id long, tenant_id int, embedding array<double>, n int, wanted array<string>"), str(tmp_path / "i"))
    want = set()
    for q, t, v, n, w in asked:
        if v is not None:
            near = sorted((round(1 - float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 9), i) for i, u, x, has in rows if u == t and set(w or []) <= set(has))
            want |= {(q, i) for _, i in near[: max(0, n)]}
    assert {(r["query_id"], r["doc_id"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [tenant#" in plan.replace("isnotnull(tenant", "tenant") or "PartitionFilters: [" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_asked_tenants_are_read(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 40).alias("tenant_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    filtered.write_index(rows, str(tmp_path / "i"), F.array().cast("array<string>"))
    asked = spark.createDataFrame([(1, 3, [1.0, 1.0], 2, [])], "query_id long, tenant_id long, embedding array<double>, n int, wanted array<string>")
    found = filtered.filtered_nearest(spark, asked, str(tmp_path / "i"))
    assert len(found.inputFiles()) and {r["doc_id"] % 40 for r in found.collect()} == {3}
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x and "tenant" in x]
    assert scans and all("t:3" in x for x in scans)


def test_conditions_are_those_of_the_metadata_filter(spark):
    row = spark.createDataFrame([("en", "vault", "note", None, ["x", "x"])], "directory string, type string, vault_type string, importance string, tags array<string>")
    assert sorted(row.select(filtered.row_values()).first()[0]) == ["directory=en", "tag=x", "type=vault", "vault_type=note"]
    asked = spark.createDataFrame([("en", "vault", "", ["x"]), (None, "note", "high", None)], "d string, k string, i string, t array<string>")
    got = [r[0] for r in asked.select(filtered.wanted_values(F.col("d"), F.col("k"), F.col("i"), F.col("t"))).collect()]
    assert got == [["directory=en", "tag=x", "type=vault"], ["importance=high", "vault_type=note"]]


def test_sums_are_near_the_products():
    rng = np.random.default_rng(3)
    x = quantised._unit(rng.normal(size=(4000, 32)).ravel(), 4000)
    model = quantised.Quantiser(x, len(x), parts=16, recall=0.94, k=10)
    lists, codes = model.encode(x)
    assert codes.dtype == np.uint8 and codes.shape == (4000, 16)
    exact, close = x[:50] @ x.T, model.sums(x[:50], lists, codes)
    assert np.abs(exact - close).mean() < 0.05
    assert 0 < model.share < 0.2 and 1 <= model.probes <= len(model.centres)


def test_recall_of_the_quantised_index(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = [(i, (centres[i % 30] + 0.5 * rng.normal(size=24)).tolist()) for i in range(3000)]
    rows = spark.createDataFrame([*x, (-1, None), (-2, []), (None, [0.1] * 24)], "doc_id long, embedding array<float>")
    index = quantised.QuantisedIndex(rows, parts=8, k=10, sample=1500)
    assert index.codes.count() == 3000
    asked = rows.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    got: dict = {}
    for r in index.search(asked, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    unit = np.array([v for _, v in x])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = [len(got[q] & set(np.argsort(-(unit @ unit[q]))[:10].tolist())) / 10 for q in range(0, 3000, 20)]
    assert np.mean(hits) >= 0.9 and len(got) == 150
    assert index.bytes_share(asked).agg(F.max("share")).first()[0] < 0.2
    empty = quantised.QuantisedIndex(rows.limit(0))
    assert empty.search(asked, 10).collect() == []


def test_rows_scored_again_do_not_grow_with_the_table(spark, monkeypatch):
    """Noise and a crowd of copies, small parts of blocks: recall holds, and a query's candidates are a count, not a share."""
    monkeypatch.setattr(quantised, "CODE_BLOCK", 50)
    monkeypatch.setattr(quantised, "QUERY_PART", 7, raising=False)
    x = np.random.default_rng(6).normal(size=(4000, 48))
    x[1000:1600] = x[1000]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>").repartition(4)
    index = quantised.QuantisedIndex(rows, k=15, sample=1000)
    asked = rows.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    assert index.again < 0.05 * 4000
    assert index.candidates(asked).groupBy("query_id").count().agg(F.max("count")).first()[0] <= index.again
    got = {(r.query_id, r.doc_id) for r in index.search(asked, 15).collect()}
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = {(q, int(d)) for q in range(0, 4000, 20) for d in np.argsort(np.round(1 - x @ x[q], 9), kind="stable")[:15]}
    assert len(got & exact) >= 0.9 * len(exact)
