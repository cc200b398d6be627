"""Link traversal: depth, hubs, cycles, and plans of bounded size."""

import random

from pyspark.sql import functions as F

from corpuslake.operators import changes


def reached(spark, edges, starts, depth):
    graph = spark.createDataFrame(edges, "src string, dst string")
    return changes.reachable(graph, spark.createDataFrame([(s,) for s in starts], "s string"), depth)


def plain(edges, starts, depth):
    out = set()
    for s in starts:
        seen, front = {s}, {s}
        for d in range(1, depth + 1):
            front = {b for a, b in edges if a in front and b is not None} - seen
            seen |= front
            out |= {(s, n, d) for n in front}
    return out


def test_chain_of_twelve_and_bounded_plan(spark):
    edges = [(str(i), str(i + 1)) for i in range(40)]
    deep, shallow = reached(spark, edges, ["0", "5"], 12), reached(spark, edges, ["0"], 2)
    assert {tuple(r) for r in deep.collect()} == plain(edges, ["0", "5"], 12)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(deep) < 2 * size(shallow)


def test_cycles_hubs_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(changes, "HUB_EDGES", 10)
    rnd = random.Random(4)
    edges = [("hub", f"n{i}") for i in range(95)] + [(f"n{i}", "hub") for i in range(0, 95, 7)] + [(f"n{rnd.randrange(95)}", f"m{rnd.randrange(60)}") for _ in range(150)] + [("m1", "m1"), (None, "n1"), ("n2", None), ("m3", "hub")]
    starts = ["hub", "n0", "m1", "nowhere"]
    got = [tuple(r) for r in reached(spark, edges, starts, 6).collect()]
    assert set(got) == plain(edges, starts, 6) and len(got) == len(set(got))
    edges_, hubs = changes._dealt(spark.createDataFrame(edges, "src string, dst string"))
    assert {r["src"] for r in hubs.collect()} >= {"hub"} and edges_.filter("src = 'hub'").agg(F.countDistinct("chunk")).first()[0] > 5


def test_nothing_to_reach(spark):
    assert reached(spark, [("a", "b")], ["c"], 5).collect() == []
    assert reached(spark, [("a", "b")], ["a"], 0).collect() == []
