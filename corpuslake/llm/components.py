"""Connected components of an edge table by contraction: nodes that point to the same neighbour become one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.shared import written


FEW = 20_000  # edges that one task may finish


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) edges of one task -> (node, to): any node of the component, the same for all."""
    parent: dict = {}

    def root(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            parent[root(a)] = root(b)
    yield pd.DataFrame([(n, root(n)) for n in list(parent)], columns=["node", "to"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each node's component, for nodes that have an edge to another.

    In a round every node points to the one of its neighbours that comes first in the round's random order, if that
    comes before itself, and moves two pointers on; nodes that meet are one, edges inside them and repeated edges go.
    So edges and nodes shrink by a factor in each round, chains and hubs alike. The minima are combined before the
    shuffle. A round is three written tables. The last FEW edges are finished in one task."""
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    now = written(ends.filter("a <> b").distinct(), "edges")
    whole, turn = None, 0
    kind = now.schema["a"].dataType.simpleString()
    while True:
        turn += 1
        few = now.count() <= FEW
        if few:
            moved = now.repartition(1).mapInPandas(_finished, f"node {kind}, to {kind}")
        else:
            order = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731
            both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select("b", "a"))
            least = both.groupBy("node").agg(F.min(F.struct(order("other").alias("order"), "other")).alias("x"))
            point = written(least.select("node", F.when(F.col("x.order") < order("node"), F.col("x.other")).otherwise(F.col("node")).alias("to")), "pointers")
            further = point.select(F.col("node").alias("to"), F.col("to").alias("further"))
            moved = point.join(further, "to").select("node", F.col("further").alias("to"))
        moved = written(moved, "moved")
        if whole is None:
            whole = moved.withColumnRenamed("to", "label")
        else:
            whole = written(whole.join(moved.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if few:
            first = whole.groupBy("label").agg(F.min("node").alias("first"))
            return written(whole.join(first, "label").select("node", F.col("first").alias("label")), "labels")
        ended = now.join(moved.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(moved.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        now = written(ended.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
