"""MinHash near-dedup by an LSH forest: several sorted signature orders, whose longest-common-prefix neighbours are
the candidates, with a depth that adapts to the region; every link is confirmed on the full shingle sets.

1. Sketch. One pass gives each text its set size, a digest of the set and a signature of TREES x DEPTH minima, of each
   16 bits of its hash, so that unrelated texts of any length agree in a minimum by chance only.
   Texts with equal sets collapse into one node, whatever their number.
2. Orders. Tree t sorts the nodes by their minima from the t-th group on, all groups in turn. Nodes that share BASE or
   more at the start form a region. In a region each node is a candidate with its NEIGHBOURS in the order and with the
   first node of each deeper region it lies in (adaptive depth: the order goes on through all minima, so in a region of
   any size those that share most stand together). Candidates whose sizes allow a link and whose signatures agree enough
   are kept if they connect what the region has not connected yet: at most one for each node and tree.
3. Confirmation. Candidates are dealt in buckets of bounded set weight, a hub's by both ends; a bucket reads each set once
   and confirms links on the sets, best first, skipping pairs that are already connected.
4. The rest. Where a component of candidates is still several classes, a node can only have a link to another class if
   one of the rarest fifth of its shingles is among those of that class: two sets at 0.8 or more share one of those under
   any order of the shingles. Such nodes outside the largest class are compared with all such nodes on the full sets, in
   blocks of bounded size; only links that join classes come out. No link inside a component is lost, and a family of
   texts that a template makes alike, but less than 0.8, costs no comparisons.
5. Components of the confirmed links give the classes.

Two texts at similarity 0.8 miss all TREES regions with probability (1 - 0.8^3)^20 = 6e-7 and fall below the signature
test with 2e-5. In a region that holds over NEIGHBOURS other texts between them (a boilerplate that thousands share), a
tree finds them if a minimum that only they share comes before one in which they differ, about three times in five; all
trees fail with some 1e-6. Then, or where range partitions part them in every tree, they are only found by step 4, if
other candidates connect them. Links are never accepted without the full sets.

Defined results. Words are split at space and \\x09-\\x0D with A-Z lower-cased; null or empty texts have no set, are
linked with nothing and are kept. Fewer words than a shingle are one shingle, which equals only the same words.
Rows that share an id count as one document. A null id never names a class unless the whole class has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm.components import components
from corpuslake.llm.shared import byte_column, small, written
from corpuslake.llm.shingles import Permutations, mix, shingle_set, words_by_text

TREES, DEPTH, BASE = 20, 6, 3
AGREE = 0.65  # least share of equal minima for a pair that is tried on its sets
GROUP_SHINGLES = 1_000_000  # set elements that one confirming bucket reads
BLOCK_SHINGLES = 1_000_000  # set elements on either side of a block of step 4
NEIGHBOURS = 32

SKETCH = "text_hash long, n_shingles long, node binary, signature binary"


def _sketch(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = Permutations(TREES * DEPTH)
        for batch in batches:
            n = batch.num_rows
            counts, nodes, signatures = np.zeros(n, np.int64), [None] * n, [None] * n
            for row, words in words_by_text(*byte_column(batch.column(2))):
                if len(words):
                    shingles = shingle_set(words, size)
                    counts[row] = len(shingles)
                    nodes[row] = _digest(shingles)
                    signatures[row] = _sixteen(maps.signature(shingles)).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())], names=["id", "text_hash", "n_shingles", "node", "signature"])

    return sketch


def _sixteen(minima: np.ndarray) -> np.ndarray:
    """16 bits of a hash of each whole minimum: the minimum of many hashes is small, so its own bits say little."""
    with np.errstate(over="ignore"):
        x = (minima ^ (minima >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (x >> np.uint32(16)).astype(np.uint16)


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits of a sorted set."""
    n = np.uint64(len(shingles))
    with np.errstate(over="ignore"):
        one = mix(shingles * np.uint64(0xD6E8FEB86659FD93) + n).sum()
        two = mix(shingles ^ (n * np.uint64(0xA0761D6478BD642F))).sum()
    return np.array([one, two], np.uint64).tobytes()


def _region_candidates(percent: int):
    """Rows sorted by (region, rotated signature): candidates with the rows before and with the first row of each depth's
    region. Held: the last rows, the pivots, and which of the region's rows are connected."""
    width = TREES * DEPTH
    pivots = DEPTH - BASE + 1

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((NEIGHBOURS + pivots, width), np.uint16)  # a ring of the last rows, then the pivots
        names: list = [None] * len(held)
        sizes = np.zeros(len(held), np.int64)
        parent: dict = {}
        region, last, at = None, None, 0

        def root(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for batch in batches:
            out = ([], [], [], [], [])
            for key, node, size, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                signature = np.frombuffer(raw, np.uint16)
                common = 0
                if key != region:
                    region, parent, at = key, {}, 0
                    names = [None] * len(held)
                else:
                    common = int(np.argmin(np.append(signature[:DEPTH] == last[:DEPTH], False)))
                last = signature
                for i in range(pivots):
                    if common < BASE + i:
                        held[NEIGHBOURS + i], names[NEIGHBOURS + i] = signature, None
                parent.setdefault(node, node)
                if at:
                    share = (held == signature).mean(axis=1)
                    share[100 * np.minimum(sizes, size) < percent * np.maximum(sizes, size)] = 0  # no link at these sizes
                    for i in np.argsort(-share, kind="stable").tolist():
                        if share[i] < AGREE:
                            break
                        other = names[i]
                        if other is not None and other != node:
                            x, y = root(node), root(other)
                            if x != y:
                                parent[x] = y
                                low = node < other
                                for column, value in zip(out, ((node, other) if low else (other, node)) + ((size, int(sizes[i])) if low else (int(sizes[i]), size)) + (float(share[i]),)):
                                    column.append(value)
                for i in range(pivots):
                    if common < BASE + i:
                        names[NEIGHBOURS + i], sizes[NEIGHBOURS + i] = node, size
                held[at % NEIGHBOURS], names[at % NEIGHBOURS], sizes[at % NEIGHBOURS] = signature, node, size
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "na", "nb", "agree"])

    return candidates


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None] * batch.num_rows
            for row, words in words_by_text(*byte_column(batch.column(1))):
                out[row] = shingle_set(words, size).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    return sets


def _confirm(percent: int):
    def confirm(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        names = nodes["node"].tolist()
        sets = [np.frombuffer(s, np.uint64) for s in nodes["shingles"]]
        number = {n: i for i, n in enumerate(names)}
        parent = list(range(len(names)))

        def root(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        sizes = np.array([len(s) for s in sets])
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        mine = [place[e - n : e] for e, n in zip(ends, sizes)]
        marked = np.zeros(int(place.max(initial=-1)) + 1, bool)
        edges = edges.assign(x=edges["a"].map(number), y=edges["b"].map(number)).sort_values(["agree", "a", "b"], ascending=[False, True, True])
        for x, others in edges.groupby("x", sort=False)["y"]:
            open_ = [y for y in others.tolist() if root(x) != root(y)]
            for i in range(0, len(open_), 64):
                some = [y for y in open_[i : i + 64] if root(x) != root(y)]
                if some:
                    marked[mine[x]] = True
                    both = np.add.reduceat(marked[np.concatenate([mine[y] for y in some])], np.cumsum([0] + [sizes[y] for y in some[:-1]]), dtype=np.int64)
                    marked[mine[x]] = False
                    for y, n in zip(some, both.tolist()):
                        if 100 * n >= percent * (sizes[x] + sizes[y] - n):
                            parent[root(y)] = root(x)
        # each class as a star around its least node, so that classes of several buckets join in few rounds
        least: dict = {}
        for i, n in enumerate(names):
            r = root(i)
            least[r] = min(n, least.get(r, n))
        return pd.DataFrame([(least[root(i)], n) for i, n in enumerate(names) if least[root(i)] != n], columns=["a", "b"])

    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The links among pairs (a, b, na, nb, agree), as stars. A bucket holds the pairs of some of the `a`; an `a` whose
    partners alone outweigh a bucket is dealt over several by its partner too."""
    heavy = pairs.groupBy("a").agg(F.sum("nb").alias("load")).filter(F.col("load") > GROUP_SHINGLES).select("a", F.ceil(F.col("load") / GROUP_SHINGLES).alias("parts"))
    buckets = pairs.agg(F.ceil(F.sum(F.col("na") + F.col("nb")) / (2 * GROUP_SHINGLES)).alias("n")).first()["n"] or 1
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    dealt = pairs.join(heavy, "a", "left").select(F.pmod(F.xxhash64("a", part), F.lit(int(buckets))).alias("at"), "a", "b", "agree")
    dealt = written(dealt, f"{name}-dealt")
    seats = dealt.select(F.col("at").alias("bucket"), F.col("a").alias("node")).union(dealt.select("at", "b")).distinct()
    seated = seats.join(sets, "node").select("bucket", "node", "shingles")
    return written(seated.groupBy("bucket").cogroup(dealt.groupBy("at")).applyInPandas(_confirm(percent), "a binary, b binary"), f"{name}-links")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, group, node, size, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
            shingles = np.frombuffer(raw, np.int64)
            for i in range(0, len(shingles), 1 << 16):
                part = shingles[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(part), t) for v, t in ((label, pa.binary()), (group, pa.binary()), (node, pa.binary()), (size, pa.int64()))] + [pa.array(part)], names=["label", "class", "node", "n", "shingle"])


def _live(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(label, class, main, node, n_shingles) of the nodes that can have a link to another class of their component: of
    n shingles, one of the n - ceil(percent % of n) + 1 that are rarest in the component is among another class's too."""
    sizes = named.groupBy("label", "class").agg(F.count(F.lit(1)).alias("members"))
    open_ = sizes.groupBy("label").agg(F.max_by("class", F.struct("members", "class")).alias("main"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("label", "main")
    inside = written(named.join(open_, "label").select("label", "class", "main", "node", "n_shingles"), "near-open")
    with_sets = inside.select("label", "class", "node", "n_shingles").join(sets, "node").select("label", "class", "node", "n_shingles", "shingles")
    each = written(with_sets.mapInArrow(_exploded, "label binary, class binary, node binary, n long, shingle long"), "near-shingles")
    often = each.groupBy("label", "shingle").agg(F.count(F.lit(1)).alias("often"))
    w = Window.partitionBy("node").orderBy("often", "shingle")
    rare = each.join(often, ["label", "shingle"]).withColumn("rn", F.row_number().over(w))
    rare = rare.filter((F.col("often") > 1) & (F.col("rn") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    rare = written(rare.select("label", "shingle", "class", "node"), "near-rare")
    shared = rare.groupBy("label", "shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("label", "shingle")
    return written(inside.join(rare.join(shared, ["label", "shingle"], "left_semi").select("node").distinct(), "node", "left_semi"), "near-live")


def _rest(percent: int):
    """A block: nodes outside the largest class against members on the full sets; links that join classes."""

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        members, outs = pdf[pdf["member"]], pdf[~pdf["member"]]
        found: list[tuple] = []
        if len(members) and len(outs):
            sets = [np.frombuffer(s, np.uint64) for s in members["shingles"]]
            names, of = members["node"].tolist(), members["class"].tolist()
            sizes = np.array([len(s) for s in sets])
            values = np.concatenate(sets)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
            parent: dict = {}

            def root(c):
                parent.setdefault(c, c)
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            for node, own, raw in zip(outs["node"], outs["class"], outs["shingles"]):
                mine = np.frombuffer(raw, np.uint64)
                lo, hi = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
                n = hi - lo
                ends = np.cumsum(n)
                if not ends[-1]:
                    continue
                both = np.bincount(owner[np.arange(ends[-1]) + np.repeat(hi - ends, n)], minlength=len(sets))
                for i in np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both)):
                    x, y = root(own), root(of[i])
                    if x != y:
                        parent[x] = y
                        found.append((min(node, names[i]), max(node, names[i])))
        return pd.DataFrame(found, columns=["a", "b"])

    return rest


def _more(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different classes of a component: its live nodes outside the largest class meet its live nodes, in
    blocks of bounded weight on either side."""
    live = _live(named, sets, percent)
    outside = F.col("class") != F.col("main")
    count = lambda c: F.greatest(F.ceil(c / BLOCK_SHINGLES), F.lit(1)).cast("int")
    blocks = live.groupBy("label").agg(F.sum("n_shingles").alias("all"), F.sum(F.when(outside, F.col("n_shingles"))).alias("out")).filter("out > 0").select("label", count(F.col("all")).alias("mb"), count(F.col("out")).alias("ob"))
    mixed = live.join(blocks, "label").join(sets, "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    member = mixed.select("label", place("mb").alias("m"), spread("ob").alias("o"), F.lit(True).alias("member"), "node", "class", "shingles")
    outer = mixed.filter(outside).select("label", spread("mb").alias("m"), place("ob").alias("o"), F.lit(False).alias("member"), "node", "class", "shingles")
    return written(member.unionByName(outer).groupBy("label", "m", "o").applyInPandas(_rest(percent), "a binary, b binary"), "near-more")


def _labels(candidates: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label): the classes of what links on the full sets connect, for nodes with a link."""
    region = components(candidates)
    used = region.join(nodes, "node").select("node", "label", "id", "text_hash", "n_shingles")
    wanted = used.select("node", F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("node", "text")
    sets = written(texts.mapInArrow(_sets(size), "node binary, shingles binary"), "near-sets").dropDuplicates(["node"])

    first = _confirmed(candidates, sets, percent, "near")
    classes_of_first = components(first)
    joined = classes_of_first.withColumnRenamed("label", "class")
    named = written(used.select("node", "label", "n_shingles").join(joined, "node", "left").withColumn("class", F.coalesce("class", "node")), "near-named")
    more = _more(named, sets, percent)
    return components(first.union(more)) if more.limit(1).count() else classes_of_first


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (least id of its class)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    sketches = written(texts.mapInArrow(_sketch(shingle), f"id {id_type}, {SKETCH}"), "near-sketches")

    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash", "n_shingles", "signature")).alias("one")
    nodes = sketches.filter(F.col("node").isNotNull()).groupBy("node").agg(first)
    nodes = written(nodes.select("node", "one.id", "one.text_hash", "one.n_shingles", "one.signature"), "near-nodes")

    prefix = lambda t: F.xxhash64(t, F.substring("signature", t * (2 * DEPTH) + 1, 2 * BASE))
    light = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), prefix)).alias("tree", "region"))
    shared = light.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(light.join(shared, "region"), "near-members")
    rows = members.join(nodes.select("node", "n_shingles", "signature"), "node")

    turned = F.concat(F.expr(f"substring(signature, tree * {2 * DEPTH} + 1)"), F.expr(f"substring(signature, 1, tree * {2 * DEPTH})"))
    order = rows.select("region", "node", "n_shingles", turned.alias("turned")).repartitionByRange("region", "turned", "node").sortWithinPartitions("region", "turned", "node")
    found = order.mapInArrow(_region_candidates(percent), "a binary, b binary, na long, nb long, agree double")
    candidates = written(found.groupBy("a", "b", "na", "nb").agg(F.max("agree").alias("agree")), "near-candidates")
    label = _labels(candidates, nodes, texts, shingle, percent)
    ids = nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "id")
    classed = ids.join(ids.groupBy("label").agg(F.min("id").alias("component_id")), "label").select("node", "component_id")
    out = sketches.select("id", "text_hash", "n_shingles", "node").join(classed, "node", "left")
    return out.select("id", "text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that name their class, with the columns they came with: one document of each class stays."""
    gone = classes(docs, doc_id, text, shingle, percent).filter(~F.col("id").eqNullSafe(F.col("component_id")))
    gone = small(gone.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "near-gone")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__hash")), "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(doc_id, r) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
), c AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
