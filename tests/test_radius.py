import numpy as np
from pyspark.sql import functions as F

from corpuslake.operators import radius

SCHEMA = "doc_id long, at long, embedding array<float>"


def _rows(n=260, width=12, seed=5):
    """Clusters, exact copies in a crowd, scaled copies, a zero vector, missing ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    x = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, width)) * rng.choice([0.02, 0.15, 0.5], size=(n, 1))
    x[50:90] = x[50]
    x[90:100] = x[90] * np.arange(1, 11)[:, None]
    rows = [(i, i % 3, [float(v) for v in x[i]]) for i in range(n)]
    return rows + [(n, 0, [0.0] * width), (n + 1, 0, [0.0] * width), (n + 2, 0, None), (n + 3, 1, []), (n + 4, 1, [1.0, None] + [0.0] * (width - 2)), (None, 1, rows[0][2])]


def _plain(rows, least):
    """query -> (nearest earlier row, similarity), by comparing all."""
    usable = [(k, at, np.asarray(v, np.float32).astype(float)) for k, at, v in rows if k is not None and v and None not in v]
    x = np.array([v for _, _, v in usable])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    near, out = np.round(x @ x.T, 6), {}
    for i, (k, at, _) in enumerate(usable):
        met = [(-near[i, j], usable[j][0]) for j in range(len(usable)) if (usable[j][1], usable[j][0]) < (at, k) and near[i, j] >= least]
        out[k] = (min(met)[1], -min(met)[0]) if met else (None, None)
    return out


def test_radius_join_equals_all_pairs(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (1, 16):
        pivots = radius.fit_pivots(df, most=most)
        every = radius.placed(df, pivots, "at")
        for least in (0.95, 0.7, 1.0):
            got = radius.repeats(every, every, pivots, least).collect()
            plain = _plain(rows, least)
            assert len(got) == len(plain)
            assert {r.query_id: (r.doc_id, r.similarity) for r in got} == plain, (most, least)
            if most == 16 and least == 0.95:
                assert sum(r.compared for r in got) < 0.5 * len(got) ** 2


def test_blocks_split_a_crowd(spark, monkeypatch):
    """Every row is a copy of one vector: one list, many blocks, one row a query."""
    monkeypatch.setattr(radius, "BLOCK", 16)
    df = spark.createDataFrame([(i, 0, [1.0, 2.0, 3.0]) for i in range(100)], SCHEMA)
    pivots = radius.fit_pivots(df)
    every = radius.placed(df, pivots, "at")
    got = {r.query_id: r.doc_id for r in radius.repeats(every, every, pivots).collect()}
    assert got == {i: 0 if i else None for i in range(100)}


def test_empty_tables_and_string_keys(spark):
    df = spark.createDataFrame(_rows(110), SCHEMA).withColumn("doc_id", F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    pivots, none = radius.fit_pivots(df), radius.fit_pivots(df.limit(0))
    every, empty = radius.placed(df, pivots, "at"), radius.placed(df.limit(0), pivots, "at")
    assert {r.doc_id for r in radius.repeats(every, empty, pivots).collect()} == {None}
    assert radius.repeats(empty, every, pivots).count() == 0
    unlisted = radius.placed(df, none, "at")
    key = lambda rows: {(r.query_id, r.doc_id, r.similarity) for r in rows.collect()}
    assert key(radius.repeats(unlisted, unlisted, none)) == key(radius.repeats(every, every, pivots))


def test_store_judges_batches_as_one_job_and_bears_repeats(spark, tmp_path):
    rows = _rows(120)
    df = spark.createDataFrame(rows, SCHEMA)
    store = radius.RepeatStore(spark, str(tmp_path / "store"), radius.fit_pivots(df))
    for batch in (0, 1, 2, 1, 0):  # the last two come again
        store.add(df.filter(F.col("at") == batch), batch)
    assert {r.query_id: (r.doc_id, r.similarity) for r in store.judged().collect()} == _plain(rows, 0.95)


def test_a_query_goes_once_to_a_block_of_lists(spark, monkeypatch):
    """Noise leaves nearly all lists open; a query is copied by blocks, not by lists."""
    met, real = spark.sparkContext.accumulator(0), radius._block_nearest

    def counted(*args):
        judged = real(*args)

        def count(batches):
            for batch in judged(batches):
                met.add(batch.num_rows)
                yield batch

        return count

    monkeypatch.setattr(radius, "_block_nearest", counted)
    x = np.random.default_rng(11).normal(size=(2000, 24))
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    pivots = radius.fit_pivots(df)
    every = radius.placed(df, pivots, "at")
    assert len(pivots) > 40 and radius.repeats(every, every, pivots).count() == 2000
    assert met.value <= 12 * 2000
