"""Keyed tables against a dictionary, and what a write costs, what a reader sees, what a repeat changes."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslake.sources.keyed import KeyedTable

SCHEMA = "k long, g string, v string"


def rows_of(table, version=None):
    return sorted(map(repr, map(tuple, table.read(version).collect())))


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rnd = random.Random(2)
    made = {k: [(k, "g", f"v{k}")] for k in [*range(40), None]}
    table = KeyedTable.create(spark.createDataFrame([r for rs in made.values() for r in rs], SCHEMA), str(tmp_path / "t"), "k", buckets=5)
    snapshots = []
    for step in range(7):
        if step % 3 == 2:
            gone = rnd.sample(range(60), 6) + [None] * (step == 5)
            table.delete(spark.createDataFrame([(k,) for k in gone], "k long"))
            for k in gone:
                made.pop(k, None)
        else:
            new = {k: [(k, f"s{step}", f"w{i}") for i in range(rnd.randint(1, 3))] for k in [*rnd.sample(range(60), 7), *([None] if step == 1 else [])]}
            table.upsert(spark.createDataFrame([r for rs in new.values() for r in rs], SCHEMA))
            made.update(new)
        if step == 4:
            table.compact()
        snapshots.append((table.manifest()["version"], sorted(repr(r) for rs in made.values() for r in rs)))
        assert rows_of(table) == snapshots[-1][1]
    for version, want in snapshots:  # older snapshots stay readable
        assert rows_of(table, version) == want
    some = spark.createDataFrame([(3,), (None,), (999,)], "k long")
    assert sorted(map(repr, map(tuple, table.lookup(some).collect()))) == sorted(repr(r) for k in (3, None) for r in made.get(k, []))


def test_a_write_costs_what_it_changes(spark, tmp_path):
    rows = spark.range(200_000).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table = KeyedTable.create(rows, str(tmp_path / "t"), "k", buckets=8)
    version = table.upsert(rows.filter("k % 100 = 0").withColumn("g", F.lit("new")))
    assert table.bytes_of(version) < 0.03 * table.bytes_of(0)
    assert table.read().groupBy("g").count().collect() and {r["g"]: r["count"] for r in table.read().groupBy("g").count().collect()} == {"g": 198_000, "new": 2000}
    first = table.manifest()["base"]
    one = table.upsert(rows.filter("k = 5").withColumn("g", F.lit("one")))
    assert table.compact(share=0.5) == [] and len(table.compact(share=1e-9)) == 8 and one < table.manifest()["version"]
    assert table.manifest()["deltas"] == [] and table.manifest()["base"] != first


def test_compaction_leaves_other_buckets_alone(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.lit("v").alias("v"))
    table = KeyedTable.create(rows, str(tmp_path / "t"), "k", buckets=16)
    before = table.manifest()["base"]
    table.upsert(rows.filter("k = 5"))
    (bucket,) = table.compact()
    after = table.manifest()["base"]
    assert [b for b in before if before[b] != after[b]] == [str(bucket)]
    assert table.read().count() == 1000


def test_repeated_batches_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    table = KeyedTable.create(rows, str(tmp_path / "t"), "k", buckets=2)
    one = table.upsert(spark.createDataFrame([(1, "b", "y"), (2, "b", "y")], SCHEMA), batch=("feed", 0))
    files = table.folder.names("files")
    assert table.upsert(spark.createDataFrame([(1, "c", "z")], SCHEMA), batch=("feed", 0)) == one and table.folder.names("files") == files
    assert table.upsert(spark.createDataFrame([(2, "c", "z")], SCHEMA), batch=("other", 0)) == one + 1
    assert rows_of(table) == ["(1, 'b', 'y')", "(2, 'c', 'z')"]


def test_a_second_writer_takes_the_next_version(spark, tmp_path):
    """Another writer commits between this one's look and its rename."""
    table = KeyedTable.create(spark.createDataFrame([(1, "a", "x")], SCHEMA), str(tmp_path / "t"), "k", buckets=2)
    other, publish, calls = KeyedTable(spark, str(tmp_path / "t")), table.folder.publish, []

    def late(name, text):
        if not calls:
            calls.append(other.upsert(spark.createDataFrame([(2, "b", "y")], SCHEMA)))
        return publish(name, text)

    table.folder.publish = late
    assert (table.upsert(spark.createDataFrame([(1, "c", "z")], SCHEMA)), calls) == (2, [1])
    assert rows_of(table) == ["(1, 'c', 'z')", "(2, 'b', 'y')"]


def test_a_failed_write_leaves_the_snapshot(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([(1, "a", "x")], SCHEMA), str(tmp_path / "t"), "k", buckets=2)
    broken = spark.range(3).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.raise_error(F.lit("lost")).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert table.manifest()["version"] == 0 and rows_of(table) == ["(1, 'a', 'x')"]
    table.upsert(spark.createDataFrame([(1, "b", "y")], SCHEMA))
    table.compact()
    dropped = table.vacuum(keep=1, hours=0)
    assert dropped and rows_of(table) == ["(1, 'b', 'y')"] and len(table.versions()) == 1


def test_unique_keys_and_odd_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (None, "c", None), (None, "a", "z")], SCHEMA)
    table = KeyedTable.create(rows, str(tmp_path / "t"), "k", buckets=2, unique=True, order="g")
    assert rows_of(table) == ["(1, 'b', 'y')", "(None, 'c', None)"]
    table.upsert(rows.limit(0))
    table.delete(spark.createDataFrame([(77,)], "k long"))
    table.replace(spark.createDataFrame([(1, "z", "z")], SCHEMA), spark.createDataFrame([(1,), (None,)], "k long"))
    assert rows_of(table) == ["(1, 'z', 'z')"]
    with pytest.raises(ValueError):
        KeyedTable.create(rows, str(tmp_path / "t"), "k")
    assert KeyedTable.create(rows.limit(0), str(tmp_path / "e"), ["k", "g"], buckets=2).read().collect() == []


def test_untouched_buckets_are_not_joined(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.lit("v").alias("v"))
    table = KeyedTable.create(rows, str(tmp_path / "t"), "k", buckets=16)
    table.upsert(rows.filter("k = 5"))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "__bucket" in plan and "PartitionFilters: [" in plan
