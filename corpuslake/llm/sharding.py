"""Permutation-filled lookup table: every shard has its own order of the slots of a prime-sized table and the
shards take turns in claiming their next free slot. Placement is one hash and one lookup in the broadcast table.

Defined results. The placement depends on the key's text alone: equal keys share a shard, a null key counts as
the empty text. Input columns named like the results stay as `<name>_input`. Adding or removing a shard moves few keys. The table has `slots` rows whatever the data, so the
broadcast is bounded; placing needs no shuffle, so a key that holds a third of the rows stays where it is.
Main path: SQL functions only; the table is filled on the driver in `slots` constant-time steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.shared import set_aside

SLOTS = 10007  # a prime, over a hundred slots for each shard
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    at = [_number(s + "/offset") % slots for s in shards]
    step = [_number(s + "/skip") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots).cast("long")).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table as a DataFrame of `slots` rows."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",")
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    rows = spark.range(0, 1, 1, 1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select("slot", F.get(names, F.col("owner").cast("int")).alias("shard"))


def place(df: DataFrame, key: Column, shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_as: str = "slot", shard_as: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row."""
    table = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias("__of"), F.col("shard").alias("__shard"))
    keyed, _ = set_aside(df.withColumn("__slot", slot_of(key, slots)), (slot_as, shard_as))
    joined = keyed.join(F.broadcast(table), F.col("__slot") == F.col("__of"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in keyed.columns[:-1]], F.col("__slot").alias(slot_as), F.col("__shard").alias(shard_as))


def balance(placed: DataFrame, shard: str = "shard") -> DataFrame:
    """Rows by shard; counted before the shuffle, so it moves one row for each task and shard."""
    return placed.groupBy(shard).agg(F.count(F.lit(1)).alias("n_rows"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, F.col("doc_id")).select("doc_id", "slot", "shard")


def op10_sql() -> str:
    owners = ",".join(map(str, fill_table(SHARDS)))
    return f"""
WITH o AS (SELECT string_split('{owners}', ',') AS owners),
s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owners[slot + 1], 3, '0') AS shard FROM s, o
"""
