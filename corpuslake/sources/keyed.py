"""Keyed tables that take changes without being rewritten (S4, M1, M2, J13, R6): merge on read.

A table is a folder. `files/<id>` hold Parquet rows: a base, partitioned by bucket of the key, and deltas, sorted by bucket.
`manifest/<version>.json` name the files of a snapshot and the sequence number of each. A delta's rows of a key take the place of all
older rows of that key; a tombstone takes their place with nothing. So a write costs what it changes, whatever the table
holds, and a key may have several rows (a file's chunks).

* Snapshots. A reader takes the greatest manifest and only the files it names. A writer writes files first and then
  renames a manifest to the next version, which fails if that exists; it then looks again and takes the version after.
* Repeats. A batch is (stream, number); one whose number is not above the stream's last changes nothing.
* Reading. The deltas' keys, with their last sequence number, are anti-joined to the base's rows of touched buckets; other
  buckets pass untouched. Spark broadcasts these keys where they are few and shuffles otherwise.
* Compaction rewrites the buckets that deltas touch, or those where they hold a given share, and no others. A delta all of
  whose buckets are newer leaves the manifest. `vacuum` deletes what old manifests alone name.

Null keys are a key like any other. Rows of a batch that are equal in all columns stay, unless the table is `unique`: then
a key's row of greatest `order` counts, of equal ones any but always the same. Empty changes make a version without rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, DELETED, SEQ = "__bucket", "__deleted", "__seq"


class _Folder:
    """What Spark's readers and writers lack: atomic renames, listings and sizes, by the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        at = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs, self.context = at.getFileSystem(conf), self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """The file appears whole under its name; False if the name is taken."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        plain = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.context.rename(draft, self.path(name), plain)
            return True
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise

    def bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.fs.exists(self.path(name)) else 0

    def age_hours(self, name: str) -> float:
        return (self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self.path(name)).getModificationTime()) / 3.6e6

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, _Folder(spark, path)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str | Sequence[str], buckets: int = 64, unique: bool = False, order: str | None = None) -> KeyedTable:
        """A new table of rows. buckets: about the table's size by that of a comfortable task."""
        table = cls(rows.sparkSession, path)
        empty = {"version": 0, "key": [key] if isinstance(key, str) else list(key), "buckets": buckets, "unique": unique, "order": order, "schema": rows.schema.json(), "base": {}, "deltas": [], "batches": {}}
        name = table._write(table._keyed(rows, empty), "base")
        if not table.folder.publish("manifest/000000000000.json", json.dumps(empty | {"base": {str(b): [name, 0] for b in range(buckets)}})):
            raise ValueError(f"there is a table at {path}")
        return table

    # Snapshots

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.folder.names("manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.folder.text(f"manifest/{self.versions()[-1] if version is None else version:012d}.json"))

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """The next version is what `change` makes of the last one; None leaves it. Looks again when another writer was first."""
        while True:
            now = self.manifest()
            new = change(now)
            if new is None:
                return now["version"]
            new["version"] = now["version"] + 1
            if self.folder.publish(f"manifest/{new['version']:012d}.json", json.dumps(new)):
                return new["version"]

    # Writing

    def _keyed(self, rows: DataFrame, m: dict) -> DataFrame:
        if m["unique"]:
            values = [c for c in rows.columns if c not in m["key"]]
            if values:
                rank = F.struct(*([F.col(f"`{m['order']}`")] if m["order"] else []), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
                one = rows.groupBy(*[f"`{c}`" for c in m["key"]]).agg(F.max_by(F.struct(*[f"`{c}`" for c in values]), rank).alias("__row"))
                rows = one.select(*[f"`{c}`" for c in m["key"]], "__row.*")
            else:
                rows = rows.distinct()
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in m["key"]]), F.lit(m["buckets"])).cast("int"))

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        dealt = rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET)  # splits what is large, also a bucket of one hot key
        writer = dealt.write.option("compression", "zstd")
        (writer.partitionBy(BUCKET) if kind == "base" else writer).parquet(f"{self.folder.root}/files/{name}")
        return name

    def _append(self, rows: DataFrame, batch: tuple[str, int] | None) -> int:
        m = self.manifest()
        seen = lambda now: batch is not None and now["batches"].get(batch[0], -1) >= batch[1]
        if seen(m):
            return m["version"]
        name = self._write(rows, "delta")
        touched = sorted(r[0] for r in self._files(name, m).select(BUCKET).distinct().collect())  # at most `buckets`

        def change(now: dict) -> dict | None:
            if seen(now):
                return None
            delta = {"id": name, "seq": now["version"] + 1, "buckets": touched}
            return now | {"deltas": now["deltas"] + [delta] * bool(touched), "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})}

        return self._commit(change)

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Rows take the place of all rows of their keys; the new version, or the last one if the batch came before."""
        m = self.manifest()
        return self._append(self._keyed(rows, m).withColumn(DELETED, F.lit(False)), batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Rows of these keys go; keys without rows change nothing."""
        m = self.manifest()
        return self._append(self._keyed(keys.select(*[f"`{c}`" for c in m["key"]]).distinct(), m | {"unique": False}).withColumn(DELETED, F.lit(True)), batch)

    def replace(self, rows: DataFrame, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """For all of `keys`, and in one version: their rows are those of `rows`, or none."""
        m = self.manifest()
        new = self._keyed(rows, m).withColumn(DELETED, F.lit(False))
        gone = self._keyed(keys.select(*[f"`{c}`" for c in m["key"]]).distinct(), m | {"unique": False}).withColumn(DELETED, F.lit(True))
        return self._append(_union([new, gone]), batch)

    # Reading

    def _schema(self, m: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(m["schema"]))

    def _files(self, name: str, m: dict) -> DataFrame:
        schema = T.StructType([*self._schema(m).fields, T.StructField(DELETED, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder.root}/files/{name}")

    def _base(self, m: dict, buckets: Sequence[int]) -> DataFrame:
        """The base's rows of some buckets; only their folders are listed in the plan."""
        of: dict[str, list[int]] = {}
        for b in buckets:
            of.setdefault(m["base"][str(b)][0], []).append(b)
        parts = [self._files(name, m).filter(F.col(BUCKET).isin(bs)) for name, bs in of.items()]
        return _union(parts) if parts else self._files(next(iter(m["base"].values()))[0], m).limit(0)

    def _merged(self, m: dict, buckets: Sequence[int]) -> DataFrame:
        """Current rows of these buckets, with their bucket."""
        wanted, parts = set(buckets), []
        for d in m["deltas"]:
            live = [b for b in d["buckets"] if b in wanted and m["base"][str(b)][1] < d["seq"]]
            if live:
                parts.append((live, self._files(d["id"], m).filter(F.col(BUCKET).isin(live)).withColumn(SEQ, F.lit(d["seq"]))))
        touched = sorted({b for live, _ in parts for b in live})
        rest = self._base(m, sorted(wanted - set(touched)))
        if not parts:
            return rest.drop(DELETED)
        delta = _union([p for _, p in parts])
        names = [f"__k{i}" for i in range(len(m["key"]))]
        marks = delta.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(m["key"], names)]).agg(F.max(SEQ).alias("__last"))
        same: Column = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in zip(m["key"], names)])
        old = self._base(m, touched).join(marks, same, "left_anti")
        new = delta.filter(~F.col(DELETED)).join(marks, same & (F.col(SEQ) == F.col("__last")), "left_semi").drop(SEQ)
        return _union([rest, old, new]).drop(DELETED)

    def read(self, version: int | None = None) -> DataFrame:
        """One snapshot, the last by default; later versions do not change it."""
        m = self.manifest(version)
        return self._merged(m, range(m["buckets"])).select(*[F.col(f"`{f.name}`") for f in self._schema(m)])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Current rows of some keys (S5): only their buckets are read."""
        m = self.manifest()
        asked = self._keyed(keys.select(*[f"`{c}`" for c in m["key"]]).distinct(), m | {"unique": False})
        buckets = [r[0] for r in asked.select(BUCKET).distinct().collect()]
        names = [f"__k{i}" for i in range(len(m["key"]))]
        asked = asked.drop(BUCKET).toDF(*names)
        same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in zip(m["key"], names)])
        return self._merged(m, buckets).join(asked, same, "left_semi").select(*[F.col(f"`{f.name}`") for f in self._schema(m)])

    # Upkeep

    def compact(self, share: float = 0.0) -> list[int]:
        """Buckets whose deltas have more than `share` of the base's rows are written anew; which ones."""
        m = self.manifest()
        live = [self._files(d["id"], m).filter(F.col(BUCKET).isin([b for b in d["buckets"] if m["base"][str(b)][1] < d["seq"]])) for d in m["deltas"]]
        if not live:
            return []
        sizes = _union(live).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("d")).collect()
        if share > 0:
            held = {r[0]: r["n"] for r in self._base(m, [r[0] for r in sizes]).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
            buckets = sorted(r[0] for r in sizes if r["d"] > share * held.get(r[0], 0))
        else:
            buckets = sorted(r[0] for r in sizes)
        if not buckets:
            return []
        name = self._write(self._merged(m, buckets), "base")

        def change(now: dict) -> dict | None:
            if any(now["base"][str(b)] != m["base"][str(b)] for b in buckets):
                return None  # another compaction was first; this one's files are left to vacuum
            base = now["base"] | {str(b): [name, m["version"]] for b in buckets}
            return now | {"base": base, "deltas": [d for d in now["deltas"] if any(base[str(b)][1] < d["seq"] for b in d["buckets"])]}

        self._commit(change)
        return buckets

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Manifests but for the last `keep` go, and files that are at least `hours` old which no kept one names."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.folder.drop(f"manifest/{v:012d}.json")
        named = {x for v in versions[-keep:] for m in [self.manifest(v)] for x in [*(b[0] for b in m["base"].values()), *(d["id"] for d in m["deltas"])]}
        old = [n for n in self.folder.names("files") if n not in named and self.folder.age_hours(f"files/{n}") >= hours]
        for n in old:
            self.folder.drop(f"files/{n}")
        return old

    def bytes_of(self, version: int) -> int:
        """Bytes of the files that this version was the first to name."""
        names = lambda m: {*(b[0] for b in m["base"].values()), *(d["id"] for d in m["deltas"])}
        before = names(self.manifest(version - 1)) if version else set()
        return sum(self.folder.bytes(f"files/{n}") for n in names(self.manifest(version)) - before)
