"""Keyed Parquet tables in buckets: an upsert or a delete writes the buckets it touches anew and then a new pointer."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Out = TypeVar("Out")
ATTEMPTS, PAUSE = 3, 0.5


def retried(work: Callable[[], Out], attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Out:
    """The work's result; a failure is tried again after pause, 2 * pause, ... seconds, the last one is raised."""
    for i in range(attempts):
        try:
            return work()
        except Exception:  # noqa: BLE001  whatever failed, the last attempt raises it
            if i == attempts - 1:
                raise
            sleep(pause * 2**i)
    raise ValueError("attempts must be positive")


class VersionedTable:
    """A table with a key under a folder of the cluster's file system.

    Rows lie in buckets by a hash of their key. Each change writes its buckets into a folder of its own and then one
    small pointer file, which names the folder of every bucket. The pointer is written under another name and renamed,
    so readers see a whole version or the one before. Two writers at once must be kept apart by the caller, but where the
    file system refuses to rename onto a file (HDFS does), the second one raises. The number of buckets is fixed when the
    table is first written. cut: a pattern that is taken off keys before they are hashed, so that keys of one group (the
    chunks of an essay) share a bucket. spread: tasks that write a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64, cut: str | None = None, spread: int = 1):
        self.spark, self.path, self.key, self.buckets, self.cut, self.spread = spark, path.rstrip("/"), key, buckets, cut, spread

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs("pointers")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "_")

    def version(self) -> int:
        """The current version, 0 where nothing has been written."""
        return max(self.versions(), default=0)

    def pointer(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"buckets": {}, "meta": {}, "schema": None, "of": self.buckets}
        text = self.spark.read.text(f"{self.path}/pointers/{v:012d}.json", wholetext=True).first()["value"]
        return json.loads(text)

    def meta(self) -> dict:
        """What was said beside the rows when they were last written."""
        return self.pointer()["meta"]

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows (of some buckets); None where nothing has been written."""
        at = self.pointer(version)
        if at["schema"] is None:
            return None
        schema = T.StructType.fromJson(json.loads(at["schema"]))
        places = [f"{self.path}/{folder}/bucket={b}" for b, folder in at["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _bucket(self, of: int) -> Column:
        group = F.col(self.key).cast("string")
        return F.pmod(F.xxhash64(group if self.cut is None else F.regexp_replace(group, self.cut, "")), F.lit(of)).cast("int")

    def _commit(self, at: dict, rows: DataFrame | None, touched: list[int], meta: dict | None) -> int:
        v = self.version() + 1
        folder = f"v{v:012d}-{uuid.uuid4().hex[:8]}"
        buckets = {b: f for b, f in at["buckets"].items() if int(b) not in touched}
        schema = at["schema"]
        if rows is not None:
            schema = json.dumps(rows.schema.jsonValue())
            rows.withColumn("bucket", self._bucket(at["of"])).repartition(max(1, len(touched) * self.spread), "bucket", F.pmod(F.xxhash64(self.key), F.lit(self.spread))).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            fs, where = self._fs(folder)
            names = [f.getPath().getName() for f in fs.listStatus(where)]
            buckets |= {n.split("=")[1]: folder for n in names if n.startswith("bucket=")}
        fs, draft = self._fs(f"pointers/_{uuid.uuid4().hex}")
        _, final = self._fs(f"pointers/{v:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"of": at["of"], "buckets": buckets, "schema": schema, "meta": at["meta"] if meta is None else meta}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {v} of {self.path} was written by someone else")
        return v

    def _touched(self, ids: DataFrame, of: int) -> list[int]:
        return sorted(r[0] for r in ids.select(self._bucket(of)).distinct().collect())  # as many as there are buckets

    def replace(self, rows: DataFrame, meta: dict | None = None) -> int:
        at = self.pointer()
        return self._commit(at, rows, list(range(at["of"])), meta)

    def describe(self, meta: dict) -> int:
        """Change what is said beside the rows, and no rows."""
        return self._commit(self.pointer(), None, [], meta)

    def upsert(self, rows: DataFrame, order: Column | None = None, meta: dict | None = None) -> int:
        """Rows take the place of those with their ids; repeating an upsert changes nothing.

        Of several rows of one id the last one by `order` stays; without an order, or where it ties, the one with the
        largest hash, so that the choice doesn't hang on partitions.
        """
        at = self.pointer()
        last = Window.partitionBy(self.key).orderBy(*([order.desc()] if order is not None else []), F.xxhash64(*rows.columns).desc())
        rows = rows.withColumn("__last", F.row_number().over(last)).where("__last = 1").drop("__last")
        touched = self._touched(rows, at["of"])
        if not touched:
            return self.describe(meta) if meta is not None else self.version()
        old = self.read(only=touched)
        return self._commit(at, rows if old is None else old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows), touched, meta)

    def delete(self, ids: DataFrame, meta: dict | None = None) -> int:
        at = self.pointer()
        touched = [b for b in self._touched(ids, at["of"]) if str(b) in at["buckets"]]
        if at["schema"] is None or not touched:
            return self.describe(meta) if meta is not None else self.version()
        return self._commit(at, self.read(only=touched).join(ids.select(self.key), self.key, "left_anti"), touched, meta)

    def fetch(self, ids: DataFrame) -> DataFrame:
        """`ids` with their rows, nulls where there are none; reads their buckets only."""
        at = self.pointer()
        old = self.read(only=self._touched(ids, at["of"])) if at["schema"] else None
        return ids if old is None else ids.select(self.key).join(old, self.key, "left")

    def beside(self, ids: DataFrame) -> DataFrame | None:
        """All rows that may be of the groups of `ids`: those of their buckets, or the whole table where keys have no groups."""
        return self.read(only=None if self.cut is None else self._touched(ids, self.pointer()["of"]))

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that the last `keep` versions don't name, and the other pointers; how many folders went.

        Only for when no reader is on an older version and no writer is at work.
        """
        versions = self.versions()
        named = {f for v in versions[-keep:] for f in self.pointer(v)["buckets"].values()}
        fs, root = self._fs("")
        gone = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("v") and f.getPath().getName() not in named]
        for where in gone:
            fs.delete(where, True)
        for v in versions[:-keep]:
            fs.delete(self._fs(f"pointers/{v:012d}.json")[1], False)
        return len(gone)


def read_manifest(remote: DataFrame | None, local: str | None, defaults: dict) -> dict:
    """A one-row manifest: the remote record's payload, else the local JSON, else defaults; missing keys are filled in."""
    texts = [r["payload"] for r in remote.limit(1).select("payload").collect()] if remote is not None else []
    for raw in [*texts, local]:
        try:
            got = json.loads(raw) if raw else None
        except ValueError:
            continue
        if isinstance(got, dict):
            return {**defaults, **got}
    return dict(defaults)


def appended(table: VersionedTable, rows: DataFrame) -> int:
    """New messages or conversations, whose ids must not exist yet."""
    old = table.read(only=table._touched(rows, table.pointer()["of"]))
    if rows.groupBy(table.key).count().where("count > 1").limit(1).count() or old is not None and old.join(rows.select(table.key), table.key, "left_semi").limit(1).count():
        raise ValueError("ids exist already")
    return table.upsert(rows)


def migrated(spark: SparkSession, statements: dict[str, list[str]], applied: VersionedTable, now: str) -> list[str]:
    """Run the named lists of SQL statements that haven't been, in the order of their names; what has been run.

    applied: a table with the key name, where each is noted (name, applied_at) as soon as it is through, so that a run
    that fails goes on where it stopped.
    """
    old = applied.read()
    done = {r["name"] for r in old.select("name").collect()} if old is not None else set()
    fresh = [name for name in sorted(statements) if name not in done]
    for name in fresh:
        for statement in statements[name]:
            spark.sql(statement)
        applied.upsert(spark.createDataFrame([(name, now)], "name string, applied_at string"))
    return fresh
