"""Keyed tables that are merged into: buckets of Parquet files and a manifest that is swapped last.

A merge reads and rewrites only the buckets that changed rows fall into; all other buckets keep their files. What is
current is named by the newest manifest, which is created, never overwritten: of two writers of one version the
second fails. A manifest also records the last batch of each stream, so that a batch that is delivered again changes
nothing, and the epoch of the writer, so that a writer that was replaced can no longer commit.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
TASK_ROWS = 500_000  # rows of a bucket that one task writes, about


class Conflict(RuntimeError):
    """Another writer has committed first, or has taken over."""


class Folder:
    """Small files beside tables, through the file system that Spark itself uses for the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._at("")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; ``Conflict`` if there is one of that name."""
        try:
            stream = self.fs.create(self._at(name), False)
        except Exception as e:  # the file system's own class of "already exists"
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"{name} is there already") from e
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def touch(self, name: str) -> None:
        """The time of now, contents as they are."""
        self.fs.setTimes(self._at(name), int(time.time() * 1000), -1)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class BucketStore:
    """A table keyed by ``key`` under ``path``. ``buckets`` is fixed when the store is made; a bucket may
    be larger than a task and is then written as several files."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType | str, buckets: int = 16):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.log = Folder(spark, f"{self.path}/manifests")
        self.buckets = (self.manifest() or {"buckets": buckets})["buckets"]

    def manifest(self) -> dict | None:
        """The newest one that is whole (a writer that died may have left a part of one)."""
        for name in reversed(self.log.names()):
            try:
                return json.loads(self.log.read(name))
            except ValueError:
                continue
        return None

    def _now(self) -> dict:
        return self.manifest() or {"version": 0, "buckets": self.buckets, "files": {}, "done": {}, "epoch": 0}

    def _commit(self, new: dict) -> None:
        last = [n for n in self.log.names() if n.endswith(".json")]
        number = int(last[-1].split(".")[0]) + 1 if last else 1
        # From a manifest that is not the newest whole one, nothing may be committed.
        if self._now()["version"] != new["version"]:
            raise Conflict("another writer has committed")
        self.log.create(f"{number:012d}.json", json.dumps(new | {"version": number}))

    def take_over(self) -> int:
        """A new epoch: commits of writers with an older one fail from here on."""
        now = self._now()
        self._commit(now | {"epoch": now["epoch"] + 1})
        return now["epoch"] + 1

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        files = self._now()["files"]
        paths = [p for b, p in sorted(files.items()) if only is None or int(b) in only]
        full = [f"{self.path}/{p}" for p in paths]
        return self.spark.read.schema(self.schema).parquet(*full) if full else self.spark.createDataFrame([], self.schema)

    def done(self, stream: str) -> int:
        """The last batch of a stream that was merged; -1 before the first."""
        return self._now()["done"].get(stream, -1)

    def note(self, stream: str) -> dict | None:
        """What the last merge of a stream left beside its batch number."""
        return self._now().get("notes", {}).get(stream)

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, batch: int | None = None, epoch: int | None = None, note: dict | None = None) -> bool:
        """``combine`` (stored rows of the touched buckets, changes) gives those buckets' new rows. False if the batch was merged before."""
        now = self._now()
        if epoch is not None and now["epoch"] != epoch:
            raise Conflict(f"the writer of epoch {epoch} was replaced by {now['epoch']}")
        if stream is not None and batch is not None and now["done"].get(stream, -1) >= batch:
            return False
        added = {r[0]: r[1] for r in changes.groupBy(self.bucket()).agg(F.count(F.lit(1))).collect()}  # at most as many as buckets
        touched = sorted(added)
        new = dict(now)
        if touched:
            part = f"data/{uuid.uuid4().hex}"
            stored = self.read(touched)
            rows = combine(stored, changes).select(*self.schema.names).withColumn(BUCKET, self.bucket())
            # A large bucket is written by several tasks, by another hash of the key, so that a task's share does not grow.
            parts = max(1, -(-(stored.count() + sum(added.values())) // (TASK_ROWS * len(touched))))
            place = [F.col(BUCKET), F.pmod(F.hash(*self.key), F.lit(parts))] if parts > 1 else [F.col(BUCKET)]
            rows.repartition(len(touched) * parts, *place).write.partitionBy(BUCKET).parquet(f"{self.path}/{part}")
            made = {n.split("=")[1] for n in Folder(self.spark, f"{self.path}/{part}").names() if n.startswith(f"{BUCKET}=")}
            kept = {b: p for b, p in now["files"].items() if int(b) not in touched}
            new["files"] = kept | {b: f"{part}/{BUCKET}={b}" for b in made}
        if stream is not None and batch is not None:
            new["done"] = now["done"] | {stream: batch}
        if stream is not None and note is not None:
            new["notes"] = now.get("notes", {}) | {stream: note}
        self._commit(new)
        return True

    def vacuum(self) -> None:
        """Remove files that the newest manifest does not name, and older manifests. Not while others read or write."""
        now = self._now()
        used = {p.split("/")[1] for p in now["files"].values()}
        data = Folder(self.spark, f"{self.path}/data")
        for n in data.names():
            if n not in used:
                data.delete(n)
        for n in self.log.names()[:-1]:
            self.log.delete(n)


def newest(key: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A ``combine`` that keeps of each key the row that is last in ``order``, stored or new."""
    def combine(stored: DataFrame, changes: DataFrame) -> DataFrame:
        every = stored.unionByName(changes.select(*stored.columns))
        rest = [c for c in every.columns if c not in key and c not in order]
        best = every.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
        return best.select(*[c if c in key else F.col("_r")[c].alias(c) for c in every.columns])

    return combine
