"""Upserts, updates and deletes on a written table: copy on write by bucket of the key, a manifest a version.

Rows lie in ``buckets`` folders by a hash of the key.  A merge reads only the buckets that its changes touch, joins them by key in one shuffle of their size, writes those buckets anew beside the old
ones and then a manifest that names the current folder of every bucket.  A manifest's name is its version and is made only if it does not exist, so of two merges that began from
one version the first wins and the other runs again on what the winner wrote.  Old versions stay readable until ``forget`` deletes what no kept manifest names.

Changes are rows (key, op, values, at): ``upsert`` sets the whole row, ``update`` sets the values that are not null on a row that exists, ``delete`` drops it.  Of
several changes of a key the one with the largest ``at`` counts (of equal ones any); a null key or op is left out.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class VersionedTable:
    """A table at ``path`` with a key; all versions share its schema."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file("").getFileSystem(self._conf)

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._file("versions")
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if self._fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.path}")
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{known[-1] if version is None else version}.json").collect()))

    def _commit(self, manifest: dict) -> bool:
        """Whether the manifest is the first one of its version."""
        try:
            out = self._fs.create(self._file(f"versions/{manifest['version']}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def _write(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        name = f"data/{uuid.uuid4().hex}"
        bucketed = rows.withColumn("_bucket", bucket(keys, buckets))
        bucketed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        folders = [f.getPath().getName() for f in self._fs.listStatus(self._file(name))]
        return {f.removeprefix("_bucket="): f"{name}/{f}" for f in folders if f.startswith("_bucket=")}

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        """Version 0; rows with a null key are left out, and rows that repeat a key are an error of a later merge."""
        good = rows.dropna(subset=keys)
        parts = self._write(good, keys, buckets)
        if not self._commit({"version": 0, "keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "parts": parts}):
            raise FileExistsError(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        return self._read(held, held["parts"].values())

    def _read(self, held: dict, folders) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, changes: DataFrame, op: str = "op", at: str = "at", attempts: int = 5) -> int:
        """Apply ``changes`` and return the version made; RuntimeError if other writers won ``attempts`` times."""
        for _ in range(attempts):
            held = self.manifest()
            made = self._merged(held, changes, op, at)
            if self._commit(made):
                return made["version"]
        raise RuntimeError(f"{attempts} other merges came first")

    def _merged(self, held: dict, changes: DataFrame, op: str, at: str) -> dict:
        keys, buckets, parts = held["keys"], held["buckets"], held["parts"]
        columns = [f["name"] for f in held["schema"]["fields"]]
        values = [c for c in columns if c not in keys]
        known = changes.dropna(subset=[*keys, op])
        # the latest of a key is found by a partial aggregate, so a hot key is a row a task
        last = known.groupBy(*keys).agg(F.max_by(F.struct(F.col(op).alias("op"), *values), F.col(at)).alias("new"))
        touched = [str(r[0]) for r in known.select(bucket(keys, buckets).alias("b")).distinct().collect()]  # at most ``buckets``
        old = self._read(held, [parts[b] for b in touched if b in parts]).withColumn("old", F.struct(F.lit(True).alias("is"), *values)).select(*keys, "old")
        both = old.join(last, keys, "full_outer")
        there, what = F.col("old").isNotNull(), F.col("new.op")
        stays = F.when(what.isNull() | (what == "update"), there).otherwise(what == "upsert")
        pick = lambda c: F.when(what.isNull(), F.col(f"old.{c}")).when(what == "update", F.coalesce(f"new.{c}", f"old.{c}")).otherwise(F.col(f"new.{c}"))
        rows = both.filter(stays).select(*keys, *(pick(c).alias(c) for c in values)).select(*columns)
        new = self._write(rows, keys, buckets)
        return held | {"version": held["version"] + 1, "parts": {b: f for b, f in parts.items() if b not in touched} | new}

    def forget(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions and the folders that only they name; the number of folders deleted."""
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        used = {f for v in kept for f in self.manifest(v)["parts"].values()}
        gone = {f for v in old for f in self.manifest(v)["parts"].values()} - used
        for v in old:
            self._fs.delete(self._file(f"versions/{v}.json"), False)
        for f in gone:
            self._fs.delete(self._file(f), True)
        return len(gone)


def bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
