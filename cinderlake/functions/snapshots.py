"""Rounds of an iterative job as a chain of checked snapshots, so that a job that was killed goes on from its last good round.

A snapshot is a written table and, after it, a record with its schema, row count and two sums of row hashes, which do not depend on the order of rows.  Only a snapshot with a record counts; it is
good if its table still gives the record's figures.  A bad one is marked and the one before is taken.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fingerprint(df: DataFrame) -> list[str]:
    """Rows and two sums of row hashes, each by a seed of its own; one aggregate."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return [str(v) for v in df.agg(F.count("*"), *sums).first()]


class Snapshots:
    """The chain below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._file(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def save(self, df: DataFrame, k: int) -> DataFrame:
        """Write round ``k`` and read it back; a table of that round without a record, as a killed job leaves, is replaced."""
        df.write.mode("overwrite").parquet(f"{self.path}/{k}")
        self._fs.delete(self._file(f"{k}.bad"), False)
        back = self.spark.read.schema(df.schema).parquet(f"{self.path}/{k}")
        self._put(f"{k}.json", json.dumps({"schema": df.schema.jsonValue(), "fingerprint": fingerprint(back)}))
        return back

    def rounds(self) -> list[int]:
        """Rounds that have a record and are not marked as bad."""
        names = {f.getPath().getName() for f in self._fs.listStatus(self._file(""))} if self._fs.exists(self._file("")) else set()
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json") + ".bad" not in names)

    def latest(self) -> tuple[int, DataFrame] | None:
        """The last round that is good; later ones are marked."""
        for k in reversed(self.rounds()):
            record = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{k}.json").collect()))
            try:
                df = self.spark.read.schema(StructType.fromJson(record["schema"])).parquet(f"{self.path}/{k}")
                if fingerprint(df) == record["fingerprint"]:
                    return k, df
            except (PySparkException, Py4JError):
                pass  # a file that cannot be read
            self._put(f"{k}.bad", "")
        return None

    def drop(self, k: int) -> None:
        for name in (f"{k}.json", str(k), f"{k}.bad"):
            self._fs.delete(self._file(name), True)


def iterate(spark: SparkSession, path: str, start: Callable[[], DataFrame], step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, int], bool], keep: int = 2) -> DataFrame:
    """Round 0 is ``start()``, round k ``step(round k - 1, k)``, until ``done(round k, k)``; goes on from the last good snapshot below ``path``.  The last ``keep`` rounds stay."""
    chain = Snapshots(spark, path)
    found = chain.latest()
    k, now = found if found else (0, chain.save(start(), 0))
    while not done(now, k):
        k += 1
        now = chain.save(step(now, k), k)
        for old in chain.rounds():
            if old <= k - keep:
                chain.drop(old)
    return now
