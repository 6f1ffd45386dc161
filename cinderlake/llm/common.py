"""Table reading, shared scratch tables and batch grouping used by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A temporary folder is set only where neither that setting nor a checkpoint folder exists and all work is in this
    process (a local master, as in tests); on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cinderlake-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int) -> DataFrame:
    """``left`` joined to ``right`` (one row a key, whose column ``count`` is the number of ``left``'s rows with it), without a hot task.

    Keys with over 1/65536 of ``left``'s ``rows`` (and over one) go by broadcast: at most 131072 keys at any size.  The others are shuffled.  Null keys do not meet.
    """
    limit = max(1, rows >> 16)
    names = [c for c in right.columns if c not in keys]
    found = left.join(F.broadcast(right.filter(F.col(count) > limit).withColumn("_hot", F.lit(True))), keys, "left")
    rest = found.filter("_hot IS NULL").drop("_hot", *names).join(right.filter(F.col(count) <= limit), keys)
    return found.filter("_hot").drop("_hot").unionByName(rest)


class Scratch:
    """Written tables under the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` once, with the writer's ``options``, and read it back."""
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut key-sorted batches so that no group is torn: yields tables and the offsets of their groups.

    Memory is bounded by one batch and the longest group, which callers bound by blocking.
    """

    def offsets(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[-1].as_py() for k in keys):
            held.append(batch)
            continue
        t = pa.Table.from_batches([*held, batch])
        at = offsets(t)
        last = int(at[-1])
        if last:
            yield t.slice(0, last), np.append(at[:-1], last)
        held = t.slice(last).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.append(offsets(t), t.num_rows)
