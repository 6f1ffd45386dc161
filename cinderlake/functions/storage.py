"""Written tables in the folder that the driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where nothing is set and the master is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cinderlake-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Rounds:
    """Keeps the tables of an iterative job: each round is written, and the one before the last is dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{self.root}/{k}")
        if k > 1:
            jvm = self.spark.sparkContext._jvm
            old = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{k - 2}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{k}")


class Kept:
    """Tables that are written once and read back, until ``drop`` deletes them all."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        path, self.made = f"{self.root}/{self.made}", self.made + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
