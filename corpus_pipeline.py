"""A training corpus from ``documents``: each stage's result is written and read again before the next.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each class of near-duplicates one document stays.
3. decontaminate: documents that contain a benchmark item go.
4. mix: the rest is written in the order that interleaves sources to their target weights; no document goes.
5. shard: each document gets a shard and a slot; a shard's slots follow the order in which the mix wrote its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderlake.llm import decontaminate, jaccard_join, mixing, quality, sharding
from cinderlake.llm.common import Scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the mix is the sequence of the files that it wrote
    return sharding.shard_documents(docs, order=sharding.in_sequence(docs))


STAGES = [("quality", good), ("near_duplicates", near_duplicates), ("decontaminate", clean), ("mix", mixed), ("shard", sharded)]

# The classifier's weights come from an iterative fit, which SQL cannot express; tests hold the other stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
