"""Versioned merges and the packed box index, over tables written from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..functions.storage import shared_folder
from ..operators import boxindex as B
from ..operators.merging import VersionedTable
from .catalog_plans import _BOX, part_boxes, supplier_boxes
from .registry import query, table


@query(
    "merge_upsert",
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders)
SELECT k, CASE WHEN k % 5 = 0 THEN 'held' ELSE status END AS status, CASE WHEN k % 7 = 0 THEN 0.0 ELSE price END AS price FROM o WHERE k % 11 <> 0 UNION ALL SELECT -k - 1, 'new', price FROM o WHERE k % 13 = 0""",
)
def merge_upsert(spark, sf_dir):
    """Orders after two merges: prices and states updated, rows deleted, new keys put in."""
    t = VersionedTable(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), rnd("o_totalprice", 2).alias("price"))
    t.create(o, ["k"])
    none = F.lit(None).cast("string")
    priced = o.filter("k % 7 = 0").select("k", none.alias("status"), F.lit(0.0).alias("price"), F.lit("update").alias("op"), F.lit(1).alias("at"))
    fresh = o.filter("k % 13 = 0").select((-F.col("k") - 1).alias("k"), F.lit("new").alias("status"), "price", F.lit("upsert").alias("op"), F.lit(1).alias("at"))
    t.merge(priced.unionByName(fresh))
    held = o.filter("k % 5 = 0").select("k", F.lit("held").alias("status"), F.lit(None).cast("double").alias("price"), F.lit("update").alias("op"), F.lit(1).alias("at"))
    gone = o.filter("k % 11 = 0").select("k", none.alias("status"), F.lit(None).cast("double").alias("price"), F.lit("delete").alias("op"), F.lit(2).alias("at"))
    t.merge(held.unionByName(gone))
    return t.read()


def _index(spark, sf_dir):
    path = f"{shared_folder(spark)}/boxes-{uuid.uuid4().hex}"
    day = F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") % 300 * 86400)
    b = part_boxes(spark, sf_dir).select("p_partkey", "w", "s", "e", "n", day.alias("start"), (day + F.expr("INTERVAL 3 DAYS")).alias("end"))
    B.build(b, path, leaf=256)
    return path


@query(
    "index_search",
    f"WITH {_BOX} SELECT p_partkey, w, s FROM p WHERE w <= 40 AND e >= -30 AND s <= 35 AND n >= -20 AND p_partkey % 300 <= 121 AND p_partkey % 300 + 3 >= 60",
)
def index_search(spark, sf_dir):
    """Boxes that meet a box and a time range, from the leaf files that can hold some."""
    begin, end = spark.range(1).select(*(F.timestamp_seconds(F.lit(1704067200 + d * 86400)) for d in (60, 121))).first()
    return B.search(spark, _index(spark, sf_dir), (-30, -20, 40, 35), (begin, end)).select("p_partkey", "w", "s")


@query("index_join", f"WITH {_BOX} SELECT s_suppkey, count(*) AS boxes, CAST(sum(p_partkey) AS BIGINT) AS keys FROM p JOIN q ON w <= qe AND e >= qw AND s <= qn AND n >= qs GROUP BY s_suppkey")
def index_join(spark, sf_dir):
    """Every supplier's window against the index."""
    j = B.search_many(spark, _index(spark, sf_dir), supplier_boxes(spark, sf_dir))
    return j.groupBy("s_suppkey").agg(F.count("*").alias("boxes"), F.sum("p_partkey").cast("long").alias("keys"))
