"""States that merge and rounds that resume."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..functions.snapshots import iterate
from ..functions.storage import shared_folder
from ..operators import tilestats as T
from .raster_plans import CELLS, cells
from .registry import query, table

LOW, HIGH = 0.0, 512.0


@query(
    "tile_statistics",
    f"WITH {CELLS} SELECT scene, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS low, max(value) AS high, CAST(count(DISTINCT row // 32) AS BIGINT) AS tiles FROM c GROUP BY scene",
)
def tile_statistics(spark, sf_dir):
    """States of tiles of 32 rows, merged by scene."""
    tiles = T.states(cells(spark, sf_dir).withColumn("tile", F.expr("row div 32")), ["scene", "tile"], "value", LOW, HIGH)
    whole = T.merge(tiles, ["scene"])
    made = T.summary(LOW, HIGH)
    out = whole.select("scene", "n", rnd(made["mean"], 4).alias("mean"), rnd(made["std"], 4).alias("std"), "low", "high")
    return out.join(tiles.groupBy("scene").agg(F.count("*").alias("tiles")), "scene")


@query(
    "tile_aggregates",
    f"""WITH {CELLS}, t AS (SELECT scene, row // 32 AS tile, count(*)::DOUBLE AS n, avg(value) AS mean, max(value) AS high FROM c GROUP BY ALL), u AS (UNPIVOT t ON n, mean, high INTO NAME key VALUE x)
SELECT scene, key, round(sum(x), 4) AS sum, round(avg(x), 4) AS mean, round(min(x), 4) AS min, round(max(x), 4) AS max, round(median(x), 4) AS median, count(*) AS tiles FROM u GROUP BY ALL""",
)
def tile_aggregates(spark, sf_dir):
    """Statistics of tiles over tiles, every tile with the same weight."""
    t = cells(spark, sf_dir).groupBy("scene", F.expr("row div 32").alias("tile")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    g = T.over_tiles(t, ["scene"], ["n", "mean", "high"])
    return g.select("scene", "key", *(rnd(c, 4).alias(c) for c in ("sum", "mean", "min", "max", "median")), "tiles")


@query(
    "snapshot_rounds",
    "WITH r0 AS (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal AS v FROM customer), "
    + ", ".join(f"r{i} AS (SELECT k, nation, 0.5 * v + 0.5 * avg(v) OVER (PARTITION BY nation) AS v FROM r{i - 1})" for i in (1, 2, 3))
    + " SELECT k, nation, round(v, 4) AS v FROM r3",
)
def snapshot_rounds(spark, sf_dir):
    """Balances drawn to their nation's mean in three rounds, each a checked snapshot; the job is stopped after the second and goes on."""
    path = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    start = lambda: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))

    def step(df, k):
        mean = df.groupBy("nation").agg(F.avg("v").alias("m"))
        return df.join(mean, "nation").select("k", "nation", (F.col("v") * 0.5 + F.col("m") * 0.5).alias("v"))

    iterate(spark, path, start, step, lambda df, k: k == 2)
    return iterate(spark, path, start, step, lambda df, k: k == 3).select("k", "nation", rnd("v", 4).alias("v"))
