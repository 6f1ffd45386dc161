"""Sources and sinks: tile grids and payloads, features, partitioned outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..functions.storage import shared_folder
from ..sources import features as V
from ..sources import tiles as T
from .focal_plans import G, grid
from .registry import query, table


@query(
    "tile_grid",
    "WITH t AS (SELECT unnest(range(0, 144)) AS id) SELECT 'r' || (id // 12) || '_c' || (id % 12) AS tile_id, CAST(greatest(id % 12 * 448 - 32, 0) AS INTEGER) AS col_start, CAST(greatest(id // 12 * 448 - 32, 0) AS INTEGER) AS row_start, CAST(least(id % 12 * 448 + 480, 5000) AS INTEGER) AS col_end, CAST(least(id // 12 * 448 + 480, 5000) AS INTEGER) AS row_end FROM t",
)
def tile_grid(spark, sf_dir):
    """5000 x 5000 pixels in tiles of 512 with overlap 32."""
    return T.tile_grid(spark, 5000, 5000, 512, 32).select("tile_id", "col_start", "row_start", "col_end", "row_end")


@query("tile_windows", "WITH t AS (SELECT unnest(range(0, 100)) AS id) SELECT CAST(id % 10 AS INTEGER) AS col, CAST(id // 10 AS INTEGER) AS row, CAST(least(id % 10 * 512 + 512, 5000) AS INTEGER) AS col_end, CAST(least(id // 10 * 512 + 512, 5000) AS INTEGER) AS row_end FROM t")
def tile_windows(spark, sf_dir):
    """The same windows from the registered data source."""
    spark.dataSource.register(T.TileWindowSource)
    return spark.read.format("tile_windows").options(width=5000, height=5000, size=512).load().select("col", "row", "col_end", "row_end")


@query("tile_roundtrip", f"WITH {G} SELECT row // 16 AS trow, col // 16 AS tcol, count(*) AS cells, round(avg(value), 3) AS mean FROM g GROUP BY ALL")
def tile_roundtrip(spark, sf_dir):
    """Pixels to float32 tiles and back."""
    back = T.unpack_tiles(T.pack_tiles(grid(spark, sf_dir), 16))
    return back.groupBy(F.floor(F.col("row") / 16).alias("trow"), F.floor(F.col("col") / 16).alias("tcol")).agg(F.count("*").alias("cells"), rnd(F.avg("value"), 3).alias("mean"))


@query(
    "tile_blend",
    f"""WITH {G}, t AS (SELECT row, col, value, unnest([0, 12, 24, 36, 48]) AS c0 FROM g), k AS (SELECT *, col - c0 AS pos FROM t WHERE col >= c0 AND col < c0 + 16),
w AS (SELECT row, col, value + c0 AS v, (1 - cos(pi() * least((pos + 1) / 5, (16 - pos) / 5, 1.0))) / 2 AS w FROM k) SELECT row, col, round(sum(w * v) / sum(w) + 1e-9, 4) AS blended FROM w GROUP BY ALL""",
)
def tile_blend(spark, sf_dir):
    """Overlapping tiles of 16 columns every 12, feathered over 4 columns."""
    t = grid(spark, sf_dir).withColumn("c0", F.explode(F.array(*(F.lit(k) for k in range(0, 60, 12))))).filter("col >= c0 AND col < c0 + 16")
    w = T.blend_weight(F.col("col") - F.col("c0"), 16, 4)
    return t.groupBy("row", "col").agg(rnd(F.sum(w * (F.col("value") + F.col("c0"))) / F.sum(w) + 1e-9, 4).alias("blended"))


def _features(spark, sf_dir):
    """Suppliers' boxes written as a GeoJSON document each and read back."""
    x, y = (F.col("s_suppkey") * 71 % 340 - 170).cast("double"), (F.col("s_suppkey") * 29 % 150 - 75).cast("double")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x"), y.alias("y"))
    box = F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]", "x", "y", F.col("x") + 4, "y", F.col("x") + 4, F.col("y") + 3, "x", F.col("y") + 3, "x", "y")
    point = F.format_string("[%s,%s]", "x", "y")
    is_point = F.col("s_suppkey") % 4 == 0
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"'), F.col("s_suppkey"), F.lit('"},"geometry":{"type":"'), F.when(is_point, "Point").otherwise("Polygon"), F.lit('","coordinates":'), F.when(is_point, point).otherwise(box), F.lit("}}]}"))
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    s.select(text.alias("value")).repartition(4).write.option("lineSep", "\n").text(path)
    raw = spark.read.text(path).select(F.from_json("value", V.FEATURES).alias("doc")).select(F.explode("doc.features").alias("f"))
    f = raw.select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    return f.withColumn("ring", V.ring(F.col("geometry_type"), F.col("coordinates")))


@query(
    "geometry_stats",
    "WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 71 % 340 - 170 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 150 - 75 AS DOUBLE) AS y FROM supplier) SELECT 'Mixed' AS kind, min(x) AS west, min(y) AS south, max(CASE WHEN s_suppkey % 4 = 0 THEN x ELSE x + 4 END) AS east, max(CASE WHEN s_suppkey % 4 = 0 THEN y ELSE y + 3 END) AS north, count(*) AS valid, CAST(0 AS BIGINT) AS empty FROM s",
)
def geometry_stats(spark, sf_dir):
    return V.geometry_stats(_features(spark, sf_dir))


@query(
    "point_in_polygon",
    "WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 71 % 340 - 170 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 150 - 75 AS DOUBLE) AS y FROM supplier) SELECT CAST(s_suppkey AS VARCHAR) AS id, x + 1 > x AND x + 1 < x + 4 AS inside, false AS outside FROM s WHERE s_suppkey % 4 <> 0",
)
def point_in_polygon(spark, sf_dir):
    """Ray casting within the row: a point inside each box and one beside it."""
    f = _features(spark, sf_dir).filter("geometry_type = 'Polygon'").withColumn("b", V.bounds(F.col("ring")))
    inside = V.point_in_ring(F.col("b.west") + 1, F.col("b.south") + 1, F.col("ring"))
    outside = V.point_in_ring(F.col("b.west") - 1, F.col("b.south") + 1, F.col("ring"))
    return f.select(F.element_at("properties", "id").alias("id"), inside.alias("inside"), outside.alias("outside"))


@query("partitioned_sink", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL")
def partitioned_sink(spark, sf_dir):
    """Write by two keys, read back, aggregate: partition values come from folder names."""
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    V.write_partitioned(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), path, "l_returnflag", "l_linestatus")
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("json_csv_export", "SELECT r_name AS region, count(*) AS nations, min(n_name) AS first FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def json_csv_export(spark, sf_dir):
    """Results as JSON lines and as CSV, read back and joined."""
    root = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").write.json(f"{root}/nation")
    table(spark, sf_dir, "region").write.option("header", True).csv(f"{root}/region")
    n = spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(f"{root}/nation")
    r = spark.read.schema("r_regionkey int, r_name string").option("header", True).csv(f"{root}/region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations"), F.min("n_name").alias("first"))


@query(
    "item_metadata",
    """SELECT l_returnflag AS band, count(*) AS cells, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""",
)
def item_metadata(spark, sf_dir):
    """Per-band statistics written as one JSON value a band and parsed again."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("band")).agg(F.to_json(F.struct(F.count("*").alias("cells"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg("l_quantity"), 6).alias("mean"))).alias("doc"))
    return g.select("band", F.from_json("doc", "cells long, low double, high double, mean double").alias("d")).select("band", "d.*")
