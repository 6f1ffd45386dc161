"""Raster files written from ``lineitem`` and read back: windows, overviews, checks and ingest.

A scene a return flag; rows and columns as in the strip grid, so a scene's height grows with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..functions.storage import shared_folder
from ..operators import resample as W
from ..operators import validation
from ..sources import chunks as C
from ..sources import raster as R
from .registry import query, table

SIZE = 16
CELLS = "c AS (SELECT l_returnflag AS scene, l_orderkey // 64 AS row, l_partkey % 64 AS col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def cells(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    by = t.groupBy(F.col("l_returnflag").alias("scene"), F.expr("l_orderkey div 64").alias("row"), (F.col("l_partkey") % 64).alias("col"))
    return by.agg(F.sum("l_quantity").cast("double").alias("value")).withColumn("band", F.lit(0))


def written(spark, sf_dir):
    """The scenes' files."""
    path = f"{shared_folder(spark)}/scenes-{uuid.uuid4().hex}"
    R.write_tiled(cells(spark, sf_dir), path, SIZE, scale="30,30", tiepoint="500000,4100000", epsg="32633")
    return R.raster_files(spark, path)


def _scene():
    return F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("scene")


@query("raster_window", f"WITH {CELLS} SELECT scene, row, col, value FROM c WHERE row >= 10 AND row < 75 AND col >= 20 AND col < 45")
def raster_window(spark, sf_dir):
    """A window of each file: only the tiles that it meets are read."""
    tiles = R.read_blocks(R.in_window(R.raster_blocks(written(spark, sf_dir)).filter("level = 0"), 10, 75, 20, 45))
    return R.pixels(tiles).filter("row >= 10 AND row < 75 AND col >= 20 AND col < 45").select(_scene(), "row", "col", "value")


@query(
    "raster_overviews",
    f"WITH {CELLS}, a AS (SELECT scene, row // 2 AS row, col // 2 AS col, CAST(avg(value) AS FLOAT) AS value FROM c GROUP BY ALL), b AS (SELECT scene, row // 2 AS row, col // 2 AS col, CAST(avg(value) AS FLOAT) AS value FROM a GROUP BY ALL) SELECT scene, row // 8 AS brow, count(*) AS cells, round(avg(value) + 1e-9, 2) AS mean FROM b GROUP BY ALL",
)
def raster_overviews(spark, sf_dir):
    """The second overview, each cell the mean of four with data of the level below."""
    tiles = R.read_blocks(R.raster_blocks(written(spark, sf_dir)).filter("level = 2"))
    return R.pixels(tiles).groupBy(_scene(), F.expr("row div 8").alias("brow")).agg(F.count("*").alias("cells"), rnd(F.avg("value") + 1e-9, 2).alias("mean"))


@query(
    "raster_check",
    f"""WITH {CELLS}, e AS (SELECT scene, max(col) + 1 AS width, max(row) + 1 AS height FROM c GROUP BY scene)
SELECT scene, true AS ok, width, height, CAST(1 + greatest(0, ceil(log2(greatest(width, height) / {SIZE}))) AS INTEGER) AS levels, 32633 AS epsg, 500000.0 AS west, 4100000.0 AS north FROM e""",
)
def raster_check(spark, sf_dir):
    """Layout and georeference of the written files."""
    return R.describe(written(spark, sf_dir)).select(_scene(), "ok", "width", "height", "levels", "epsg", "west", "north")


@query("raster_ingest", f"WITH {CELLS} SELECT scene, row // 32 AS brow, count(*) AS cells, sum(value) AS total FROM c GROUP BY ALL")
def raster_ingest(spark, sf_dir):
    """The files as a stream: validated, tiled, totals a tile row written by micro-batch."""
    root = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    R.write_tiled(cells(spark, sf_dir), f"{root}/in", SIZE)
    total = lambda t: R.pixels(t).groupBy(_scene(), F.expr("row div 32").alias("brow")).agg(F.count("*").alias("cells"), F.sum("value").alias("total"))
    R.ingest(R.raster_files(spark, f"{root}/in", stream=True), f"{root}/out", total).awaitTermination()
    return spark.read.parquet(f"{root}/out/tiles").select("scene", "brow", "cells", "total")


STEPS = "s AS (SELECT l_returnflag AS variable, date_trunc('quarter', l_shipdate) AS time, l_orderkey // 64 AS row, l_partkey % 64 AS col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def steps(spark, sf_dir):
    """A variable a return flag, a step a quarter."""
    t = table(spark, sf_dir, "lineitem")
    by = t.groupBy(F.col("l_returnflag").alias("variable"), F.date_trunc("quarter", "l_shipdate").alias("time"), F.expr("l_orderkey div 64").alias("row"), (F.col("l_partkey") % 64).alias("col"))
    return by.agg(F.sum("l_quantity").cast("double").alias("value"))


@query("chunk_slice", f"WITH {STEPS} SELECT year(time) AS year, quarter(time) AS quarter, row, col, value FROM s WHERE variable = 'R' AND time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1996-10-01' AND row >= 5 AND row < 150 AND col < 40")
def chunk_slice(spark, sf_dir):
    """Three quarters of one variable in a box, from the chunks that meet it."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    C.write_store(steps(spark, sf_dir), path, (1, 64, 32))
    begin, end = spark.range(1).select(*(F.unix_seconds(F.to_timestamp(F.lit(t))) for t in ("1996-01-01", "1996-10-01"))).first()
    found = C.read_store(spark, path, "R", (begin, end), (5, 150), (0, 40))
    return found.select(F.year("time").alias("year"), F.quarter("time").alias("quarter"), "row", "col", "value")


@query("chunk_append", f"WITH {STEPS} SELECT year(time) AS year, count(*) AS cells, sum(value) AS total FROM s WHERE variable = 'N' GROUP BY ALL")
def chunk_append(spark, sf_dir):
    """A store of the steps before 1998, to which the later ones are appended."""
    path, s = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", steps(spark, sf_dir)
    C.write_store(s.filter("year(time) < 1998").unionByName(_corner(s)), path, (1, 64, 32))
    C.append(s.filter("year(time) >= 1998"), path)
    return C.read_store(spark, path, "N").groupBy(F.year("time").alias("year")).agg(F.count("*").alias("cells"), F.sum("value").alias("total"))


def _corner(s):
    """A cell without a value at the largest row and column of each variable, so that the store has room for all steps."""
    first = s.filter("year(time) < 1998").agg(F.min("time").alias("time"))
    ends = s.groupBy("variable").agg(F.max("row").alias("row"), F.max("col").alias("col"))
    return ends.crossJoin(F.broadcast(first)).select("variable", "time", "row", "col", F.lit(None).cast("double").alias("value"))


@query(
    "raster_warp",
    f"""WITH {CELLS}, e AS (SELECT max(row) + 1 AS h FROM c), g AS (SELECT {W.RADIUS} * radians(10.0) AS x0, {W.RADIUS} * asinh(tan(radians(45.0))) AS y0, {W.RADIUS} * asinh(tan(radians(45.0 - h * 0.0001))) AS y1, {W.RADIUS} * radians(10.0064) AS x1 FROM e),
o AS (SELECT r, c, x0 + (c + 0.5) * 12 AS x, y0 - (r + 0.5) * 12 AS y FROM (SELECT *, unnest(range(CAST(ceil((y0 - y1) / 12) AS BIGINT))) AS r FROM g), (SELECT unnest(range(CAST(ceil((x1 - x0) / 12) AS BIGINT))) AS c FROM g)),
s AS (SELECT r, c, CAST(floor((45.0 - degrees(atan(sinh(y / {W.RADIUS})))) / 0.0001) AS BIGINT) AS row, CAST(floor((degrees(x / {W.RADIUS}) - 10.0) / 0.0001) AS BIGINT) AS col FROM o)
SELECT scene, r // 32 AS brow, count(*) AS cells, sum(value) AS total FROM s JOIN c USING (row, col) GROUP BY ALL""",
)
def raster_warp(spark, sf_dir):
    """The scenes, laid out in degrees from 10 E, 45 N, on a Web-Mercator grid of 12 m by nearest cells; totals of 32 rows."""
    c = cells(spark, sf_dir)
    height = c.agg(F.max("row")).first()[0] + 1
    source = W.Grid(4326, 10.0, 45.0, 0.0001, 0.0001, 64, height)
    out = W.warp(c, source, W.target_grid(source, 3857, 12.0), 0, 64)
    return out.groupBy("scene", F.expr("row div 32").alias("brow")).agg(F.count("*").alias("cells"), F.sum("value").alias("total"))


@query(
    "zoom_ratio",
    f"""WITH {CELLS}, e AS (SELECT max(row) + 1 AS h, (max(row) + 1) * 3 // 2 AS oh FROM c),
o AS (SELECT r, c, r * (h - 1.0) / (oh - 1.0) AS y, c * 63.0 / 99.0 AS x FROM (SELECT *, unnest(range(oh)) AS r FROM e), (SELECT unnest(range(100)) AS c)),
n AS (SELECT r, c, a, b, (CASE WHEN a = 0 THEN 1 - (y - y0) ELSE y - y0 END) * (CASE WHEN b = 0 THEN 1 - (x - x0) ELSE x - x0 END) AS w, CAST(y0 + a AS BIGINT) AS row, CAST(x0 + b AS BIGINT) AS col
 FROM (SELECT *, least(floor(y), h - 2) AS y0, least(floor(x), 62) AS x0 FROM o, (SELECT h FROM e)), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
k AS (SELECT scene, r, c, sum(w) AS w, sum(w * value) AS value FROM n JOIN c ON c.row = n.row AND c.col = n.col WHERE w > 0 GROUP BY ALL HAVING sum(w) > 1 - 1e-9)
SELECT scene, r // 32 AS brow, count(*) AS cells, round(avg(value), 3) AS mean FROM k GROUP BY ALL""",
)
def zoom_ratio(spark, sf_dir):
    """Bilinear to one and a half times the rows and 100 columns; cells that a missing one weighs in are left out."""
    c = cells(spark, sf_dir)
    height = c.agg(F.max("row")).first()[0] + 1
    out = W.zoom(c, (height, 64), (height * 3 // 2, 100), 1, 64)
    return out.groupBy("scene", F.expr("row div 32").alias("brow")).agg(F.count("*").alias("cells"), rnd(F.avg("value"), 3).alias("mean"))


@query(
    "validation_suite",
    f"""WITH {CELLS}, m AS (SELECT scene, avg(value) AS mu, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, max(value) AS top, count(*) AS n, (max(col) + 1) * (max(row) + 1) AS cells FROM c GROUP BY scene),
s AS (SELECT scene, any_value(n) AS n, any_value(cells) AS cells, 100.0 * avg(CASE WHEN abs(value - mu) > 3 * sd THEN 1 ELSE 0 END) AS z, 100.0 * avg(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS iqr, 100.0 * avg(CASE WHEN value >= 0.99 * top THEN 1 ELSE 0 END) AS sat FROM c JOIN m USING (scene) GROUP BY scene),
k AS (SELECT scene, round(100.0 * n / cells, 6) AS coverage, CASE WHEN z > 5 THEN 2 WHEN z > 1 THEN 1 ELSE 0 END AS a, CASE WHEN iqr > 2 THEN 1 ELSE 0 END AS b, CASE WHEN sat > 1 THEN 1 ELSE 0 END AS d, CASE WHEN n < cells / 2 THEN 2 ELSE 0 END AS e FROM s)
SELECT scene, coverage >= 20 AS valid, coverage, CAST((a > 0)::INT + b + d + (e > 0)::INT AS INTEGER) AS n_anomalies, round(1 - 0.1 * (a + b + d + e), 3) AS quality, round((1 + round(1 - 0.1 * (a + b + d + e), 3) + coverage / 100) / 3, 3) AS score FROM k""",
)
def validation_suite(spark, sf_dir):
    """Integrity, anomalies and completeness of the written scenes, of which a fifth is to have data."""
    v = validation.validate(written(spark, sf_dir), least_coverage=20.0, expected_epsg=32633)
    return v.select(_scene(), "valid", "coverage", "n_anomalies", "quality", "score")
