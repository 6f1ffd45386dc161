"""Vector features: GeoJSON in, well-known binary and bounds as columns, partitioned sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature: properties, geometry type, the coordinates' JSON text and the first ring or point list as (x, y) pairs."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", FEATURES).alias("doc"))
    f = raw.select(F.explode("doc.features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    return f.withColumn("ring", ring(F.col("geometry_type"), F.col("coordinates")))


def ring(kind: Column, coordinates: Column) -> Column:
    """Points of the geometry's first ring; a point is a ring of one."""
    deep = {"Point": "array<double>", "LineString": "array<array<double>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}
    p = {k: F.from_json(coordinates, t) for k, t in deep.items()}
    first = lambda c: F.get(c, F.lit(0))
    return F.when(kind == "Point", F.array(p["Point"])).when(kind == "LineString", p["LineString"]).when(kind == "Polygon", first(p["Polygon"])).when(kind == "MultiPolygon", first(first(p["MultiPolygon"])))


def bounds(points: Column) -> Column:
    """struct(west, south, east, north) of a list of (x, y) pairs; the whole world for no points."""
    x, y = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.struct(F.coalesce(F.array_min(x), F.lit(-180.0)).alias("west"), F.coalesce(F.array_min(y), F.lit(-90.0)).alias("south"), F.coalesce(F.array_max(x), F.lit(180.0)).alias("east"), F.coalesce(F.array_max(y), F.lit(90.0)).alias("north"))


def point_in_ring(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule over the ring's edges."""
    at = lambda i, k: F.get(F.get(points, i), F.lit(k))
    n = F.size(points)

    def crosses(i: Column) -> Column:
        j = (i + 1) % n
        x1, y1, x2, y2 = at(i, 0), at(i, 1), at(j, 0), at(j, 1)
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)

    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return F.size(hits) % 2 == 1


def geometry_stats(features: DataFrame) -> DataFrame:
    """Kinds of geometry (Mixed if several), total bounds, and counts of valid and empty ones."""
    b = features.withColumn("b", bounds(F.col("ring")))
    n = F.countDistinct("geometry_type")
    return b.agg(F.when(n > 1, "Mixed").otherwise(F.max("geometry_type")).alias("kind"), F.min("b.west").alias("west"), F.min("b.south").alias("south"), F.max("b.east").alias("east"), F.max("b.north").alias("north"), F.count(F.when(F.size("ring") > 0, 1)).alias("valid"), F.count(F.when(F.coalesce(F.size("ring"), F.lit(0)) <= 0, 1)).alias("empty"))


#: Folders that a task writes to at a time; rows of more than these are sorted by folder.
OPEN_FOLDERS = 16


def write_partitioned(df: DataFrame, path: str, *by: str, fmt: str = "parquet") -> None:
    """One folder a key; rows of a key meet in a few tasks, and a hot key is spread over several by adaptive execution.

    A task writes its rows as they come, so its memory does not grow with them: a shuffle's part of few distinct values is many rows, and a sort would hold them all.
    """
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, OPEN_FOLDERS)
    try:
        (df.hint("rebalance", *by) if by else df).write.partitionBy(*by).format(fmt).save(path)
    finally:
        conf.set(name, before)
