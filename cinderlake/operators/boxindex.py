"""A packed index of boxes: a table written along a space-filling curve, with the bounds of each file, so that a search opens few files.

Boxes are sorted by the Hilbert number of their centre and cut into files of about ``leaf`` rows, which are the leaves; a box over the antimeridian lies with its western part.  Bounds of
leaves (unions of their boxes and times) are kept as a table beside them, and the bounds of ``fan`` neighbouring leaves above that.  A search reads the top level, then the leaves below those that it meets,
then their files only, and tests each row exactly; a join of many windows meets the leaves in grid cells first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import SPATIAL, TEMPORAL, boxes_intersect
from .catalog import box_pairs

LEAF, FAN, ORDER = 100_000, 64, 12
SIDES = ("w", "s", "e", "n")


def build(boxes: DataFrame, path: str, leaf: int = LEAF, fan: int = FAN) -> None:
    """Write ``boxes`` (w, s, e, n in degrees, start, end timestamps or null, other columns) with their index below ``path``.  Boxes with a null side are left out."""
    spark = boxes.sparkSession
    cells = (1 << ORDER) - 1
    east = F.when(F.col("w") <= F.col("e"), F.col("e")).otherwise(180.0)
    at = lambda c, low, span: F.least(F.greatest(F.floor((c - low) / span * cells), F.lit(0)), F.lit(cells)).cast("long")
    good = boxes.dropna(subset=list(SIDES))
    n = good.count()
    coded = good.withColumn("_x", at((F.col("w") + east) / 2, -180.0, 360.0)).withColumn("_y", at((F.col("s") + F.col("n")) / 2, -90.0, 180.0))
    # the curve's number is found step by step, each step a projection of its own, so that expressions stay small
    coded = with_hilbert(coded, "_x", "_y", "_code").drop("_x", "_y")
    parts = max(1, -(-n // leaf))
    coded.repartitionByRange(parts, "_code", F.xxhash64(*SIDES)).sortWithinPartitions("_code").drop("_code").write.option("maxRecordsPerFile", 2 * leaf).parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    west, side_e = F.when(F.col("w") <= F.col("e"), F.col("w")).otherwise(-180.0), F.when(F.col("w") <= F.col("e"), F.col("e")).otherwise(180.0)
    bounds = rows.groupBy(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file")).agg(
        F.min(west).alias("w"), F.min("s").alias("s"), F.max(side_e).alias("e"), F.max("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("rows"),
    )
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    leaves = bounds.withColumn("node", F.floor(number / fan))
    leaves.repartitionByRange(max(1, parts // (fan * fan)), "node").sortWithinPartitions("node").write.parquet(f"{path}/leaves")
    top = spark.read.parquet(f"{path}/leaves").groupBy("node").agg(*(F.min(c).alias(c) for c in ("w", "s", "start")), *(F.max(c).alias(c) for c in ("e", "n", "end")))
    top.coalesce(1).write.parquet(f"{path}/top")  # a row for each ``fan`` files


def with_hilbert(df: DataFrame, x: str, y: str, name: str, order: int = ORDER) -> DataFrame:
    """``df`` with the number along the Hilbert curve of the cell (``x``, ``y``), both from 0 to 2 ** order - 1."""
    step = df.withColumns({"_hx": F.col(x), "_hy": F.col(y), name: F.lit(0).cast("long")})
    for k in reversed(range(order)):
        side = 1 << k
        rx, ry = F.shiftright("_hx", k) % 2, F.shiftright("_hy", k) % 2
        turned = (ry == 0) & (rx == 1)
        fx, fy = (F.when(turned, side - 1 - F.col(c) % side).otherwise(F.col(c) % side) for c in ("_hx", "_hy"))
        step = step.select(*(c for c in step.columns if c not in ("_hx", "_hy", name)), F.when(ry == 0, fy).otherwise(fx).alias("_hx"), F.when(ry == 0, fx).otherwise(fy).alias("_hy"), (F.col(name) + F.lit(side * side).cast("long") * (3 * rx).bitwiseXOR(ry)).alias(name))
    return step.drop("_hx", "_hy")


def files_for(spark: SparkSession, path: str, box: tuple[float, float, float, float], times: tuple | None = None) -> list[str]:
    """The names of the files whose bounds meet a box (which may cross the antimeridian) and a closed range of times."""
    asked = [F.lit(float(v)) for v in box]
    meets = boxes_intersect([F.col(c) for c in SIDES], asked)
    if times is not None:
        meets = meets & (F.col("start") <= F.lit(times[1])) & (F.col("end") >= F.lit(times[0]))
    nodes = spark.read.parquet(f"{path}/top").filter(meets).select("node")
    return sorted(r[0] for r in spark.read.parquet(f"{path}/leaves").filter(meets).join(F.broadcast(nodes), "node").select("file").collect())


def search(spark: SparkSession, path: str, box: tuple[float, float, float, float], times: tuple | None = None, spatial: str = "intersects", temporal: str = "overlaps") -> DataFrame:
    """Rows that stand in the named relations to the box and the times (a null time of a row never does); only files that can hold such rows are listed for the scan."""
    every = spark.read.parquet(f"{path}/rows")
    found = files_for(spark, path, box, times if temporal not in ("before", "after") else None)
    rows = spark.read.schema(every.schema).parquet(*(f"{path}/rows/{f}" for f in found)) if found else every.limit(0)
    test = SPATIAL[spatial]([F.col(c) for c in SIDES], [F.lit(float(v)) for v in box])
    if times is not None:
        test = test & TEMPORAL[temporal](F.col("start"), F.col("end"), F.lit(times[0]), F.lit(times[1]))
    return rows.filter(test)


def search_many(spark: SparkSession, path: str, windows: DataFrame, size: float = 8.0) -> DataFrame:
    """``windows`` (qw, qs, qe, qn, other columns) joined to the rows they meet.  Windows meet leaves first; rows of files that none met are not joined."""
    leaves = spark.read.parquet(f"{path}/leaves").select("file", *SIDES)
    met = box_pairs(leaves, windows, size).select("file").distinct()
    rows = spark.read.parquet(f"{path}/rows").withColumn("file", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1))
    return box_pairs(rows.join(met, "file", "left_semi").drop("file"), windows, size)
