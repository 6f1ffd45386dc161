"""Time-series operators: bins, as-of joins, gaps, runs and change tests.

Windows are partitioned by series and, where a series may be hot, the as-of joins are cut by time bucket first, so that no task needs a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone (session in UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_timestamp(c.cast("timestamp"))


def micros(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def epoch_bin(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-anchored bin of ``seconds``."""
    return F.floor(epoch(ts) / seconds) * seconds


def bin_aggregate(df: DataFrame, seconds: int, value: str, quality: str, *by: str) -> DataFrame:
    """Half-open epoch bins: centre, mean, median, min, max, sum, count, first, last and mean quality; empty bins give no row."""
    start = epoch_bin("ts", seconds)
    order = F.struct("ts", value)
    return df.groupBy(*by, start.alias("start")).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("count"),
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.avg(quality).alias("quality"),
    ).withColumn("centre", F.col("start") + seconds / 2)


def bracket(targets: DataFrame, samples: DataFrame, by: str, bucket: int) -> DataFrame:
    """The last sample at or before and the first at or after each target: ``before``, ``after`` structs (t, value).

    Targets and samples (both with column t, seconds) are put in time buckets.  Within a bucket a window over (series, bucket) finds
    neighbours; what lies outside comes from the bucket's own first and last samples, carried over buckets, which
    is one row a bucket and so small.
    """
    marked = samples.select(by, "t", F.struct("t", "value").alias("s"), F.lit(None).cast("long").alias("target")).unionByName(
        targets.select(by, "t", F.lit(None).cast("struct<t:bigint,value:double>").alias("s"), F.col("t").alias("target"))
    )
    marked = marked.withColumn("b", F.floor(F.col("t") / bucket))
    here = W.partitionBy(by, "b").orderBy("t", F.col("s").isNull().cast("int"))
    down = here.rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(by, "b").orderBy(F.col("t").desc(), F.col("s").isNull().cast("int"), F.col("s").desc()).rowsBetween(W.unboundedPreceding, 0)
    near = marked.withColumn("lo", F.last("s", True).over(down)).withColumn("hi", F.last("s", True).over(back)).filter("target IS NOT NULL")
    ends = marked.groupBy(by, "b").agg(F.max("s").alias("final"), F.min("s").alias("initial"))
    over = W.partitionBy(by).orderBy("b")
    ends = ends.withColumn("prior", F.last("final", True).over(over.rowsBetween(W.unboundedPreceding, -1))).withColumn("next", F.first("initial", True).over(over.rowsBetween(1, W.unboundedFollowing)))
    out = near.join(ends.select(by, "b", "prior", "next"), [by, "b"])
    return out.select(by, "target", F.coalesce("lo", "prior").alias("before"), F.coalesce("hi", "next").alias("after"))


def nearest_within(targets: DataFrame, samples: DataFrame, by: str, tolerance: int) -> DataFrame:
    """The sample nearest to each target within ``tolerance`` seconds (ties: the earlier).  Both sides are joined on time cells as wide as the
    tolerance: a target looks at three cells, so the join is an equi-join."""
    cell = lambda c: F.floor(c / tolerance)
    t = targets.withColumn("target", F.col("t")).withColumn("cell", F.explode(F.array(*(cell(F.col("t")) + k for k in (-1, 0, 1))))).select(by, "target", "cell")
    s = samples.select(by, F.col("t").alias("sample"), "value", cell(F.col("t")).alias("cell"))
    met = t.join(s, [by, "cell"]).withColumn("gap", F.abs(F.col("sample") - F.col("target"))).filter(F.col("gap") <= tolerance)
    return met.groupBy(by, "target").agg(F.min_by(F.struct("sample", "value", "gap"), F.struct("gap", "sample", "value")).alias("m")).select(by, "target", "m.*")


def with_prior(df: DataFrame, by: str, bucket: int) -> DataFrame:
    """Adds ``prior``: t of the series' row before, null for its first.  A window sees one time bucket of a series; the last t of the bucket
    before comes from one row a bucket, so a hot series is no task of its own."""
    b = df.withColumn("bucket", F.floor(F.col("t") / bucket))
    ends = b.groupBy(by, "bucket").agg(F.max("t").alias("final"))
    ends = ends.select(by, "bucket", F.lag("final").over(W.partitionBy(by).orderBy("bucket")).alias("carried"))
    b = b.withColumn("near", F.lag("t").over(W.partitionBy(by, "bucket").orderBy("t"))).join(ends, [by, "bucket"])
    return b.withColumn("prior", F.coalesce("near", "carried")).drop("bucket", "near", "carried")


def gaps(df: DataFrame, by: str, limit: int, begin: int, end: int, bucket: int = 86400) -> DataFrame:
    """Gaps of over ``limit`` seconds between neighbours, and before the first and after the last sample of [begin, end]."""
    t = df.select(by, "t")
    inner = with_prior(t, by, bucket).select(by, F.coalesce("prior", F.lit(begin)).cast("long").alias("start"), F.col("t").alias("stop"))
    tail = t.groupBy(by).agg(F.max("t").alias("start")).select(by, "start", F.lit(end).cast("long").alias("stop"))
    return inner.union(tail).filter(F.col("stop") - F.col("start") > limit)


def runs(df: DataFrame, by: str, flag: str) -> DataFrame:
    """Runs of consecutive true flags in time order (gaps and islands): start, stop, length."""
    w = W.partitionBy(by).orderBy("t", "id")
    n = df.select(by, "t", "id", flag, F.row_number().over(w).alias("n"))
    inner = n.filter(flag).withColumn("key", F.col("n") - F.row_number().over(w))
    return inner.groupBy(by, "key").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("length")).drop("key")
