"""Band statistics, histograms, stretches, moments and calibration, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import Kept

GROUPS = 4096
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def band_statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, max, mean, std and variance (population), sum, count, valid, nodata, percentiles (exact, linear), distinct count."""
    v = F.col(value)
    g = df.groupBy(*by).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"), F.sum(v).alias("sum"),
        F.count("*").alias("n"), F.count(v).alias("valid"), (F.count("*") - F.count(v)).alias("nodata"), F.countDistinct(v).alias("n_unique"),
    )
    return g.join(quantiles(df, value, [p / 100 for p in PERCENTILES], *by).withColumnRenamed("q", "pct"), list(by))


def histogram(df: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """Counts in equal bins between a band's min and max; the maximum falls in the last bin; a constant band has one bin."""
    span = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.join(span, list(by)).groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def bounded(groups: DataFrame) -> DataFrame:
    """The same rows, which are made here: up to GROUPS go to all tasks of a join, more meet their rows in it."""
    found = groups.limit(GROUPS + 1).collect()
    return F.broadcast(groups.sparkSession.createDataFrame(found, groups.schema)) if len(found) <= GROUPS else groups


def quantiles(df: DataFrame, value: str, probs: Sequence[float], *by: str, bins: int = 20_000) -> DataFrame:
    """by, q (array<double>): exact quantiles with linear interpolation, in two passes, so that no task holds all values of a group.

    The first pass is a mergeable sketch whose ranks are off by at most 1 in ``bins``: it gives two values around each wanted rank, however the values are spread.  The second
    counts the values between each two neighbouring ends, and the distinct values inside only, so a task gets at most about 4 in ``bins`` of a group's values for a rank, or ``bins`` values.
    Nulls do not count; a group without values has null quantiles.
    """
    by, k = list(by), len(probs)
    rows = df.select(*by, F.col(value).cast("double").alias("v"))
    wide = 2.0 / bins
    sketch = F.percentile_approx("v", [max(p - wide, 0.0) for p in probs] + [min(p + wide, 1.0) for p in probs], bins)
    span = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), sketch.alias("e"))
    few = F.col("n") <= bins  # a group as small as that is counted whole
    low = [F.col("lo") if p - wide <= 0 else F.when(few, F.col("lo")).otherwise(F.col("e")[i]) for i, p in enumerate(probs)]
    high = [F.col("hi") if p + wide >= 1 else F.when(few, F.col("hi")).otherwise(F.col("e")[k + i]) for i, p in enumerate(probs)]
    span = span.select(*by, "n", *(c.alias(f"low{i}") for i, c in enumerate(low)), *(c.alias(f"high{i}") for i, c in enumerate(high)))
    # the first pass runs here; the ends of up to GROUPS groups go to all tasks, more meet their rows in a join
    found = span.limit(GROUPS + 1).collect()
    few_groups = len(found) <= GROUPS
    if few_groups:
        span = df.sparkSession.createDataFrame(found, span.schema)
    rows = rows.filter("v IS NOT NULL")
    if by:
        rows = rows.join(F.broadcast(span) if few_groups else span, by)
    else:
        rows = rows.withColumns({c: F.lit(found[0][c]).cast(t) for c, t in span.dtypes})
    slot, inside = F.lit(0), F.lit(False)
    for i in range(k):
        slot = slot + (F.col("v") >= F.col(f"low{i}")).cast("int") + (F.col("v") > F.col(f"high{i}")).cast("int")
        inside = inside | F.col("v").between(F.col(f"low{i}"), F.col(f"high{i}"))
    # a slot lies between neighbouring ends, so its values are all inside or all outside
    counted = rows.groupBy(*by, "n", slot.alias("slot"), F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    before = lambda *order: F.coalesce(F.sum("c").over(order[0].rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = counted.groupBy(*by, "slot").agg(F.sum("c").alias("c")).select(*by, "slot", before(W.partitionBy(*by).orderBy("slot")).alias("base"))  # 2 k + 1 a group
    held = counted.filter("v IS NOT NULL").withColumn("before", before(W.partitionBy(*by, "slot").orderBy("v"))).join(slots, [*by, "slot"])
    held = held.withColumn("before", F.col("base") + F.col("before"))
    ranks = F.array_distinct(F.array(*(f((F.col("n") - 1) * p) for p in probs for f in (F.floor, F.ceil))))
    mine = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))
    found = held.select(*by, "v", F.explode(mine).alias("rank")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = span.select(*by, "n")
    out = out.join(found, by, "left") if by else out.crossJoin(F.broadcast(found))

    def one(p: float) -> Column:
        pos = (F.col("n") - 1) * p
        low, high = F.element_at("at", F.floor(pos)), F.element_at("at", F.ceil(pos))
        return F.when(F.floor(pos) == F.ceil(pos), low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    return out.select(*by, F.array(*(one(p) for p in probs)).alias("q"))


def with_median(df: DataFrame, value: Column, name: str, default: float) -> DataFrame:
    """``df`` with the median of ``value`` over the whole table (nulls do not count; ``default`` without values)."""
    one = quantiles(df.select(value.alias("v")), "v", (0.5,)).select(F.coalesce(F.col("q")[0], F.lit(default)).alias(name))
    return df.crossJoin(F.broadcast(one))


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each in the order of ``order`` (which has no ties): ranges of rows are summed apart, and a range begins where those before it end."""
    keep = Kept(df.sparkSession, "running")
    ranged = keep(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row a task
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.sum(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(parts, "_part").withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_own", "_base")


def next_value(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the first non-null ``value`` from each row on, in the order of ``order``, found range by range with the next range's first carried back."""
    keep = Kept(df.sparkSession, "next")
    ranged = keep(df.repartitionByRange(*(F.col(c) for c in order)).withColumn("_part", F.spark_partition_id()))
    at = F.struct(*order)
    first = ranged.groupBy("_part").agg(F.min_by(value, F.when(F.col(value).isNotNull(), at)).alias("_first"))  # a row a task
    parts = first.select("_part", F.first("_first", True).over(W.orderBy("_part").rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    own = F.first(value, True).over(W.partitionBy("_part").orderBy(*order).rowsBetween(0, W.unboundedFollowing))
    return ranged.withColumn("_own", own).join(parts, "_part").withColumn(name, F.coalesce("_own", "_later")).drop("_part", "_own", "_later")


def with_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``df`` with a column for each (name: column, probability): quantiles of the whole table, a one-row table a column of ``df``."""
    out = df
    for c in dict.fromkeys(c for c, _ in wanted.values()):
        mine = {n: p for n, (x, p) in wanted.items() if x == c}
        q = quantiles(df, c, list(mine.values())).select(*(F.col("q")[k].alias(n) for k, n in enumerate(mine)))
        out = out.crossJoin(F.broadcast(q))
    return out


def moments(value: str) -> dict[str, Column]:
    """Raw power sums; skewness and kurtosis are built from them by hand, with the sample corrections."""
    v = F.col(value)
    return {"n": F.count(v), "m1": F.avg(v), "sd": F.stddev_samp(v)}


def adjusted_skewness(n: Column, m3: Column, sd: Column) -> Column:
    return m3 / F.pow(sd, 3) * F.sqrt(n * (n - 1)) / (n - 2)


def adjusted_kurtosis(n: Column, m4: Column, sd: Column) -> Column:
    """From the excess kurtosis with the sample deviation."""
    return ((n + 1) * (m4 / F.pow(sd, 4) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))


def calibration_bins(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
