"""Statistics of tiles as rows that merge: moments, extremes and a histogram over fixed bounds, in any order and grouping.

A state has n, mean, m2 (squared deviations from its mean), low, high and counts of ``BINS`` equal bins between the bounds, the outer ones open.  ``merge`` adds states by the pairwise formula in a grouped
aggregate: m2 of the whole is the sum of the parts' m2 and n (mean - whole mean)^2.  A quantile of a state is off by at most a bin's width inside the bounds.  ``over_tiles`` is
the other way of summing up: one statistic of each tile, with the same weight for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256
STATE = ["n", "mean", "m2", "low", "high", "bins"]


def states(cells: DataFrame, by: list[str], value: str, low: float, high: float, bins: int = BINS) -> DataFrame:
    """``by`` and a state of each group's values that are not null or NaN; groups without values have none."""
    v = F.col(value).cast("double")
    good = cells.filter(v.isNotNull() & ~F.isnan(v))
    bin_ = F.least(F.greatest(F.floor((v - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    # by bin first, so that a large group is a row a bin and task before it meets
    part = good.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"))
    one = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.when(i == F.col("bin"), F.col("n")).otherwise(F.lit(0).cast("long")))
    return merge(part.withColumn("bins", one), by)


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """The state of each group of states."""
    total = F.sum(F.col("n") * F.col("mean"))
    squares = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    bins = parts.select(*by, F.posexplode("bins").alias("at", "c")).filter("c > 0").groupBy(*by, "at").agg(F.sum("c").alias("c"))
    bins = bins.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("held"))  # at most a row a bin
    n_bins = parts.select(F.size("bins").alias("k")).limit(1)
    g = parts.groupBy(*by).agg(F.sum("n").alias("n"), (total / F.sum("n")).alias("mean"), squares.alias("sq"), F.min("low").alias("low"), F.max("high").alias("high"))
    g = g.withColumn("m2", F.greatest(F.col("sq") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)))
    g = (g.join(bins, by) if by else g.crossJoin(F.broadcast(bins))).crossJoin(F.broadcast(n_bins))  # one row
    counts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long")))
    return g.select(*by, "n", "mean", "m2", "low", "high", counts.alias("bins"))


def summary(low: float, high: float) -> dict[str, Column]:
    """mean, std (population), min, max and median (upper end of its bin, at most a bin's width over) of a state's columns."""
    width = (F.lit(high) - low) / F.size("bins")
    upto = F.transform("bins", lambda c, i: F.aggregate(F.slice("bins", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    at = F.size(F.filter(upto, lambda c: c * 2 < F.col("n")))
    return {"mean": F.col("mean"), "std": F.sqrt(F.col("m2") / F.col("n")), "min": F.col("low"), "max": F.col("high"), "median": F.least(F.lit(low) + (at + 1) * width, F.col("high"))}


def over_tiles(tiles: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """by, key, sum, mean, min, max, median, tiles of a statistic's values over tiles, each tile counting once whatever its size; nulls do not count and keys without values give no rows."""
    long = tiles.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("x")) for k in keys))).alias("s")).select(*by, "s.key", "s.x").filter("x IS NOT NULL")
    return long.groupBy(*by, "key").agg(F.sum("x").alias("sum"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.median("x").alias("median"), F.count("*").alias("tiles"))
