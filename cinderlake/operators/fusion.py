"""Reductions over several sources a cell.  A layer table has one row a (cell, source): data, quality, confidence, rank.

All strategies are grouped aggregates on the cell key with partial aggregation, so a cell seen by many sources costs one row a task.
Ties go to the smallest value or the smallest rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import ordered_mean, steady_std

CELL = ("user_id", "day")


def with_cell_moments(layers: DataFrame, *cell: str) -> DataFrame:
    """mean, std (population) and number of valid layers of the cell on each of its rows."""
    w = W.partitionBy(*cell)
    valid = F.when(F.col("quality") > 0, F.col("data"))
    return layers.withColumns({"mu": ordered_mean(valid, w), "sd": F.stddev_pop(valid).over(w), "n_valid": F.count(valid).over(w)})


def detect_conflict(layers: DataFrame, *cell: str, absolute: float = 0.1, relative: float = 0.05) -> DataFrame:
    """mean, spread, range and the share of valid layers that agree with the mean."""
    m = with_cell_moments(layers, *cell).filter("quality > 0")
    off = F.abs(F.col("data") - F.col("mu"))
    agree = (off <= absolute) | (off <= relative * F.abs("mu"))
    return m.groupBy(*cell).agg(
        F.first("mu").alias("mean"), steady_std("data").alias("spread"), (F.max("data") - F.min("data")).alias("range"), F.avg(F.when(agree, 1.0).otherwise(0.0)).alias("agreement"), F.count("*").alias("n"),
    )


#: Factor on the confidence by severity of a conflict.
PENALTY = {"none": 1.0, "low": 0.95, "medium": 0.8, "high": 0.6, "critical": 0.3}


def conflict_severity(agreement: Column, spread: Column, mean: Column) -> Column:
    """The first rule that holds decides."""
    rel = spread / F.when(F.abs(mean) > 1e-10, F.abs(mean))
    return F.when(agreement >= 0.95, "none").when(agreement >= 0.8, "low").when((agreement >= 0.5) & (rel < 0.5), "medium").when(agreement >= 0.25, "high").otherwise("critical")


def resolve(layers: DataFrame, strategy: str, *cell: str) -> DataFrame:
    """One value and confidence a cell by the named strategy."""
    valid = layers.filter("quality > 0")
    weight = F.col("quality") * F.col("confidence")
    total = layers.groupBy(*cell).agg(F.count("*").alias("layers"))
    d = F.col("data")
    if strategy == "majority":
        out = valid.groupBy(*cell).agg(F.mode(F.round(d, 0), True).alias("value"))
        votes = valid.groupBy(*cell, F.round(d, 0).alias("value")).agg(F.count("*").alias("n"))
        out = out.join(votes, [*cell, "value"]).withColumnRenamed("n", "top")
    elif strategy == "weighted_vote":
        votes = valid.groupBy(*cell, F.round(d, 0).alias("v")).agg(F.sum(weight).alias("w"))
        # weights are added from the winner's down, so ties of the share's last digit fall alike at every layout; a cell has at most as many votes as sources
        ranked = F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("order"), F.col("v").isNull().alias("none"), "v", "w")))
        out = votes.groupBy(*cell).agg(ranked.alias("r")).select(*cell, F.col("r")[0]["v"].alias("value"), (F.col("r")[0]["w"] / F.aggregate("r", F.lit(0.0), lambda s, x: s + x["w"])).alias("confidence"))
    elif strategy == "mean":
        out = valid.groupBy(*cell).agg(F.avg(d).alias("value"), F.count("*").alias("top"))
    elif strategy == "weighted_mean":
        out = valid.groupBy(*cell).agg((F.sum(d * weight) / F.sum(weight)).alias("value"), F.sum(weight).alias("top"))
    elif strategy == "median":
        out = valid.groupBy(*cell).agg(F.median(d).alias("value"), F.count("*").alias("top"))
    elif strategy == "highest_confidence":
        out = valid.groupBy(*cell).agg(F.max_by(d, F.struct(F.round(weight, 9), -F.col("rank"))).alias("value"), F.max(weight).alias("confidence"))
    elif strategy == "priority":
        out = valid.groupBy(*cell).agg(F.min_by(d, "rank").alias("value"), F.min_by(F.col("confidence"), "rank").alias("confidence"))
    elif strategy in ("minimum", "maximum"):
        best, by = (F.min, F.min_by) if strategy == "minimum" else (F.max, F.max_by)
        tie = F.col("rank") if strategy == "minimum" else -F.col("rank")
        out = valid.groupBy(*cell).agg(best(d).alias("value"), by(F.col("confidence"), F.struct(d, tie)).alias("confidence"))
    elif strategy == "range_check":
        m = with_cell_moments(valid, *cell).filter(F.abs(d - F.col("mu")) <= 2 * F.col("sd") + 1e-9)
        return m.groupBy(*cell).agg(F.avg(d).alias("value"), (F.count("*") / F.first("n_valid")).alias("confidence"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    if "top" in out.columns:
        out = out.join(total, list(cell)).withColumn("confidence", F.col("top") / F.col("layers")).drop("top", "layers")
    return out


def consensus(layers: DataFrame, *cell: str) -> DataFrame:
    """Mean, median, weighted and trimmed mean of a cell, agreement, confidence and uncertainty."""
    weight = F.col("quality") * F.col("confidence")
    valid = layers.filter("quality > 0")
    c = valid.groupBy(*cell).agg(
        F.avg("data").alias("mean"), F.median("data").alias("median"), (F.sum(F.col("data") * weight) / F.sum(weight)).alias("weighted"),
        F.array_sort(F.collect_list("data")).alias("sorted"), F.stddev_pop("data").alias("spread"), F.avg("confidence").alias("conf"),
    )
    n = F.size("sorted")
    k = F.when(n >= 3, F.greatest(F.lit(1), F.floor(n * 0.2).cast("int"))).otherwise(0)
    kept = F.slice("sorted", k + 1, n - 2 * k)
    trimmed = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    agreement = 1 - F.least(F.col("spread") / F.when(F.abs("mean") > 1e-10, F.abs("mean")).otherwise(1e-10), F.lit(1.0))
    return c.select(*cell, "mean", "median", "weighted", trimmed.alias("trimmed"), "spread", agreement.alias("agreement"), (agreement * F.col("conf")).alias("confidence"), (F.col("spread") * (1 - agreement * F.col("conf"))).alias("uncertainty"))


def ensemble(members: DataFrame, *cell: str) -> DataFrame:
    """Members (extent boolean, conf, weight): weighted average, vote and Bayesian probability with agreement and uncertainty."""
    share = F.col("weight") / F.sum("weight").over(W.partitionBy(*cell))
    p = F.when(F.col("extent"), F.col("conf")).otherwise(1 - F.col("conf"))
    c = F.least(F.greatest(F.col("conf"), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.log(c / (1 - c)) * F.when(F.col("extent"), 1).otherwise(-1)
    vote = F.col("extent").cast("double")
    m = members.withColumn("share", share)
    out = m.groupBy(*cell).agg(
        F.sum(F.col("share") * p).alias("average"), F.sum(F.col("share") * vote).alias("vote"), (1 / (1 + F.exp(-F.sum(F.col("share") * logit)))).alias("bayes"),
        F.avg(vote).alias("yes"), F.var_pop(p).alias("var"),
    )
    agreement = F.greatest(F.col("yes"), 1 - F.col("yes"))
    return out.select(*cell, "average", "vote", "bayes", agreement.alias("agreement"), (F.col("var") / 0.25).alias("uncertainty"), ((F.abs(F.col("average") - 0.5) * 2 + agreement) / 2).alias("confidence"))
