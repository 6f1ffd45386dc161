"""A validation suite over raster files: integrity of the container, anomalies of each band, completeness over all bands, and one score.

Files that cannot be read keep their row, with the integrity's issues and no other figures.  All cells of level 0 of the others are read once as tiles; per-band moments and quartiles are
grouped aggregates, so a large file is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Kept
from ..sources import raster as R
from . import statistics as S

#: Penalties of an anomaly by severity, of an integrity issue, and the shares in percent from which values count as anomalies.
PENALTY = {"high": 0.2, "medium": 0.1}
ISSUE_PENALTY = 0.2
OUTLIER_Z, OUTLIER_SHARE, OUTLIER_HIGH, QUARTILE_FACTOR, QUARTILE_SHARE, SATURATED_FROM, SATURATED_SHARE = 3.0, 1.0, 5.0, 1.5, 2.0, 0.99, 1.0
MOST_MISSING, LEAST_COVERAGE, BAND_SPREAD = 50.0, 80.0, 5.0


def band_anomalies(cells: DataFrame, extent: DataFrame, saturation: bool = True) -> DataFrame:
    """path, band, coverage (percent of the file's cells with data), anomalies array<struct<kind, severity, share>>.

    ``cells``: path, band, value (cells with data only); ``extent``: path, band, cells (all of the band's).
    """
    g = cells.groupBy("path", "band").agg(F.count("*").alias("n"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.max("value").alias("top"), F.min("value").alias("low"))
    q = S.quantiles(cells, "value", (0.25, 0.75), "path", "band").select("path", "band", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    held = S.bounded(g.join(q, ["path", "band"]))
    v, iqr = F.col("value"), F.col("q3") - F.col("q1")
    share = lambda c: F.round(100.0 * F.count_if(c) / F.first("n"), 6)
    found = cells.join(held, ["path", "band"]).groupBy("path", "band").agg(
        F.first("n").alias("n"), share((F.col("sd") > 0) & (F.abs(v - F.col("mu")) > OUTLIER_Z * F.col("sd"))).alias("z"), share((v < F.col("q1") - QUARTILE_FACTOR * iqr) | (v > F.col("q3") + QUARTILE_FACTOR * iqr)).alias("quartile"),
        share((F.col("top") > F.col("low")) & (F.col("top") > 0) & (v >= F.col("top") * SATURATED_FROM)).alias("saturated"),
    )
    b = extent.join(found, ["path", "band"], "left").na.fill(0.0, ["z", "quartile", "saturated"]).na.fill(0, ["n"])
    b = b.withColumn("coverage", F.round(100.0 * F.col("n") / F.col("cells"), 6))
    one = lambda kind, severity, share, when: F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), share.alias("share")))
    medium = F.lit("medium")
    kinds = [
        one("missing", F.lit("high"), 100 - F.col("coverage"), 100 - F.col("coverage") > MOST_MISSING),
        one("outliers", F.when(F.col("z") < OUTLIER_HIGH, "medium").otherwise("high"), F.col("z"), F.col("z") > OUTLIER_SHARE),
        one("quartile_outliers", medium, F.col("quartile"), F.col("quartile") > QUARTILE_SHARE),
    ] + ([one("saturation", medium, F.col("saturated"), F.col("saturated") > SATURATED_SHARE)] if saturation else [])
    return b.select("path", "band", "coverage", F.array_compact(F.array(*kinds)).alias("anomalies"))


def validate(files: DataFrame, least_coverage: float = LEAST_COVERAGE, expected_epsg: int | None = None, expected_bands: int = 1, parts: int | None = None, **checks: bool) -> DataFrame:
    """path, valid, score, integrity (issues), quality, n_anomalies, coverage (cells where all bands have data), issues, summary: a row a file.

    Coverage under ``least_coverage`` is high where it is under half of that, else medium; bands whose coverage differs by over 5 points and another coordinate system are medium, missing bands high.  A file is
    valid without integrity issues and high completeness issues and with enough coverage.  The score is the mean of integrity (1, less 0.2 an issue), quality (1 less the anomalies' penalties a band) and coverage.
    """
    keep = Kept(files.sparkSession, "validation")
    told = keep(R.describe(files, **checks))
    good = told.filter("width IS NOT NULL")
    sound = good.filter(~F.exists("issues", lambda x: x.rlike("outside the file|^compression|^predictor"))).select("path")
    cells = keep(R.pixels(R.read_blocks(R.raster_blocks(sound).filter("level = 0"), parts)).select("path", "band", "row", "col", "value"))
    extent = good.join(sound, "path").select("path", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"), (F.col("width") * F.col("height")).alias("cells"))
    bands = band_anomalies(cells, extent).groupBy("path").agg(
        F.flatten(F.collect_list("anomalies")).alias("anomalies"), F.min("coverage").alias("least"), F.max("coverage").alias("most"), F.count("*").alias("held")
    )  # a row a band
    # 64 cells of a row are the bits of a number, so cells themselves are not grouped: a bit is left where all bands have it
    bits = cells.groupBy("path", "band", "row", F.expr("col div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(col % 64 as int))")).alias("m"))
    whole = bits.groupBy("path", "row", "word").agg(F.bit_and("m").alias("m"), F.count("*").alias("k"))
    all_bands = S.bounded(good.select("path", "bands")).join(whole, "path").filter("k = bands").groupBy("path").agg(F.sum(F.bit_count("m")).alias("c"))
    r = told.join(bands, "path", "left").join(all_bands, "path", "left")
    coverage = F.round(F.coalesce(100.0 * F.coalesce("c", F.lit(0)) / (F.col("width") * F.col("height")), F.lit(0.0)), 6)
    r = r.withColumn("coverage", coverage).withColumn("anomalies", F.coalesce("anomalies", F.array().cast(dict(bands.dtypes)["anomalies"])))
    issue = lambda text, severity, when: F.when(when, F.struct(text.alias("what"), severity.alias("severity")))
    issues = F.array_compact(F.array(
        issue(F.lit("coverage"), F.when(F.col("coverage") < least_coverage / 2, "high").otherwise("medium"), F.col("coverage") < least_coverage),
        issue(F.lit("band coverage"), F.lit("medium"), F.col("most") - F.col("least") > BAND_SPREAD),
        issue(F.lit("bands"), F.lit("high"), F.coalesce(F.col("bands"), F.lit(0)) < expected_bands),
        issue(F.lit("coordinate system"), F.lit("medium"), F.lit(False) if expected_epsg is None else ~F.col("epsg").eqNullSafe(F.lit(expected_epsg))),
    ))
    penalty = F.aggregate("anomalies", F.lit(0.0), lambda a, x: a + F.when(x["severity"] == "high", PENALTY["high"]).otherwise(PENALTY["medium"]))
    quality = F.when(F.col("held").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.round(1 - penalty / F.greatest("held", F.lit(1)), 3)))
    integrity = F.greatest(F.lit(0.0), 1 - F.size("integrity") * ISSUE_PENALTY)
    r = r.withColumnRenamed("issues", "integrity").withColumn("issues", issues).withColumn("quality", quality)
    sound_enough = (F.size("integrity") == 0) & ~F.exists("issues", lambda x: x["severity"] == "high") & (F.col("coverage") >= least_coverage)
    n = F.size("anomalies")
    summary = F.concat(
        F.when(F.size("integrity") == 0, F.lit("integrity: ok")).otherwise(F.concat(F.lit("integrity: "), F.size("integrity"), F.lit(" issues"))), F.when(n == 0, F.lit("; anomalies: none")).otherwise(F.concat(F.lit("; anomalies: "), n)),
        F.format_string("; coverage: %.1f percent", "coverage"),
    )
    return r.select("path", sound_enough.alias("valid"), F.round((integrity + F.col("quality") + F.col("coverage") / 100) / 3, 3).alias("score"), "integrity", "quality", n.alias("n_anomalies"), "coverage", "issues", summary.alias("summary"))
