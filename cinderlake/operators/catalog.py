"""Catalogue search, broker ranking, taxonomy matching and metadata queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import COST_SCORE, QUALITY_SCORE, RESOLUTION_DECAY_M, TEMPORAL_DECAY_DAYS, boxes_intersect, decay, lookup

#: Words that say nothing about a topic.
STOPWORDS = ("the", "and", "for", "with", "from", "that", "this", "was", "are", "you", "not")


def broker_scores(c: DataFrame, aoi_days: Column) -> DataFrame:
    """Adds the broker's scores for candidates (coverage, cloud, resolution, quality_flag, cost_tier) and their weighted total."""
    s = {
        "s_spatial": F.col("coverage") / 100,
        "s_temporal": decay(F.abs(aoi_days), TEMPORAL_DECAY_DAYS),
        "s_resolution": decay(F.col("resolution"), RESOLUTION_DECAY_M),
        "s_cloud": 1 - F.coalesce("cloud", F.lit(0.0)) / 100,
        "s_quality": lookup(F.col("quality_flag"), QUALITY_SCORE),
        "s_cost": lookup(F.col("cost_tier"), COST_SCORE),
    }
    total = 0.25 * s["s_spatial"] + 0.20 * s["s_temporal"] + 0.15 * s["s_resolution"] + 0.15 * s["s_cloud"] + 0.10 * s["s_quality"] + 0.10 * s["s_cost"] + 0.05 * F.col("preference")
    return c.withColumns(s | {"total": total})


def top_per_group(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def keywords(text: Column) -> Column:
    """Lower-cased words of over 2 characters that are no stopwords; repeats stay."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def glob_to_regex(pattern: Column) -> Column:
    """A shell pattern (* and ?) as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\\\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def box_cells(w: Column, s: Column, e: Column, n: Column, size: float) -> Column:
    """Grid cells that a box touches, so that overlapping boxes meet in an equi-join.  A box with west over east goes by the antimeridian: its
    cells are those from west to 180 and from -180 to east."""
    cells = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    xs = F.when(w <= e, cells(w, F.greatest(w, e))).otherwise(F.array_union(cells(F.least(w, F.lit(180.0)), F.lit(180.0)), cells(F.lit(-180.0), F.greatest(e, F.lit(-180.0)))))
    return F.flatten(F.transform(xs, lambda x: F.transform(cells(s, n), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def first_shared_cell(a: list[Column], b: list[Column], size: float, cell: Column) -> Column:
    """Whether ``cell`` is the first (by x, then y) of the cells that both boxes (west, south, east, north) touch; the boxes may cross the antimeridian."""

    def columns(box):
        w, e = box[0], box[2]
        return lambda x: F.when(w <= e, (x >= F.floor(w / size)) & (x <= F.floor(e / size))).otherwise((x >= F.floor(w / size)) | (x <= F.floor(e / size)))

    in_a, in_b = columns(a), columns(b)
    # the first shared column begins one of the boxes, or is the grid's first one
    starts = F.array(F.floor(a[0] / size), F.floor(b[0] / size), F.floor(F.lit(-180.0) / size))
    first = F.array_min(F.filter(starts, lambda x: in_a(x) & in_b(x)))
    return (cell["x"] == first) & (cell["y"] == F.floor(F.greatest(a[1], b[1]) / size))


def _overlaps(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Rows of ``left`` (w, s, e, n) joined to the rows of ``right`` (qw, qs, qe, qn) whose boxes overlap, each pair once: an equi-join on shared grid cells."""
    mine, asked = [F.col(x) for x in BOX], [F.col(x) for x in ASKED]
    j = left.withColumn("cell", F.explode(box_cells(*mine, size))).join(right.withColumn("cell", F.explode(box_cells(*asked, size))), "cell")
    return j.filter(boxes_intersect(mine, asked)).filter(first_shared_cell(mine, asked, size, F.col("cell"))).drop("cell")


BOX, ASKED = ("w", "s", "e", "n"), ("qw", "qs", "qe", "qn")


def box_pairs(left: DataFrame, right: DataFrame, size: float, made: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``left`` (w, s, e, n) joined to the rows of ``right`` (qw, qs, qe, qn) whose boxes overlap, each pair once.  Equal boxes are compared
    once: distinct ones meet in grid cells, and rows are joined to what their boxes met, so that only the result grows with their number.
    ``made`` are columns of two boxes, computed once for each pair of distinct ones; with them the boxes themselves are dropped."""
    met = _overlaps(left.select(*BOX).distinct(), right.select(*ASKED).distinct(), size).withColumns(made or {})
    pairs = left.join(met, list(BOX))
    return pairs.drop(*BOX).join(right, list(ASKED)).drop(*ASKED) if made else pairs.join(right, list(ASKED))


def affected_population(events: DataFrame, event: str, counties: DataFrame, area_km2: Column, size: float, county_km2: float = 1000.0) -> DataFrame:
    """event, counties, affected, confidence: people of the counties whose boxes an event's box overlaps, by the event's area over ``county_km2`` a county
    (at most all), cut to a whole number; events without a county get 0 and low confidence.  ``counties``: w, s, e, n, population.
    Counties of one box are added up first and events of one box ask once, so work grows with the distinct boxes that meet, not with pairs of rows."""
    held = counties.groupBy(*BOX).agg(F.count("*").alias("counties"), F.sum("population").alias("people"))
    met = _overlaps(held, events.select(*ASKED).distinct(), size).groupBy(*ASKED).agg(F.sum("counties").alias("counties"), F.sum("people").alias("people"))
    e = events.select(event, area_km2.alias("area"), *ASKED).join(met, list(ASKED), "left").withColumn("counties", F.coalesce("counties", F.lit(0)))
    share = F.least(F.lit(1.0), F.try_divide("area", F.col("counties") * county_km2))
    medium = ((F.col("counties") == 1) & (share < 0.5)) | F.col("counties").between(1, 3)
    return e.select(event, "counties", F.coalesce(F.floor(F.col("people") * share), F.lit(0)).cast("long").alias("affected"), F.when(medium, "medium").otherwise("low").alias("confidence"))


def sha_key(*parts: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)
