"""Focal, connectivity and resampling queries on a grid of ``lineitem`` quantities.

The grid is a strip: a row for 64 orders, 64 columns by part.  It grows with the table, at the same density and spread of values, and has
holes where no line falls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..functions.storage import Kept, Rounds
from ..operators import focal as N
from ..operators.kernels import with_global
from .registry import query, table


#: Lines a task of the grid and of its windows: about a quarter as many cells.
LINES = 1_250_000


def tasks(spark, sf_dir):
    """Tasks for the grid: as many as shuffles have, more where a task would get over LINES lines, so that what a task holds does not grow with the table."""
    # the count is read from the files' footers
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // LINES))


def grid(spark, sf_dir):
    """Lines are shuffled to strips of 64 rows before they are grouped, so that no task holds the cells of a whole split of the file."""
    t = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 64").alias("row"), (F.col("l_partkey") % 64).alias("col"), "l_quantity")
    t = t.withColumn("strip", F.expr("row div 64")).repartition(tasks(spark, sf_dir), "strip")
    return t.groupBy("strip", "row", "col").agg(F.round(F.avg("l_quantity"), 6).alias("value")).drop("strip")


G = 'g AS (SELECT l_orderkey // 64 AS "row", l_partkey % 64 AS col, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL)'
_NEAR = "JOIN g n ON n.row BETWEEN g.row - {h} AND g.row + {h} AND n.col BETWEEN g.col - {h} AND g.col + {h}"


@query("local_variance", f'WITH {G} SELECT g.row, g.col, round(avg(n.value) + 1e-9, 5) AS mean, round(sqrt(greatest(avg(n.value * n.value) - avg(n.value) * avg(n.value), 0)), 4) AS std, min(n.value) AS low, max(n.value) AS high, count(*) AS n FROM g {_NEAR.format(h=1)} GROUP BY g.row, g.col')
def local_variance(spark, sf_dir):
    """3 x 3 statistics; windows are cut at the edge."""
    v = F.col("value")
    var = F.avg(v * v) - F.avg(v) * F.avg(v)
    return N.focal(grid(spark, sf_dir), 1, [rnd(F.avg(v) + 1e-9, 5).alias("mean"), rnd(F.sqrt(F.greatest(var, F.lit(0.0))), 4).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n")], parts=tasks(spark, sf_dir))


@query(
    "fire_contextual",
    f"""WITH {G}, b AS (SELECT g.row, g.col, g.value, avg(n.value) FILTER (WHERE n.value < 32 AND NOT (n.row = g.row AND n.col = g.col)) AS mu, stddev_pop(n.value) FILTER (WHERE n.value < 32 AND NOT (n.row = g.row AND n.col = g.col)) AS sd,
 count(*) FILTER (WHERE n.value < 32 AND NOT (n.row = g.row AND n.col = g.col)) AS n FROM g {_NEAR.format(h=2)} GROUP BY g.row, g.col, g.value)
SELECT row, col, round(value, 4) AS value, round(mu + 1e-9, 4) AS background, value - mu > 3 AND value - mu > 1.5 * sd AS fire FROM b WHERE n >= 3""",
)
def fire_contextual(spark, sf_dir):
    """A cell against the non-fire cells of its window (5 x 5 here), the centre left out, three at least."""
    g = grid(spark, sf_dir).withColumn("own_value", F.col("value"))
    near = N.spread(g, N.offsets(2), "value", parts=tasks(spark, sf_dir))
    centre = (F.col("dr") == 0) & (F.col("dc") == 0)
    back = F.when(~centre & (F.col("value") < 32), F.col("value"))
    b = near.groupBy(*N.CELL).agg(F.max(F.when(centre, F.col("value"))).alias("v"), F.avg(back).alias("mu"), F.stddev_pop(back).alias("sd"), F.count(back).alias("n")).filter("v IS NOT NULL AND n >= 3")
    gap = F.col("v") - F.col("mu")
    return b.select("row", "col", rnd("v", 4).alias("value"), rnd(F.col("mu") + 1e-9, 4).alias("background"), ((gap > 3) & (gap > 1.5 * F.col("sd"))).alias("fire"))


@query(
    "fire_contextual_21",
    f"""WITH {G}, h AS (SELECT row, col, 280 + value / 5 + CASE WHEN row % 32 < 6 AND col % 32 < 6 THEN 60 ELSE 0 END AS value FROM g),
b AS (SELECT h.row, h.col, h.value, avg(n.value) FILTER (WHERE n.value < 310 AND NOT (n.row = h.row AND n.col = h.col)) AS mu, stddev_pop(n.value) FILTER (WHERE n.value < 310 AND NOT (n.row = h.row AND n.col = h.col)) AS sd,
 count(*) FILTER (WHERE n.value < 310 AND NOT (n.row = h.row AND n.col = h.col)) AS n FROM h JOIN h n ON n.row BETWEEN h.row - 10 AND h.row + 10 AND n.col BETWEEN h.col - 10 AND h.col + 10 GROUP BY h.row, h.col, h.value),
k AS (SELECT row, col, value, CASE WHEN n >= 3 THEN mu ELSE 0 END AS mu, CASE WHEN n >= 3 THEN sd ELSE 0 END AS sd FROM b), f AS (SELECT *, value > 320 AND value - mu > 10 AND value - mu > 3 * sd AS fire FROM k)
SELECT row, col, round(value, 4) AS value, round(mu, 4) AS background, fire, round(CASE WHEN fire THEN (least(greatest((value - 330) / 30, 0), 1) + least(greatest((value - mu) / 50, 0), 1)) / 2 ELSE 0 END, 4) AS confidence FROM f""",
)
def fire_contextual_21(spark, sf_dir):
    """The contextual test with the reference's window and thresholds; the grid as temperatures, with hot areas of 6 x 6 cells."""
    hot = (F.col("row") % 32 < 6) & (F.col("col") % 32 < 6)
    g = grid(spark, sf_dir).withColumn("value", 280 + F.col("value") / 5 + F.when(hot, 60).otherwise(0))
    return N.contextual_fire(g).select("row", "col", rnd("value", 4).alias("value"), rnd("mu", 4).alias("background"), "fire", rnd("confidence", 4).alias("confidence"))


@query(
    "slope_aspect",
    f"""WITH {G}, n AS (SELECT g.row, g.col, g.value AS v, u.value AS u, d.value AS d, l.value AS l, r.value AS r FROM g LEFT JOIN g u ON u.row = g.row - 1 AND u.col = g.col LEFT JOIN g d ON d.row = g.row + 1 AND d.col = g.col
 LEFT JOIN g l ON l.row = g.row AND l.col = g.col - 1 LEFT JOIN g r ON r.row = g.row AND r.col = g.col + 1),
d AS (SELECT row, col, CASE WHEN u IS NOT NULL AND d IS NOT NULL THEN (d - u) / 2 WHEN d IS NOT NULL THEN d - v ELSE v - u END AS dy, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (r - l) / 2 WHEN r IS NOT NULL THEN r - v ELSE v - l END AS dx FROM n)
SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy) / 30)), 5) AS slope, round((degrees(atan2(-dx, dy)) + 360) % 360, 4) AS aspect FROM d""",
)
def slope_aspect(spark, sf_dir):
    g = grid(spark, sf_dir)
    d = g.select("row", "col", N.gradient(g, "row").alias("dy"), N.gradient(g, "col").alias("dx"))
    steep = F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / 30))
    return d.select("row", "col", rnd(steep, 5).alias("slope"), rnd((F.degrees(F.atan2(-F.col("dx"), F.col("dy"))) + 360) % 360, 4).alias("aspect"))


@query("isolated_pixels", f"WITH {G}, m AS (SELECT row, col FROM g WHERE value > 28), n AS (SELECT m.row, m.col, count(*) - 1 AS neighbours FROM m JOIN m k ON k.row BETWEEN m.row - 1 AND m.row + 1 AND k.col BETWEEN m.col - 1 AND m.col + 1 GROUP BY ALL) SELECT row, col FROM n WHERE neighbours = 0")
def isolated_pixels(spark, sf_dir):
    m = grid(spark, sf_dir).filter("value > 28").select("row", "col", F.lit(1).alias("value"))
    return N.focal(m, 1, [F.count("value").alias("n")], parts=tasks(spark, sf_dir)).filter("n = 1").select("row", "col")


@query(
    "getis_ord",
    f"""WITH {G}, t AS (SELECT count(*)::DOUBLE AS n, avg(value) AS mu, stddev_pop(value) AS sd FROM g), f AS (SELECT g.row, g.col, sum(n.value) AS s FROM g {_NEAR.format(h=1)} GROUP BY g.row, g.col),
z AS (SELECT row, col, (s - mu * 9) / (sd * sqrt((n * 9 - 81) / (n - 1))) AS z FROM f, t) SELECT row, col, round(z, 5) AS z, z > 1.96 AS hotspot FROM z""",
)
def getis_ord(spark, sf_dir):
    """Gi* with zero padding: the weight sum stays 9 at the edge."""
    g = grid(spark, sf_dir)
    f = N.focal(g, 1, [F.sum("value").alias("s")], parts=tasks(spark, sf_dir))
    t = g.agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = (F.col("s") - F.col("mu") * 9) / (F.col("sd") * F.sqrt((F.col("n") * 9 - 81) / (F.col("n") - 1)))
    return f.crossJoin(F.broadcast(t)).select("row", "col", z.alias("z")).select("row", "col", rnd("z", 5).alias("z"), (F.col("z") > 1.96).alias("hotspot"))


@query(
    "structural_damage",
    f"""WITH {G}, h AS (SELECT row, col, value / 50 AS pre, (value * (1 + (row + col) % 3 * 0.2)) / 60 AS post FROM g),
s AS (SELECT h.row, h.col, h.pre, h.post, greatest(avg(n.pre * n.pre) - pow(avg(n.pre), 2), 0) AS vp, greatest(avg(n.post * n.post) - pow(avg(n.post), 2), 0) AS vq FROM h JOIN h n ON n.row BETWEEN h.row - 1 AND h.row + 1 AND n.col BETWEEN h.col - 1 AND h.col + 1 GROUP BY ALL),
x AS (SELECT row, col, 0.4 * abs(post - pre) + 0.6 * least(greatest((vq - vp) / (vp + 1e-4), 0.0), 2.0) / 2 AS score FROM s)
SELECT row, col, round(score, 5) AS score, CASE WHEN score < 0.15 THEN 0 WHEN score < 0.2875 THEN 1 WHEN score < 0.425 THEN 2 WHEN score < 0.5625 THEN 3 WHEN score < 0.7 THEN 4 ELSE 5 END AS grade FROM x""",
)
def structural_damage(spark, sf_dir):
    """Brightness change and relative texture increase of two scenes."""
    from ..operators import kernels as K

    h = grid(spark, sf_dir).select("row", "col", (F.col("value") / 50).alias("pre"), (F.col("value") * (1 + (F.col("row") + F.col("col")) % 3 * 0.2) / 60).alias("post"))
    var = lambda c: F.greatest(F.avg(F.col(c) * F.col(c)) - F.pow(F.avg(c), 2), F.lit(0.0))
    centre = (F.col("dr") == 0) & (F.col("dc") == 0)
    s = N.spread(h, N.offsets(1), "pre", "post", parts=tasks(spark, sf_dir)).groupBy(*N.CELL).agg(F.max(F.when(centre, F.col("pre"))).alias("p"), F.max(F.when(centre, F.col("post"))).alias("q"), var("pre").alias("vp"), var("post").alias("vq")).filter("p IS NOT NULL")
    from ..functions.expr import clip

    score = K.damage_score(F.abs(F.col("q") - F.col("p")), clip((F.col("vq") - F.col("vp")) / (F.col("vp") + 1e-4), 0, 2) / 2)
    return s.withColumn("score", score).select("row", "col", rnd("score", 5).alias("score"), K.damage_grade(F.col("score")).alias("grade"))


@query(
    "hand_flow_neighbours",
    f"""WITH {G} SELECT g.row, g.col, count(*) FILTER (WHERE n.value > g.value) + 1 AS flow, count(*) FILTER (WHERE n.value > g.value) + 1 >= 7 AS channel FROM g {_NEAR.format(h=1)} GROUP BY g.row, g.col""",
)
def hand_flow_neighbours(spark, sf_dir):
    """Higher neighbours of a cell: the elevations of its window side by side, compared within the row."""
    at = lambda a, b: F.max(F.when((F.col("dr") == a) & (F.col("dc") == b), F.col("value")))
    around = {f"v{k}": at(a, b) for k, (a, b) in enumerate(N.offsets(1, centre=False))}
    w = N.spread(grid(spark, sf_dir), N.offsets(1), "value", parts=tasks(spark, sf_dir)).groupBy(*N.CELL).agg(at(0, 0).alias("own"), *(c.alias(k) for k, c in around.items())).filter("own IS NOT NULL")
    flow = sum((F.coalesce((F.col(k) > F.col("own")).cast("long"), F.lit(0)) for k in around), F.lit(1).cast("long"))
    return w.select("row", "col", flow.alias("flow"), (flow >= 7).alias("channel"))


@query(
    "nearest_channel",
    f"""WITH {G}, c AS (SELECT row AS cr, col AS cc, value AS cv FROM g WHERE value < 12),
k AS (SELECT row, col, value, min(struct_pack(d2 := (row - cr) * (row - cr) + (col - cc) * (col - cc), cr := cr, cc := cc, cv := cv)) AS m FROM g LEFT JOIN c ON true GROUP BY row, col, value)
SELECT row, col, CASE WHEN m.cv IS NOT NULL THEN round(greatest(value - m.cv, 0.0) + 1e-9, 5) END AS height, round(sqrt(m.d2), 6) AS distance, CASE WHEN m.cv IS NOT NULL THEN greatest(value - m.cv, 0.0) <= 3 END AS susceptible FROM k""",
)
def nearest_channel(spark, sf_dir):
    """Height over the nearest low cell, however far that is: cells without one nearby look on in rings of twice the width."""
    g = Rounds(spark, "grid")(grid(spark, sf_dir), 0)
    return _over_nearest(spark, g, g.filter("value < 12"))


def _over_nearest(spark, g, points):
    best = N.nearest(g, points, Rounds(spark, "nearest"))
    # greatest() skips nulls
    height = F.when(F.col("at").isNotNull(), F.greatest(F.col("value") - F.col("at.cv"), F.lit(0.0)))
    return best.select("row", "col", rnd(height + 1e-9, 5).alias("height"), rnd(F.sqrt("at.d2")).alias("distance"), (height <= 3).alias("susceptible"))


@query(
    "nearest_drainage",
    f"""WITH {G}, f AS (SELECT g.row, g.col, g.value, count(*) FILTER (WHERE n.value > g.value) + 1 >= 7 AS channel FROM g {_NEAR.format(h=1)} GROUP BY g.row, g.col, g.value),
c AS (SELECT row AS cr, col AS cc, value AS cv FROM f WHERE channel), m AS (SELECT row, col, value, cr, cc, cv, (row - cr) * (row - cr) + (col - cc) * (col - cc) AS d2 FROM g LEFT JOIN c ON true),
k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, cr, cc) AS rn FROM m)
SELECT row, col, CASE WHEN cv IS NOT NULL THEN round(greatest(value - cv, 0.0) + 1e-9, 5) END AS height, round(sqrt(d2), 6) AS distance, CASE WHEN cv IS NOT NULL THEN greatest(value - cv, 0.0) <= 3 END AS susceptible FROM k WHERE rn = 1""",
)
def nearest_drainage(spark, sf_dir):
    """Height of every cell over its nearest drainage cell (flow of 7 or more, as in hand_flow_neighbours), however far that is."""
    g = Rounds(spark, "grid")(grid(spark, sf_dir), 0)
    channels = Rounds(spark, "drainage")(g.join(hand_flow_neighbours(spark, sf_dir).filter("channel").select("row", "col").hint("merge"), ["row", "col"]), 0)
    return _over_nearest(spark, g, channels)


@query(
    "idw_fill",
    f"""WITH {G}, gap AS (SELECT row, col FROM g WHERE (row * 7 + col * 13) % 11 = 0), ok AS (SELECT * FROM g WHERE (row * 7 + col * 13) % 11 <> 0),
m AS (SELECT gap.row, gap.col, ok.value, 1.0 / ((gap.row - ok.row) * (gap.row - ok.row) + (gap.col - ok.col) * (gap.col - ok.col)) AS w, (gap.row - ok.row) * (gap.row - ok.row) + (gap.col - ok.col) * (gap.col - ok.col) AS d2 FROM gap JOIN ok ON abs(gap.row - ok.row) <= 2 AND abs(gap.col - ok.col) <= 2)
SELECT row, col, round(sum(w * value) / sum(w), 5) AS filled, round(exp(-sqrt(min(d2)) / 10), 6) AS confidence FROM m GROUP BY row, col""",
)
def idw_fill(spark, sf_dir):
    """Gaps from valid cells within two cells, weighted by the inverse squared distance."""
    g = grid(spark, sf_dir)
    hole = (F.col("row") * 7 + F.col("col") * 13) % 11 == 0
    near = N.spread(g.filter(~hole), N.offsets(2, centre=False), "value", parts=tasks(spark, sf_dir)).filter((F.col("row") * 7 + F.col("col") * 13) % 11 == 0)
    d2 = F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")
    out = near.groupBy(*N.CELL).agg(rnd(F.sum(F.col("value") / d2) / F.sum(1 / d2), 5).alias("filled"), rnd(F.exp(-F.sqrt(F.min(d2)) / 10)).alias("confidence")).drop("tr", "tc")
    return out.join(g.filter(hole).select("row", "col"), ["row", "col"], "left_semi")


@query(
    "gap_fill_nearest",
    f"""WITH {G}, h AS (SELECT row, col, CASE WHEN (row * 7 + col * 13) % 11 > 2 THEN value END AS value FROM g), ok AS (SELECT * FROM h WHERE value IS NOT NULL),
n AS (SELECT h.row, h.col, min((CAST((h.row - ok.row) * (h.row - ok.row) + (h.col - ok.col) * (h.col - ok.col) AS BIGINT), ok.row, ok.col, ok.value)) AS best FROM h JOIN ok ON ok.row BETWEEN h.row - 12 AND h.row + 12 AND ok.col BETWEEN h.col - 12 AND h.col + 12 WHERE h.value IS NULL GROUP BY h.row, h.col)
SELECT row, col, round(value, 5) AS value, 1.0 AS confidence FROM ok UNION ALL SELECT row, col, round(best[4], 5), round(least(greatest(1 - sqrt(best[1]) / 10, 0.1), 0.8), 6) FROM n""",
)
def gap_fill_nearest(spark, sf_dir):
    """Gaps (three cells in eleven) from the nearest cell that is left, with a confidence that falls with distance."""
    g = grid(spark, sf_dir).withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 13) % 11 > 2, F.col("value")))
    return N.fill_nearest(g, Kept(spark, "gaps")).select("row", "col", rnd("value", 5).alias("value"), rnd("confidence").alias("confidence"))


@query(
    "downsample_avg_mode",
    f"""WITH {G} SELECT ((row + 1) * 10 - 1) // 64 AS brow, ((col + 1) * 10 - 1) // 64 AS bcol, round(avg(value) + 1e-9, 5) AS average, min(value) AS low, max(value) AS high, arg_min(value, (row, col)) AS nearest, count(*) AS n FROM g GROUP BY ALL""",
)
def downsample_avg_mode(spark, sf_dir):
    v = F.col("value")
    return N.downsample(grid(spark, sf_dir), 64, 64, 10, 10, [rnd(F.avg(v) + 1e-9, 5).alias("average"), F.min(v).alias("low"), F.max(v).alias("high"), F.min_by(v, F.struct("row", "col")).alias("nearest"), F.count("*").alias("n")])


@query(
    "mode_downsample",
    """WITH c AS (SELECT l_orderkey // 64 // 8 AS brow, l_partkey % 64 // 8 AS bcol, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT brow, bcol, arg_min(v, (-n, v)) AS mode FROM c GROUP BY ALL""",
)
def mode_downsample(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.expr("l_orderkey div 64 div 8").alias("brow"), F.floor(F.col("l_partkey") % 64 / 8).alias("bcol")).agg(F.mode("l_quantity", True).alias("mode"))


@query("pyramid", f"WITH {G} " + " UNION ALL ".join(f"SELECT {f} AS factor, row // {f} AS prow, col // {f} AS pcol, round(avg(value) + 1e-9, 5) AS value FROM g GROUP BY ALL" for f in (2, 4, 8, 16)))
def pyramid(spark, sf_dir):
    """All levels in one shuffle: each cell is sent to its block of every level."""
    g = grid(spark, sf_dir).withColumn("factor", F.explode(F.array(*(F.lit(f) for f in (2, 4, 8, 16)))))
    return g.groupBy("factor", F.floor(F.col("row") / F.col("factor")).alias("prow"), F.floor(F.col("col") / F.col("factor")).alias("pcol")).agg(rnd(F.avg("value") + 1e-9, 5).alias("value"))


_FLOOD = "m AS (SELECT row, col, row * 2147483648 + col AS key FROM g WHERE value > 26.5)"


@query(
    "connected_components",
    f"""WITH RECURSIVE {G}, {_FLOOD}, e AS (SELECT a.key AS a, b.key AS b FROM m a JOIN m b ON (abs(a.row - b.row) = 1 AND a.col = b.col) OR (a.row = b.row AND abs(a.col - b.col) = 1)),
r AS (SELECT key, key AS label FROM m UNION SELECT e.b, r.label FROM r JOIN e ON r.key = e.a)
, l AS (SELECT key, min(label) AS label FROM r GROUP BY key)
SELECT label, count(*) AS pixels, round(count(*) * 900 / 10000.0, 6) AS area_ha, min(key // 2147483648) AS row_min, max(key // 2147483648) AS row_max FROM l GROUP BY label""",
)
def connected_components(spark, sf_dir):
    """Regions of the flooded cells with their sizes."""
    m = grid(spark, sf_dir).filter("value > 26.5")
    lab = N.components(m, Rounds(spark, "components"))
    return lab.groupBy("label").agg(F.count("*").alias("pixels"), rnd(F.count("*") * 900 / F.lit(10000.0)).alias("area_ha"), F.min("row").alias("row_min"), F.max("row").alias("row_max"))


@query(
    "stripe_detection",
    f"""WITH {G}, r AS (SELECT row, avg(value) AS m FROM g GROUP BY row), z AS (SELECT row, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS z FROM r),
f AS (SELECT row, z, row - row_number() OVER (ORDER BY row) AS k FROM z WHERE abs(z) > 1) SELECT min(row) AS first, max(row) AS last, count(*) AS rows FROM f GROUP BY k HAVING count(*) >= 2""",
)
def stripe_detection(spark, sf_dir):
    """Two or more consecutive rows whose means stand out: runs are components of the flagged rows, so no task sees all rows in order."""
    r = grid(spark, sf_dir).groupBy("row").agg(F.avg("value").alias("m"))
    z = with_global(r, F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd")).filter(F.abs((F.col("m") - F.col("mu")) / F.col("sd")) > 1)
    runs = N.components(z.select("row", F.lit(0).cast("long").alias("col")), Rounds(spark, "stripes"))
    return runs.groupBy("label").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("rows")).filter("rows >= 2").select("first", "last", "rows")


@query(
    "tile_seams",
    f"""WITH {G}, d AS (SELECT g.row, abs(g.value - u.value) AS gr FROM g JOIN g u ON u.row = g.row - 1 AND u.col = g.col), s AS (SELECT avg(gr) FILTER (WHERE row % 16 <> 0) AS mu, stddev_pop(gr) FILTER (WHERE row % 16 <> 0) AS sd FROM d)
SELECT row, round(avg(gr), 5) AS gradient, round((avg(gr) - any_value(mu)) / any_value(sd), 5) AS z FROM d, s WHERE row % 16 = 0 AND row > 0 GROUP BY row""",
)
def tile_seams(spark, sf_dir):
    """Gradients between adjacent rows at tile borders against those inside."""
    d = grid(spark, sf_dir).select("row", "col", "value")
    d = d.select("row", F.abs(F.col("value") - N.previous("value", "row")).alias("gr")).filter("gr IS NOT NULL")
    inner = F.when(F.col("row") % 16 != 0, F.col("gr"))
    d = with_global(d, F.avg(inner).alias("mu"), F.stddev_pop(inner).alias("sd")).filter("row % 16 = 0 AND row > 0")
    return d.groupBy("row").agg(rnd(F.avg("gr"), 5).alias("gradient"), rnd((F.avg("gr") - F.first("mu")) / F.first("sd"), 5).alias("z"))


@query(
    "skill_score",
    f"""WITH {G}, b AS (SELECT row, col, CAST(value > 25 AS INT) AS f, CAST(value + (row % 3) > 26 AS INT) AS o FROM g), n AS (SELECT b.row, b.col, avg(n.f) AS f, avg(n.o) AS o FROM b JOIN b n ON n.row BETWEEN b.row - 1 AND b.row + 1 AND n.col BETWEEN b.col - 1 AND b.col + 1 GROUP BY ALL)
SELECT round(1 - avg(pow(f - o, 2)) / (avg(f * f) + avg(o * o)), 6) AS fss FROM n""",
)
def skill_score(spark, sf_dir):
    """Fractions skill score of exceedance in 3 x 3 windows."""
    b = grid(spark, sf_dir).select("row", "col", (F.col("value") > 25).cast("int").alias("f"), (F.col("value") + F.col("row") % 3 > 26).cast("int").alias("value"))
    centre = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), 1))
    n = N.spread(b, N.offsets(1), "f", "value", parts=tasks(spark, sf_dir)).groupBy(*N.CELL).agg(centre.alias("own"), F.avg("f").alias("f"), F.avg("value").alias("o")).filter("own = 1")
    return n.agg(rnd(1 - F.avg(F.pow(F.col("f") - F.col("o"), 2)) / (F.avg(F.col("f") * F.col("f")) + F.avg(F.col("o") * F.col("o")))).alias("fss"))


@query("dem_spikes", f"WITH {G}, f AS (SELECT g.row, g.col, g.value, avg(n.value) AS mu, stddev_pop(n.value) AS sd FROM g {_NEAR.format(h=1)} GROUP BY g.row, g.col, g.value) SELECT row, col, CASE WHEN value > mu THEN 'spike' ELSE 'pit' END AS kind, round(value - mu + 1e-9, 5) AS off FROM f WHERE abs(value - mu) > 2 * sd")
def dem_spikes(spark, sf_dir):
    centre = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("value")))
    f = N.spread(grid(spark, sf_dir), N.offsets(1), "value", parts=tasks(spark, sf_dir)).groupBy(*N.CELL).agg(centre.alias("v"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")).filter("v IS NOT NULL")
    gap = F.col("v") - F.col("mu")
    return f.filter(F.abs(gap) > 2 * F.col("sd")).select("row", "col", F.when(gap > 0, "spike").otherwise("pit").alias("kind"), rnd(gap + 1e-9, 5).alias("off"))


def _box_std(half: int):
    def kernel(block: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(block)
        x = np.where(ok, block, 0.0)

        def box(a):
            c = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            k = 2 * half + 1
            return c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]

        n = np.maximum(box(ok.astype(float)), 1)
        return np.sqrt(np.maximum(box(x * x) / n - (box(x) / n) ** 2, 0))

    return kernel


@query("focal_std_tiles", f'WITH {G} SELECT g.row AS "row", g.col AS col, round(sqrt(greatest(avg(n.value * n.value) - avg(n.value) * avg(n.value), 0)), 4) AS value FROM g {_NEAR.format(h=4)} GROUP BY g.row, g.col')
def focal_std_tiles(spark, sf_dir):
    """A 9 x 9 window by halo tiles and summed-area tables in an Arrow function a tile."""
    return N.focal_tiles(grid(spark, sf_dir), 4, 16, _box_std(4)).select("row", "col", rnd("value", 4).alias("value"))


@query("unet_tiles")
def unet_tiles(spark, sf_dir):
    """Tiled inference with halo: the stand-in network is two fixed 3 x 3 convolutions and a logistic output."""

    def net(block: np.ndarray) -> np.ndarray:
        x = np.nan_to_num((block - 25.0) / 10.0)
        for _ in range(2):
            x = np.maximum(sum(w * x[1 + a : x.shape[0] - 1 + a, 1 + b : x.shape[1] - 1 + b] for a, b, w in ((0, 0, 0.4), (0, 1, 0.15), (0, -1, 0.15), (1, 0, 0.15), (-1, 0, 0.15))), -1.0)
        return 1 / (1 + np.exp(-4 * x))

    return N.focal_tiles(grid(spark, sf_dir), 2, 16, net).select("row", "col", F.col("value").alias("probability"))
