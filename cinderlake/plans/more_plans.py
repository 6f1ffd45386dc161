"""Further scalar, fusion, focal and quality queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import classes, rnd
from ..functions.normal import hmac_sha256, normal_cdf
from ..functions.storage import Rounds
from ..operators import focal as N
from ..operators import statistics as S
from ..operators.kernels import with_global
from .focal_plans import _NEAR, G, grid, tasks
from .fusion_plans import CELL, L, layers
from .kernel_plans import _px, pixels
from .registry import query, table
from .temporal_plans import _DAYS, forecast_pairs


@query("valid_mask", f"WITH {_px('a', 'b')} SELECT vec_id, CASE WHEN a > 0.01 AND vec_id % 7 <> 0 AND NOT (b > 0.3) THEN round(a, 6) END AS value, a > 0.01 AND vec_id % 7 <> 0 AND NOT (b > 0.3) AS valid FROM p")
def valid_mask(spark, sf_dir):
    """Finite, not nodata, not cloud, not shadow."""
    from ..functions.expr import clean

    ok = (F.col("a") > 0.01) & (F.col("vec_id") % 7 != 0) & ~(F.col("b") > 0.3)
    return pixels(spark, sf_dir, "a", "b").select("vec_id", rnd(clean("a", valid=ok)).alias("value"), ok.alias("valid"))


@query("grid_slice", f"WITH {G} SELECT row, col, value FROM g WHERE row BETWEEN 10 AND 20 AND col BETWEEN 5 AND 9")
def grid_slice(spark, sf_dir):
    """An inclusive box of a grid; the filter is on grouping keys and so reaches the scan's aggregate input."""
    return grid(spark, sf_dir).filter(F.col("row").between(10, 20) & F.col("col").between(5, 9))


@query("time_slice", "SELECT event_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def time_slice(spark, sf_dir):
    """Compared in the column's own type, so that the range is pushed to the scan."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").filter(F.col("ts").between(at("2024-01-10 00:00:00"), at("2024-01-12 12:00:00"))).select("event_id", "event_type", "value")


@query("timestamp_parse", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp FROM orders")
def timestamp_parse(spark, sf_dir):
    """Three ways to write a time (ISO, epoch seconds, slashes) parsed back to one; no zone means UTC."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.unix_timestamp("t").cast("string")).otherwise(F.date_format("t", "yyyy/MM/dd"))
    o = o.select("o_orderkey", text.alias("text"))
    parsed = F.coalesce(F.try_to_timestamp("text", F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp("text", F.lit("yyyy/MM/dd")), F.timestamp_seconds(F.col("text").try_cast("long")))
    return o.select("o_orderkey", F.unix_timestamp(parsed).alias("seconds"), F.date_format(parsed, "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


@query("retry_delay", "SELECT event_id, least(2.0 * pow(2, event_id % 8), 60.0) AS delay, CASE WHEN value >= 100 THEN CAST(CAST(floor(value / 10) AS INT) AS VARCHAR) || 'k' ELSE CAST(CAST(floor(value) AS INT) AS VARCHAR) END AS label FROM events")
def retry_delay(spark, sf_dir):
    """Exponential backoff with a cap, and number labels."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.least(2.0 * F.pow(F.lit(2.0), F.col("event_id") % 8), F.lit(60.0)).alias("delay"), F.when(v >= 100, F.format_string("%dk", F.floor(v / 10))).otherwise(F.format_string("%d", F.floor(v))).alias("label"))


@query(
    "colormap",
    "SELECT event_id, CASE WHEN value < 5 THEN 'none' WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'moderate' WHEN value < 150 THEN 'high' ELSE 'extreme' END AS class FROM events",
)
def colormap(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", classes(F.col("value"), (5, 20, 60, 150), ("none", "low", "moderate", "high", "extreme")).alias("class"))


@query(
    "cost_transmittance",
    f"""WITH {_px("blue", "nir")}, d AS (SELECT quantile_cont(blue, 0.01) AS db, quantile_cont(nir, 0.01) AS dn FROM p)
SELECT vec_id, round(greatest(blue - db, 0.0) / cos(radians(30.0)), 6) AS blue, round(greatest(nir - db * pow(0.48 / 0.86, 4), 0.0) / cos(radians(30.0)), 6) AS nir FROM p, d""",
)
def cost_transmittance(spark, sf_dir):
    """Dark-object subtraction with Rayleigh scattering from the blue band, and the cosine transmittance."""
    p = S.with_quantiles(pixels(spark, sf_dir, "blue", "nir"), {"db": ("blue", 0.01)})
    cz = F.cos(F.radians(F.lit(30.0)))
    return p.select("vec_id", rnd(F.greatest(F.col("blue") - F.col("db"), F.lit(0.0)) / cz).alias("blue"), rnd(F.greatest(F.col("nir") - F.col("db") * (0.48 / 0.86) ** 4, F.lit(0.0)) / cz).alias("nir"))


@query(
    "stretch_match",
    f"""WITH {_px("target", "reference")}, q AS (SELECT quantile_cont(target, 0.02) AS tl, quantile_cont(target, 0.98) AS th, quantile_cont(reference, 0.02) AS rl, quantile_cont(reference, 0.98) AS rh FROM p)
SELECT vec_id, round((target - tl) / (th - tl) * (rh - rl) + rl, 6) AS matched FROM p, q""",
)
def stretch_match(spark, sf_dir):
    p = S.with_quantiles(pixels(spark, sf_dir, "target", "reference"), {"tl": ("target", 0.02), "th": ("target", 0.98), "rl": ("reference", 0.02), "rh": ("reference", 0.98)})
    return p.select("vec_id", rnd((F.col("target") - F.col("tl")) / (F.col("th") - F.col("tl")) * (F.col("rh") - F.col("rl")) + F.col("rl")).alias("matched"))


@query(
    "robust_mean",
    f"""WITH {L}, m AS (SELECT user_id, day, list(data) AS x, median(data) AS c FROM V GROUP BY ALL), s AS (SELECT *, greatest(1.4826 * list_median(list_transform(x, lambda v: abs(v - c))), 1e-10) AS s FROM m),
w AS (SELECT *, list_transform(x, lambda v: CASE WHEN abs(v - c) / s <= 1.345 THEN 1.0 ELSE 1.345 / (abs(v - c) / s) END) AS w FROM s)
SELECT user_id, day, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: w[i] * x[i])) / list_sum(w) + 1e-9, 4) AS huber FROM w""",
)
def robust_mean(spark, sf_dir):
    """One Huber reweighting about the median with the MAD as scale."""
    v = layers(spark, sf_dir).filter("quality > 0")
    m = v.groupBy(*CELL).agg(F.median("data").alias("c"))
    v = v.join(m, list(CELL)).withColumn("off", F.abs(F.col("data") - F.col("c")))
    s = v.groupBy(*CELL).agg(F.greatest(1.4826 * F.median("off"), F.lit(1e-10)).alias("s"))
    r = F.col("off") / F.col("s")
    v = v.join(s, list(CELL)).withColumn("w", F.when(r <= 1.345, 1.0).otherwise(1.345 / r))
    return v.groupBy(*CELL).agg(rnd(F.sum(F.col("w") * F.col("data")) / F.sum("w") + 1e-9, 4).alias("huber"))


@query("compound_impact", f"WITH {L} SELECT user_id, day, round(max(data), 6) AS impact, count(*) AS hazards, CAST(CASE WHEN count(*) >= 3 THEN 1.5 WHEN count(*) = 2 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS interaction, round(exp(sum(ln(CASE WHEN data > 20 THEN 0.5 ELSE 0.1 END))), 8) AS probability FROM L GROUP BY ALL")
def compound_impact(spark, sf_dir):
    n = F.count("*")
    return layers(spark, sf_dir).groupBy(*CELL).agg(rnd(F.max("data")).alias("impact"), n.alias("hazards"), F.when(n >= 3, 1.5).when(n == 2, 1.2).otherwise(1.0).alias("interaction"), F.round(F.exp(F.sum(F.log(F.when(F.col("data") > 20, 0.5).otherwise(0.1)))), 8).alias("probability"))


@query(
    "propagate_aggregation",
    f"""WITH {L}, u AS (SELECT *, data * 0.1 AS u, quality + 0.01 AS w FROM L) SELECT user_id, day, round(sqrt(sum(u * u)) / count(*), 6) AS u_mean, round(sqrt(sum(w * w * u * u)) / sum(w), 6) AS u_weighted, round(arg_max(u, (data, -rank)), 6) AS u_max, round(1.253 * sqrt(sum(u * u)) / count(*) + 1e-9, 6) AS u_median FROM u GROUP BY ALL""",
)
def propagate_aggregation(spark, sf_dir):
    """Uncertainty of a mean, weighted mean, maximum and median from those of the inputs."""
    u = layers(spark, sf_dir).withColumn("u", F.col("data") * 0.1).withColumn("w", F.col("quality") + 0.01)
    uu, n = F.col("u") * F.col("u"), F.count("*")
    return u.groupBy(*CELL).agg(rnd(F.sqrt(F.sum(uu)) / n).alias("u_mean"), rnd(F.sqrt(F.sum(F.col("w") * F.col("w") * uu)) / F.sum("w")).alias("u_weighted"), rnd(F.max_by("u", F.struct("data", -F.col("rank")))).alias("u_max"), rnd(1.253 * F.sqrt(F.sum(uu)) / n + 1e-9).alias("u_median"))


@query(
    "scenario_compare",
    f"""WITH {_DAYS}, s AS (SELECT unnest(['low', 'base', 'high']) AS scenario, unnest([0.8, 1.0, 1.25]) AS k) SELECT scenario, round(max(f * k) - min(f * k), 5) AS range, round(stddev_pop(f * k), 5) AS std, round(sum(f * k), 3) AS cumulative, CAST(CASE scenario WHEN 'high' THEN 1 WHEN 'base' THEN 2 ELSE 3 END AS INTEGER) AS rank FROM p, s GROUP BY scenario""",
)
def scenario_compare(spark, sf_dir):
    """Scaled scenarios of a forecast in one pass, ranked by their cumulative amount."""
    kinds = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("k")) for n, k in (("low", 0.8), ("base", 1.0), ("high", 1.25))))
    s = forecast_pairs(spark, sf_dir).select("f", F.explode(kinds).alias("s")).select("s.scenario", (F.col("f") * F.col("s.k")).alias("v"))
    g = s.groupBy("scenario").agg(rnd(F.max("v") - F.min("v"), 5).alias("range"), rnd(F.stddev_pop("v"), 5).alias("std"), rnd(F.sum("v"), 3).alias("cumulative"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.col("cumulative").desc())))


@query("population_estimate", "SELECT n_name AS county, CAST(floor(sum(greatest(c_acctbal, 0)) * least(1.0, 12000 / (count(*) * 1000.0))) AS BIGINT) AS affected FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def population_estimate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("county")).agg(F.floor(F.sum(F.greatest("c_acctbal", F.lit(0.0))) * F.least(F.lit(1.0), 12000 / (F.count("*") * 1000.0))).cast("long").alias("affected"))


@query(
    "directional_autocorr",
    f"""WITH {G}, m AS (SELECT avg(value) AS mu, var_pop(value) AS v FROM g), h AS (SELECT avg((a.value - mu) * (b.value - mu)) / any_value(v) AS r FROM g a JOIN g b ON a.row = b.row AND b.col = a.col + 1, m), w AS (SELECT avg((a.value - mu) * (b.value - mu)) / any_value(v) AS r FROM g a JOIN g b ON a.col = b.col AND b.row = a.row + 1, m)
SELECT round(h.r, 6) AS along_rows, round(w.r, 6) AS along_cols FROM h, w""",
)
def directional_autocorr(spark, sf_dir):
    """Lag-1 autocorrelation along both axes, over pairs of adjacent cells."""
    g = with_global(grid(spark, sf_dir), F.avg("value").alias("mu"), F.var_pop("value").alias("v")).withColumn("x", F.col("value") - F.col("mu"))
    g = g.select("x", "v", N.previous("x", "col").alias("left"), N.previous("x", "row").alias("up"))
    return g.agg(rnd(F.avg(F.col("x") * F.col("left")) / F.first("v")).alias("along_rows"), rnd(F.avg(F.col("x") * F.col("up")) / F.first("v")).alias("along_cols"))


@query(
    "morans_i",
    f"""WITH {G}, m AS (SELECT avg(value) AS mu, var_pop(value) AS v, count(*) AS n FROM g), p AS (SELECT 1 / sqrt((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) AS w, (a.value - mu) * (b.value - mu) AS c FROM g a JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND NOT (a.row = b.row AND a.col = b.col), m)
SELECT round(sum(w * c) / sum(w) / any_value(v), 6) AS morans_i FROM p, m""",
)
def morans_i(spark, sf_dir):
    """Spatial autocorrelation with weights 1/d over the eight neighbours of all cells."""
    g = with_global(grid(spark, sf_dir), F.avg("value").alias("mu"), F.var_pop("value").alias("v"))
    g = g.select("row", "col", (F.col("value") - F.col("mu")).alias("x"), "v")
    near = N.spread(g, N.offsets(1), "x", "v", parts=tasks(spark, sf_dir))
    centre = (F.col("dr") == 0) & (F.col("dc") == 0)
    w = F.when(~centre, 1 / F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")))
    cell = near.groupBy(*N.CELL).agg(F.max(F.when(centre, F.col("x"))).alias("x"), F.max("v").alias("v"), F.sum(w * F.col("x")).alias("wx"), F.sum(w).alias("w")).filter("x IS NOT NULL")
    return cell.agg(rnd(F.sum(F.col("x") * F.col("wx")) / F.sum("w") / F.max("v")).alias("morans_i"))


@query("median_filter", f"WITH {G} SELECT g.row, g.col, round(median(n.value) + 1e-9, 5) AS median FROM g {_NEAR.format(h=1)} GROUP BY g.row, g.col")
def median_filter(spark, sf_dir):
    return N.focal(grid(spark, sf_dir), 1, [rnd(F.median("value") + 1e-9, 5).alias("median")], parts=tasks(spark, sf_dir))


@query("mask_dilation", f"WITH {G}, m AS (SELECT row, col FROM g WHERE value > 32), d AS (SELECT unnest([-1, 0, 1]) AS d), x AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM g) SELECT DISTINCT m.row + a.d AS row, m.col + b.d AS col FROM m, d a, d b, x WHERE m.row + a.d BETWEEN r0 AND r1 AND m.col + b.d BETWEEN c0 AND c1")
def mask_dilation(spark, sf_dir):
    """The mask's neighbours, within the grid's own bounds."""
    g = with_global(grid(spark, sf_dir), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    near = N.spread(g.filter("value > 32"), N.offsets(1), "r0", "r1", "c0", "c1", parts=tasks(spark, sf_dir))
    return near.filter("row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1").select(*N.CELL).distinct().select("row", "col")


@query(
    "gap_regions",
    f"""WITH RECURSIVE {G}, m AS (SELECT row, col, row * 2147483648 + col AS key FROM g WHERE value < 24), e AS (SELECT a.key AS a, b.key AS b FROM m a JOIN m b ON (abs(a.row - b.row) = 1 AND a.col = b.col) OR (a.row = b.row AND abs(a.col - b.col) = 1)),
r AS (SELECT key, key AS label FROM m UNION SELECT e.b, r.label FROM r JOIN e ON r.key = e.a), l AS (SELECT key, min(label) AS label FROM r GROUP BY key)
SELECT label, count(*) AS pixels, min(key // 2147483648) AS row_min, max(key // 2147483648) AS row_max, min(key % 2147483648) AS col_min, max(key % 2147483648) AS col_max FROM l GROUP BY label HAVING count(*) >= 5""",
)
def gap_regions(spark, sf_dir):
    """Components of invalid cells of at least five pixels with their boxes."""
    lab = N.components(grid(spark, sf_dir).filter("value < 24"), Rounds(spark, "gaps"))
    return lab.groupBy("label").agg(F.count("*").alias("pixels"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max")).filter("pixels >= 5")


_FINE = "e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM g), t AS (SELECT unnest(range(2 * r0, 2 * r1 + 1)) AS row, c0, c1 FROM e), f AS (SELECT row, unnest(range(2 * c0, 2 * c1 + 1)) AS col FROM t)"


@query(
    "upsample_bilinear",
    f"""WITH {G}, {_FINE}, s AS (SELECT f.row, f.col, g.value, (1 - abs(f.row / 2 - g.row)) * (1 - abs(f.col / 2 - g.col)) AS w FROM f JOIN (SELECT unnest([-1, 0, 1]) AS a) a ON true JOIN (SELECT unnest([-1, 0, 1]) AS b) b ON true JOIN g ON 2 * g.row = f.row - a.a AND 2 * g.col = f.col - b.b)
SELECT row, col, CASE WHEN sum(w) > 0.999999 THEN round(sum(value * w) + 1e-9, 4) END AS value FROM s GROUP BY row, col""",
)
def upsample_bilinear(spark, sf_dir):
    """The whole grid at twice its resolution, order 1."""
    return N.upsample(grid(spark, sf_dir), 2, parts=tasks(spark, sf_dir)).select("row", "col", rnd(F.col("value") + 1e-9, 4).alias("value"))


@query("upsample_nearest", f"WITH {G}, {_FINE} SELECT f.row, f.col, g.value FROM f JOIN g ON g.row = (f.row + 1) // 2 AND g.col = (f.col + 1) // 2")
def upsample_nearest(spark, sf_dir):
    """The whole grid at twice its resolution, order 0; holes stay holes."""
    return N.upsample(grid(spark, sf_dir), 2, order=0, parts=tasks(spark, sf_dir))


@query(
    "block_score",
    f"""WITH {G}, d AS (SELECT g.col, abs(g.value - l.value) AS gr FROM g JOIN g l ON l.row = g.row AND l.col = g.col - 1) SELECT round(avg(gr) FILTER (WHERE col % 8 = 0) / avg(gr) FILTER (WHERE col % 8 <> 0), 6) AS score FROM d WHERE gr IS NOT NULL""",
)
def block_score(spark, sf_dir):
    d = grid(spark, sf_dir).select("col", F.abs(F.col("value") - N.previous("value", "col")).alias("gr")).filter("gr IS NOT NULL")
    edge = F.col("col") % 8 == 0
    return d.agg(rnd(F.avg(F.when(edge, F.col("gr"))) / F.avg(F.when(~edge, F.col("gr")))).alias("score"))


@query(
    "source_contributions",
    f"""WITH {L}, c AS (SELECT *, avg(data) OVER (PARTITION BY user_id, day) AS agreed FROM V), k AS (SELECT source, (corr(data, agreed) + 1) / 2 * avg(quality) * avg(confidence) AS w FROM c GROUP BY source) SELECT source, round(w / sum(w) OVER (), 6) AS share FROM k""",
)
def source_contributions(spark, sf_dir):
    v = layers(spark, sf_dir).filter("quality > 0")
    c = v.join(v.groupBy(*CELL).agg(F.avg("data").alias("agreed")), list(CELL))
    k = c.groupBy("source").agg(((F.corr("data", "agreed") + 1) / 2 * F.avg("quality") * F.avg("confidence")).alias("w"))
    return with_global(k, F.sum("w").alias("total")).select("source", rnd(F.col("w") / F.col("total")).alias("share"))


@query(
    "sanity_suite",
    """WITH i AS (SELECT event_type AS product, 'range' AS check_name, count(CASE WHEN value > 250 THEN 1 END) AS issues, 'critical' AS severity FROM events GROUP BY 1 UNION ALL SELECT event_type, 'null', count(CASE WHEN value IS NULL THEN 1 END), 'critical' FROM events GROUP BY 1
 UNION ALL SELECT event_type, 'dominant', count(CASE WHEN value < 1 THEN 1 END), 'warning' FROM events GROUP BY 1) SELECT product, count(CASE WHEN issues > 0 THEN 1 END) AS failed, round(avg(1 - least(1.0, CASE severity WHEN 'critical' THEN 0.3 ELSE 0.1 END * CASE WHEN issues > 0 THEN 1 ELSE 0 END)), 6) AS score FROM i GROUP BY product""",
)
def sanity_suite(spark, sf_dir):
    """All checks of a product in one pass over the rows; the issue table is made from the aggregate."""
    v = F.col("value")
    n = lambda c: F.count(F.when(c, 1))
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("product")).agg(n(v > 250).alias("range"), n(v.isNull()).alias("null"), n(v < 1).alias("dominant"))
    issues = a.select("product", F.explode(F.array(*(F.struct(F.col(c).alias("issues"), F.lit(p).alias("penalty")) for c, p in (("range", 0.3), ("null", 0.3), ("dominant", 0.1))))).alias("i"))
    bad = (F.col("i.issues") > 0).cast("int")
    return issues.groupBy("product").agg(F.sum(bad).alias("failed"), rnd(F.avg(1 - F.least(F.lit(1.0), F.col("i.penalty") * bad))).alias("score"))


@query(
    "band_stack",
    """SELECT l_orderkey // 64 AS "row", l_partkey % 64 AS col, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS a, round(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS r FROM lineitem GROUP BY ALL""",
)
def band_stack(spark, sf_dir):
    """Bands stacked on their cells by a pivot with named bands."""
    t = table(spark, sf_dir, "lineitem")
    p = t.groupBy(F.expr("l_orderkey div 64").alias("row"), (F.col("l_partkey") % 64).alias("col")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_quantity"), 6))
    return p.select("row", "col", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("return_period")
def return_period(spark, sf_dir):
    """Return period of a month's anomaly by the normal distribution, capped at 10 000 years."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("month"))
    b = o.groupBy("month").agg(F.avg("o_totalprice").alias("mu"), F.stddev_pop("o_totalprice").alias("sd"))
    z = o.join(b, "month").select("o_orderkey", ((F.col("o_totalprice") - F.col("mu")) / F.col("sd")).alias("z"))
    p = 1 - normal_cdf("z")
    return z.select("o_orderkey", "z", p.alias("p")).select("o_orderkey", rnd("z").alias("z"), F.least(F.when(F.col("p") > 1e-12, 1 / (F.col("p") * 12)).otherwise(10000.0), F.lit(10000.0)).alias("years"))


@query("threshold_decision")
def threshold_decision(spark, sf_dir):
    """Probability that a value with a standard deviation is over a threshold."""
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 50) / (F.col("value") * 0.1 + 1)).alias("z"))
    return e.select("event_id", rnd(normal_cdf("z")).alias("probability")).withColumn("decided", (F.col("probability") > 0.95) | (F.col("probability") < 0.05))


@query("webhook_signature")
def webhook_signature(spark, sf_dir):
    """HMAC-SHA256 of event payloads."""
    return table(spark, sf_dir, "events").select("event_id", hmac_sha256("shared secret")(F.concat_ws(".", F.col("event_id").cast("string"), "props")).alias("signature"))


@query("custom_statistic", "SELECT event_type, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS spread FROM events GROUP BY event_type")
def custom_statistic(spark, sf_dir):
    """A statistic that the user composes of built-in aggregates."""

    def spread(c):
        return F.percentile(c, F.lit(0.9)) - F.percentile(c, F.lit(0.1))

    return table(spark, sf_dir, "events").groupBy("event_type").agg(rnd(spread("value")).alias("spread"))


@query("tile_neighbours", "WITH t AS (SELECT n_nationkey % 5 AS r, n_nationkey // 5 AS c FROM nation), d AS (SELECT unnest([-1, 0, 1]) AS d) SELECT t.r, t.c, t.r + a.d AS nr, t.c + b.d AS nc FROM t, d a, d b WHERE abs(a.d) + abs(b.d) > 0 AND t.r + a.d BETWEEN 0 AND 4 AND t.c + b.d BETWEEN 0 AND 4")
def tile_neighbours(spark, sf_dir):
    """Eight neighbours of each tile by a table function."""

    class Around:
        def eval(self, r: int, c: int):
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (a or b) and 0 <= r + a <= 4 and 0 <= c + b <= 4:
                        yield r + a, c + b

    around = F.udtf(Around, returnType="nr int, nc int")
    spark.udtf.register("cinderlake_around", around)
    table(spark, sf_dir, "nation").selectExpr("n_nationkey % 5 AS r", "n_nationkey div 5 AS c").createOrReplaceTempView("cinderlake_tiles")
    return spark.sql("SELECT t.r, CAST(t.c AS INT) AS c, nr, nc FROM cinderlake_tiles t, LATERAL cinderlake_around(t.r, CAST(t.c AS INT))")
