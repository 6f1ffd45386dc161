"""Quality by sensor, fallbacks, cross-sensor agreement, algorithm selection, task levels and projections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import rnd, steady_sum, utm_zone
from ..functions.storage import Kept, Rounds
from ..operators import assessment as A
from ..operators import focal as N
from ..operators import statistics as S
from .focal_plans import G, grid, tasks
from .registry import query, table

_SCENE = "x AS (SELECT l_suppkey AS scene, l_extendedprice / 100000 AS b0, l_extendedprice / 90000 + l_discount AS b1, l_quantity / 50 AS b2, l_extendedprice / 100000 + l_tax * 2 AS b3, l_linenumber <> 7 AS ok FROM lineitem)"


@query(
    "optical_quality",
    f"""WITH {_SCENE}, p AS (SELECT *, CASE WHEN ok THEN (b0 + b1 + b2) / 3 END AS v FROM x),
f AS (SELECT scene, quantile_cont(v, 0.02) AS vl, quantile_cont(v, 0.98) AS vh, quantile_cont(b1, 0.02) FILTER (WHERE ok) AS bl, quantile_cont(b1, 0.98) FILTER (WHERE ok) AS bh, quantile_cont(b3, 0.02) FILTER (WHERE ok) AS nl, quantile_cont(b3, 0.98) FILTER (WHERE ok) AS nh,
 max(b0) AS m0, max(b1) AS m1, max(b2) AS m2, max(b3) AS m3, avg(b1 / b3) FILTER (WHERE ok AND b3 > 0.01) AS ratio, stddev_pop(v) / (avg(v) + 1e-6) AS contrast FROM p GROUP BY scene),
c AS (SELECT p.*, f.ratio, f.contrast, ok AND ((v - vl) / (vh - vl) > 0.3 OR ((b1 - bl) / (bh - bl) > 0.2 AND (b3 - nl) / (nh - nl) > 0.2)) AS cloud,
 ok AND (CAST(b0 >= m0 * 0.99 AS INT) + CAST(b1 >= m1 * 0.99 AS INT) + CAST(b2 >= m2 * 0.99 AS INT) + CAST(b3 >= m3 * 0.99 AS INT)) >= 2 AS sat FROM p JOIN f USING (scene)),
d AS (SELECT scene, quantile_cont(v, 0.02) FILTER (WHERE ok AND NOT cloud) AS dl, quantile_cont(v, 0.98) FILTER (WHERE ok AND NOT cloud) AS dh FROM c GROUP BY scene),
s AS (SELECT c.*, coalesce(ok AND NOT cloud AND CASE WHEN dh - dl > 1e-6 THEN (v - dl) / (dh - dl) ELSE v END < 0.08, false) AS shadow FROM c JOIN d USING (scene)),
g AS (SELECT scene, 100.0 * count(*) FILTER (WHERE cloud) / count(*) FILTER (WHERE ok) AS cloud, 100.0 * count(*) FILTER (WHERE shadow) / count(*) FILTER (WHERE ok) AS shadow, 100.0 * count(*) FILTER (WHERE sat) / count(*) FILTER (WHERE ok) AS saturation,
 100.0 * count(*) FILTER (WHERE ok AND NOT cloud AND NOT shadow AND NOT sat) / count(*) FILTER (WHERE ok) AS clear, any_value(ratio) AS ratio, any_value(contrast) AS contrast FROM s GROUP BY scene),
h AS (SELECT *, least(greatest(0.6 * least(greatest((ratio - 1) / 0.5, 0), 1) + 0.4 * greatest(0, 1 - 2 * contrast), 0), 1) AS haze FROM g),
k AS (SELECT *, 0.35 * greatest(0, 1 - cloud / 100) + 0.15 * greatest(0, 1 - shadow / 50) + 0.15 * (1 - haze) + 0.10 + 0.10 * greatest(0, 1 - saturation / 10) + 0.15 * clear / 100 AS score FROM h)
SELECT scene, round(cloud, 4) AS cloud, round(shadow, 4) AS shadow, round(saturation, 4) AS saturation, round(clear, 4) AS clear, round(haze, 5) AS haze, round(score, 5) AS score, score >= 0.3 AND cloud <= 80 AND clear >= 20 AS usable FROM k""",
)
def optical_quality(spark, sf_dir):
    """Cloud, shadow, haze and saturation of each supplier's lines taken as a scene of four bands; its last line numbers are not valid."""
    t, price = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    p = t.select(F.col("l_suppkey").alias("scene"), (price / 100000).alias("b0"), (price / 90000 + F.col("l_discount")).alias("b1"), (F.col("l_quantity") / 50).alias("b2"), (price / 100000 + F.col("l_tax") * 2).alias("b3"), (F.col("l_linenumber") != 7).alias("ok"))
    q = A.optical_quality(p, "scene", ["b0", "b1", "b2", "b3"], "b1", "b3", "b3", F.col("ok"))
    return q.select("scene", *(rnd(c, 4).alias(c) for c in ("cloud", "shadow", "saturation", "clear")), *(rnd(c, 5).alias(c) for c in ("haze", "score")), "usable")


@query(
    "sar_looks",
    f"""WITH {G}, e AS (SELECT min(row) + 3 AS r0, max(row) - 3 AS r1, min(col) + 3 AS c0, max(col) - 3 AS c1, avg(value) AS mu, stddev_pop(value) AS sd FROM g),
w AS (SELECT g.row, g.col, avg(n.value) AS mu, stddev_pop(n.value) AS sd, count(*) AS n FROM g JOIN g n ON n.row BETWEEN g.row - 3 AND g.row + 3 AND n.col BETWEEN g.col - 3 AND g.col + 3 GROUP BY g.row, g.col),
l AS (SELECT pow(w.mu / w.sd, 2) AS looks FROM w, e WHERE w.row BETWEEN r0 AND r1 AND w.col BETWEEN c0 AND c1 AND w.n >= 10 AND w.sd > 1e-10 AND w.mu > 1e-10),
m AS (SELECT coalesce(median(looks), 1.0) AS local FROM l WHERE looks > 0.5 AND looks < 100), k AS (SELECT pow(mu / sd, 2) AS whole, local, (pow(mu / sd, 2) + local) / 2 AS looks, sd / mu AS cv FROM e, m)
SELECT round(whole, 5) AS whole, round(local, 5) AS local, round(looks, 5) AS looks, round(cv, 6) AS cv, CASE WHEN looks < 1.5 THEN 'temporal_average' WHEN looks < 3 THEN 'refined_lee' WHEN looks < 5 THEN 'lee' ELSE 'none' END AS filter FROM k""",
)
def sar_looks(spark, sf_dir):
    """Equivalent number of looks: of the whole grid and the median of all 7 x 7 windows that lie inside it, and the filter that it asks for."""
    g = grid(spark, sf_dir)
    ends = g.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("row", "col")), F.avg("value").alias("all_mu"), F.stddev_pop("value").alias("all_sd"))
    w = N.focal(g, 3, [F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n")], parts=tasks(spark, sf_dir)).crossJoin(F.broadcast(ends))  # one row
    inside = F.col("row").between(F.col("low_row") + 3, F.col("high_row") - 3) & F.col("col").between(F.col("low_col") + 3, F.col("high_col") - 3)
    looks = F.when(inside & (F.col("n") >= 10) & (F.col("sd") > 1e-10) & (F.col("mu") > 1e-10), F.pow(F.col("mu") / F.col("sd"), 2))
    kept = Kept(spark, "looks")(w.select(looks.alias("looks")).filter("looks > 0.5 AND looks < 100"))  # quantiles pass over them several times
    local = S.quantiles(kept, "looks", (0.5,)).select(F.coalesce(F.col("q")[0], F.lit(1.0)).alias("local"))
    one = ends.select(F.col("all_mu").alias("mu"), F.col("all_sd").alias("sd")).crossJoin(F.broadcast(local))
    one = one.withColumn("whole", F.pow(F.col("mu") / F.col("sd"), 2)).withColumn("looks", (F.col("whole") + F.col("local")) / 2)
    return one.select(rnd("whole", 5).alias("whole"), rnd("local", 5).alias("local"), rnd("looks", 5).alias("looks"), rnd(F.col("sd") / F.col("mu")).alias("cv"), A.speckle_filter(F.col("looks"))[0].alias("filter"))


@query(
    "sar_fallback",
    """WITH s AS (SELECT l_suppkey AS scene, pow(avg(l_quantity) / stddev_pop(l_quantity), 2) * (1 + l_suppkey % 3) / 2 AS looks, avg(l_discount) * 400 AS layover FROM lineitem GROUP BY l_suppkey),
f AS (SELECT *, CASE WHEN looks < 1.5 THEN 'temporal_average' WHEN looks < 3 THEN 'refined_lee' WHEN looks < 5 THEN 'lee' ELSE 'none' END AS filter FROM s)
SELECT scene, filter, round(looks, 5) AS looks, round(looks * CASE filter WHEN 'temporal_average' THEN 4.0 WHEN 'refined_lee' THEN 3.0 WHEN 'lee' THEN 2.5 ELSE 1.0 END, 5) AS expected, CASE WHEN layover > 20 THEN 'descending' ELSE 'ascending' END AS orbit FROM f""",
)
def sar_fallback(spark, sf_dir):
    """Speckle filter by tiers of looks, and the other orbit where layover is too large."""
    mean, sd = F.avg("l_quantity"), F.stddev_pop("l_quantity")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scene")).agg((F.pow(mean / sd, 2)).alias("raw"), (F.try_divide(steady_sum("l_discount"), F.count("l_discount")) * 400).alias("layover"))
    s = s.withColumn("looks", F.col("raw") * (1 + F.col("scene") % 3) / 2)
    name, expected = A.speckle_filter(F.col("looks"))
    return s.select("scene", name.alias("filter"), rnd("looks", 5).alias("looks"), rnd(expected, 5).alias("expected"), F.when(F.col("layover") > 20, "descending").otherwise("ascending").alias("orbit"))


@query(
    "optical_fallback",
    """WITH s AS (SELECT o_custkey AS event, o_orderkey % 6 AS k, arg_max(o_orderstatus <> 'F', o_orderkey) AS available, CAST(max(o_orderkey) % 100 AS DOUBLE) AS cloud, max(o_orderkey) % 10 / 10 AS quality, CAST(max(o_orderkey) % 300 AS DOUBLE) AS age FROM orders GROUP BY o_custkey, o_orderkey % 6),
b AS (SELECT event, min(struct_pack(k := k, cloud := cloud)) FILTER (WHERE available AND k <= 2 AND age <= 168 AND quality >= 0.3) AS b FROM s GROUP BY event)
SELECT event, CASE WHEN b.cloud < 80 THEN CASE b.k WHEN 0 THEN 'sentinel2' WHEN 1 THEN 'landsat8' ELSE 'landsat9' END END AS source, CASE WHEN b IS NULL OR b.cloud >= 80 THEN 'switch_to_sar' WHEN b.cloud >= 40 THEN 'temporal_composite' ELSE 'proceed' END AS handling FROM b""",
)
def optical_fallback(spark, sf_dir):
    """The source of each customer's event from the state of up to six sources, their latest orders."""
    names = F.array(*(F.lit(s) for s in A.OPTICAL_SOURCES))
    last = F.max("o_orderkey")
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event"), F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("source"))
    s = s.agg(F.max_by(F.col("o_orderstatus") != "F", "o_orderkey").alias("available"), (last % 100).cast("double").alias("cloud"), (last % 10 / 10).alias("quality"), (last % 300).cast("double").alias("age_hours"))
    return A.optical_fallback(s, "event")


@query(
    "dem_fallback",
    """WITH s AS (SELECT o_custkey AS area, o_orderkey % 7 AS k, arg_max(o_orderstatus <> 'F', o_orderkey) AS available, CAST(max(o_orderkey) % 40 AS DOUBLE) AS voids FROM orders GROUP BY o_custkey, o_orderkey % 7),
f AS (SELECT area, k, voids, CASE k WHEN 0 THEN 4.0 WHEN 1 THEN 12.0 WHEN 2 THEN 16.0 ELSE 5.0 END AS error FROM s WHERE available AND k IN (0, 1, 2, 4)),
a AS (SELECT area, arg_min(k, k) AS k, arg_min(voids, k) AS voids, arg_min(error, k) AS error FROM f GROUP BY area),
b AS (SELECT f.area, min(f.k) AS k, arg_min(f.error, f.k) AS error FROM f JOIN a ON f.area = a.area AND f.voids < a.voids GROUP BY f.area),
x AS (SELECT s.area, a.k, a.voids, a.error, b.k AS k2, b.error AS error2 FROM (SELECT DISTINCT area FROM s) s LEFT JOIN a USING (area) LEFT JOIN b USING (area)),
y AS (SELECT *, CASE WHEN k IS NULL OR voids <= 5 THEN 'none' WHEN voids <= 10 THEN 'interpolation' WHEN k2 IS NOT NULL THEN 'blend' ELSE 'morphological' END AS filling FROM x)
SELECT area, CASE k WHEN 0 THEN 'copernicus_30' WHEN 1 THEN 'nasadem' WHEN 2 THEN 'srtm_30' WHEN 4 THEN 'alos_30' END AS source, CASE WHEN filling = 'blend' THEN CASE k2 WHEN 1 THEN 'nasadem' WHEN 2 THEN 'srtm_30' WHEN 4 THEN 'alos_30' END END AS second, filling,
 CASE WHEN k IS NULL THEN 0.0 ELSE 30.0 END AS resolution, CASE WHEN k IS NULL THEN 999.0 WHEN filling = 'blend' THEN greatest(error, error2) ELSE error END AS accuracy,
 round(CASE WHEN k IS NULL THEN 100.0 WHEN filling = 'interpolation' THEN greatest(voids - 8, 0) WHEN filling = 'blend' THEN voids * 0.1 WHEN filling = 'morphological' THEN voids * 0.5 ELSE voids END, 6) AS voids FROM y""",
)
def dem_fallback(spark, sf_dir):
    """Elevation source and void filling of each customer's area, at 16 m of accuracy."""
    names, last = F.array(*(F.lit(d[0]) for d in A.DEM_SOURCES)), F.max("o_orderkey")
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("area"), F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("source"))
    s = s.agg(F.max_by(F.col("o_orderstatus") != "F", "o_orderkey").alias("available"), (last % 40).cast("double").alias("voids"), F.lit(None).cast("double").alias("coverage"))
    return A.dem_fallback(s, "area", accuracy=16.0).withColumn("voids", rnd("voids"))


@query(
    "scene_quality",
    f"""WITH {G}, x AS (SELECT row // 64 AS scene, row % 64 AS r, col AS c, value FROM g),
a AS (SELECT scene, count(*) AS n, avg(value) AS mu, stddev_pop(value) AS sd, avg(value) FILTER (WHERE r BETWEEN 10 AND 53 AND c BETWEEN 10 AND 53) AS mi, stddev_pop(value) FILTER (WHERE r BETWEEN 10 AND 53 AND c BETWEEN 10 AND 53) AS si,
 avg(value) FILTER (WHERE r < 10) AS t, avg(value) FILTER (WHERE r >= 54) AS b, avg(value) FILTER (WHERE c < 10) AS l, avg(value) FILTER (WHERE c >= 54) AS rt, count(*) FILTER (WHERE value > 32) AS clouds FROM x GROUP BY scene),
lr AS (SELECT scene, stddev_pop(m) AS s FROM (SELECT scene, r, avg(value) AS m FROM x GROUP BY scene, r) GROUP BY scene), lc AS (SELECT scene, stddev_pop(m) AS s FROM (SELECT scene, c, avg(value) AS m FROM x GROUP BY scene, c) GROUP BY scene),
d AS (SELECT a.*, coalesce(greatest(abs(t - mi), abs(b - mi), abs(l - mi), abs(rt - mi)) / si, 0) AS off, abs(mu) / sd AS snr, greatest(lr.s, lc.s) / sd AS st, CASE WHEN scene % 7 <> 0 THEN scene % 5 * 20 END AS age FROM a JOIN lr USING (scene) JOIN lc USING (scene)),
e AS (SELECT *, CASE WHEN off > 3 THEN least((off - 3) / 5, 1) ELSE 0 END AS be, CASE WHEN snr < 10 THEN least((10 - snr) / 10, 1) ELSE 0 END AS bn, CASE WHEN st > 0.1 THEN least((st - 0.1) / 0.5, 1) ELSE 0 END AS bs FROM d),
f AS (SELECT scene, n / 4096 AS completeness, 1 - be * 0.2 AS spatial, CASE WHEN age IS NULL THEN 0.7::DOUBLE WHEN age > 30 THEN 1 - 0.5::DOUBLE * least((age - 30) / 60, 1) ELSE 1.0 END AS temporal, (1 - bn * 0.2) * (1 - bs * 0.15) AS radiometric,
 CASE WHEN scene % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0 END * CASE WHEN scene = 0 THEN 0.7::DOUBLE ELSE 1.0 END AS geometric, 1 - clouds / 4096 AS atmospheric, greatest(be, bn, bs) AS worst FROM e),
h AS (SELECT *, 0.25 * completeness + 0.20 * spatial + 0.15 * temporal + 0.20 * radiometric + 0.10 * geometric + 0.10 * atmospheric AS score FROM f)
SELECT scene, round(completeness, 6) AS completeness, round(spatial, 6) AS spatial, round(temporal, 6) AS temporal, round(radiometric, 5) AS radiometric, round(geometric, 6) AS geometric, round(atmospheric, 6) AS atmospheric, round(score, 5) AS score, score >= 0.3 AND completeness >= 0.3 AND worst <= 0.9 AS usable FROM h""",
)
def scene_quality(spark, sf_dir):
    """Six dimensions of each 64 x 64 piece of the grid."""
    x = grid(spark, sf_dir).select(F.expr("row div 64").alias("scene"), (F.col("row") % 64).alias("r"), F.col("col").alias("c"), "value")
    k = F.col("scene")
    facts = x.select("scene").distinct().select("scene", F.when(k % 7 != 0, k % 5 * 20).alias("age_days"), F.when(k % 3 != 0, "EPSG:32631").alias("crs"), (k == 0).alias("at_origin"))
    q = A.scene_quality(x, "scene", facts, 64, F.col("value") > 32)
    return q.select("scene", *(rnd(c).alias(c) for c in ("completeness", "spatial", "temporal")), rnd("radiometric", 5).alias("radiometric"), *(rnd(c).alias(c) for c in ("geometric", "atmospheric")), rnd("score", 5).alias("score"), "usable")


_SENSORS = """o AS (SELECT 's' || (user_id % 5) AS sensor, CASE WHEN user_id % 5 < 2 THEN 'optical' WHEN user_id % 5 < 4 THEN 'sar' ELSE 'thermal' END AS kind, CAST(CAST(ts AS DATE) AS VARCHAR) || '/' || hour(ts) AS cell, ln(1 + avg(value)) / 5 AS data, CAST(count(*) % 7 > 0 AS INT) AS confidence FROM events GROUP BY ALL)"""


@query(
    "cross_sensor",
    f"""WITH {_SENSORS}, c AS (SELECT count(DISTINCT cell) AS cells FROM o), k AS (SELECT * FROM o WHERE confidence > 0),
j AS (SELECT a.sensor AS sensor_a, b.sensor AS sensor_b, a.data AS x, b.data AS y, a.kind AS ka, b.kind AS kb, CASE WHEN a.kind = 'thermal' OR b.kind = 'thermal' THEN 0.1 WHEN a.kind <> b.kind THEN 0.25 WHEN a.kind = 'optical' THEN 0.1 ELSE 0.15 END AS tol FROM k a JOIN k b ON a.cell = b.cell AND a.sensor < b.sensor),
g AS (SELECT sensor_a, sensor_b, ka, kb, count(*) / any_value(cells) AS overlap, corr(x, y) AS corr, avg(x - y) AS bias, sqrt(avg((x - y) * (x - y))) AS rmse, avg(CAST(abs(x - y) <= tol AS DOUBLE)) AS agreement FROM j, c GROUP BY ALL),
r AS (SELECT *, ka <> 'thermal' AND kb <> 'thermal' AS ruled, corr BETWEEN CASE WHEN ka <> kb THEN 0.5 WHEN ka = 'optical' THEN 0.85 ELSE 0.8 END AND CASE WHEN ka <> kb THEN 0.95 ELSE 1.0 END AS cok, abs(bias) <= CASE WHEN ka <> kb THEN 0.15 WHEN ka = 'optical' THEN 0.05 ELSE 0.1 END AS bok FROM g)
SELECT sensor_a, sensor_b, CASE WHEN ka = kb THEN 'redundant' WHEN ruled OR ka = 'optical' OR kb = 'optical' THEN 'complementary' ELSE 'independent' END AS pair_type, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.3 THEN round(corr, 5) END AS corr, CASE WHEN overlap >= 0.3 THEN round(bias, 6) END AS bias, CASE WHEN overlap >= 0.3 THEN round(rmse, 6) END AS rmse,
 CASE WHEN overlap >= 0.3 THEN round(agreement, 6) ELSE 0.0 END AS agreement, CASE WHEN overlap < 0.3 THEN 'insufficient_data' WHEN ruled THEN CASE WHEN agreement >= 0.9 AND cok AND bok THEN 'consistent' WHEN agreement >= 0.7 AND (cok OR bok) THEN 'minor_discrepancy' WHEN agreement >= 0.5 THEN 'significant_discrepancy' ELSE 'conflict' END
 WHEN agreement >= 0.8 THEN 'consistent' WHEN agreement >= 0.6 THEN 'minor_discrepancy' WHEN agreement >= 0.4 THEN 'significant_discrepancy' ELSE 'conflict' END AS outcome FROM r""",
)
def cross_sensor(spark, sf_dir):
    """All pairs of sensors over common hours: overlap gate, correlation, bias, agreement within the rule's tolerance, outcome."""
    o = _observations(spark, sf_dir)
    cells = o.agg(F.count_distinct("cell").alias("cells")).first()["cells"]
    p = A.compare_sensors(o, max(cells, 1))
    return p.select("sensor_a", "sensor_b", "pair_type", rnd("overlap").alias("overlap"), rnd("corr", 5).alias("corr"), rnd("bias").alias("bias"), rnd("rmse").alias("rmse"), rnd("agreement").alias("agreement"), "outcome")


def _observations(spark, sf_dir):
    k = F.col("user_id") % 5
    kind = F.when(k < 2, "optical").when(k < 4, "sar").otherwise("thermal")
    cell = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), F.hour("ts").cast("string"))
    return table(spark, sf_dir, "events").groupBy(F.concat(F.lit("s"), k.cast("string")).alias("sensor"), kind.alias("kind"), cell.alias("cell")).agg((F.log(1 + F.avg("value")) / 5).alias("data"), (F.count("*") % 7 > 0).cast("int").alias("confidence"))


@query(
    "sensor_ranking",
    f"""WITH {_SENSORS}, c AS (SELECT count(DISTINCT cell) AS cells FROM o), k AS (SELECT * FROM o WHERE confidence > 0),
j AS (SELECT a.sensor AS sa, b.sensor AS sb, abs(a.data - b.data) <= CASE WHEN a.kind = 'thermal' OR b.kind = 'thermal' THEN 0.1 WHEN a.kind <> b.kind THEN 0.25 WHEN a.kind = 'optical' THEN 0.1 ELSE 0.15 END AS ok FROM k a JOIN k b ON a.cell = b.cell AND a.sensor < b.sensor),
g AS (SELECT sa, sb, count(*) / any_value(cells) AS overlap, avg(CAST(ok AS DOUBLE)) AS agreement FROM j, c GROUP BY sa, sb), e AS (SELECT sa AS sensor, * FROM g UNION ALL SELECT sb, * FROM g)
SELECT sensor, round(coalesce(avg(agreement) FILTER (WHERE overlap >= 0.3), 0.0), 6) AS score FROM e GROUP BY sensor""",
)
def sensor_ranking(spark, sf_dir):
    o = _observations(spark, sf_dir)
    cells = o.agg(F.count_distinct("cell").alias("cells")).first()["cells"]
    return A.rank_sensors(A.compare_sensors(o, max(cells, 1))).select("sensor", rnd("score").alias("score"))


@query(
    "algorithm_filter",
    """SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0 AND (p_partkey % 13 = 0 OR p_size * 100 <= 2500) AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AND p_size % 4 <> 3""",
)
def algorithm_filter(spark, sf_dir):
    """Algorithms by deprecation, memory (null passes), GPU, determinism and required data types."""
    k, size = F.col("p_partkey"), F.col("p_size")
    required = F.when(size % 4 == 3, F.array(F.lit("optical"), F.lit("lidar"))).when(size % 4 == 2, F.array(F.lit("optical"), F.lit("sar"))).otherwise(F.array(F.lit("sar")))
    a = table(spark, sf_dir, "part").select("p_partkey", (k % 11 == 0).alias("deprecated"), F.when(k % 13 != 0, size * 100).alias("memory_mb"), (k % 7 == 0).alias("gpu_required"), (k % 3 != 0).alias("deterministic"), required.alias("required"))
    return A.usable_algorithms(a, ["optical", "sar", "dem"], 2500, gpu=False, deterministic=True).select("p_partkey")


@query(
    "task_levels",
    """WITH RECURSIVE e AS (SELECT p_partkey AS task, p_partkey // 2 AS needs FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey - 7 FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 7),
r AS (SELECT p_partkey AS task, 0 AS level FROM part UNION SELECT e.task, r.level + 1 FROM r JOIN e ON e.needs = r.task), l AS (SELECT task, max(level) AS level FROM r GROUP BY task)
SELECT task, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (PARTITION BY level ORDER BY task % 10 DESC, task) AS INTEGER) AS place FROM l""",
)
def task_levels(spark, sf_dir):
    """Tasks by level of their dependencies; within a level by priority."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"))
    needs = p.filter("task > 1").select("task", F.expr("task div 2").alias("needs")).union(p.filter("task % 5 = 0 AND task > 7").select("task", F.col("task") - 7))
    lv = A.levels(p, needs, Rounds(spark, "levels"))
    place = F.row_number().over(W.partitionBy("level").orderBy((F.col("task") % 10).desc(), "task"))
    return lv.select("task", "level", place.alias("place"))


_LL = "t AS (SELECT s_suppkey, CAST(s_suppkey * 71 % 340 - 170 AS DOUBLE) AS lon, CAST(s_suppkey * 29 % 110 - 55 AS DOUBLE) AS lat FROM supplier)"


@query(
    "reproject_utm",
    f"""WITH {_LL}, z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone FROM t), c AS (SELECT *, radians(lat) AS p, 6.69437999014e-3 AS e, 6.69437999014e-3 / (1 - 6.69437999014e-3) AS f FROM z),
d AS (SELECT *, 6378137.0 / sqrt(1 - e * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, f * cos(p) * cos(p) AS c, cos(p) * (radians(lon) - radians((zone - 1) * 6 - 177)) AS a,
 6378137.0 * ((1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) * p - (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) * sin(2 * p) + (15 * e * e / 256 + 45 * e * e * e / 1024) * sin(4 * p) - 35 * e * e * e / 3072 * sin(6 * p)) AS m FROM c)
SELECT s_suppkey, zone, round(0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * f) * pow(a, 5) / 120) + 500000, 3) AS easting,
 round(0.9996 * (m + n * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * f) * pow(a, 6) / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS northing,
 round(6378137.0 * radians(lon), 3) AS mercator_x, round(6378137.0 * asinh(tan(p)), 3) AS mercator_y FROM d""",
)
def reproject_utm(spark, sf_dir):
    """Points to UTM and to Web Mercator in closed form."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 71 % 340 - 170).cast("double").alias("lon"), (F.col("s_suppkey") * 29 % 110 - 55).cast("double").alias("lat"))
    plain = (F.floor((F.col("lon") + 180) / 6) + 1).cast("int")
    t = t.withColumn("zone", plain)
    (x, y), (mx, my) = A.utm(F.col("lon"), F.col("lat"), F.col("zone")), A.web_mercator(F.col("lon"), F.col("lat"))
    return t.select("s_suppkey", "zone", rnd(x, 3).alias("easting"), rnd(y, 3).alias("northing"), rnd(mx, 3).alias("mercator_x"), rnd(my, 3).alias("mercator_y"))


@query(
    "reproject_bounds",
    f"""WITH {_LL}, k AS (SELECT s_suppkey, lon, lat, unnest(range(0, 21)) AS k FROM t), p AS (SELECT s_suppkey, lon + 4 * k / 20 AS x, lat AS y FROM k UNION ALL SELECT s_suppkey, lon + 4 * k / 20, lat + 3 FROM k UNION ALL SELECT s_suppkey, lon, lat + 3 * k / 20 FROM k UNION ALL SELECT s_suppkey, lon + 4, lat + 3 * k / 20 FROM k)
SELECT s_suppkey, round(min(6378137.0 * radians(x)), 3) AS west, round(min(6378137.0 * asinh(tan(radians(y)))), 3) AS south, round(max(6378137.0 * radians(x)), 3) AS east, round(max(6378137.0 * asinh(tan(radians(y)))), 3) AS north FROM p GROUP BY s_suppkey""",
)
def reproject_bounds(spark, sf_dir):
    """Bounds of boxes in Web Mercator from 21 points along each edge, within the row."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 71 % 340 - 170).cast("double").alias("w"), (F.col("s_suppkey") * 29 % 110 - 55).cast("double").alias("s"))

    def moved(p):
        x, y = A.web_mercator(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    t = t.select("s_suppkey", F.transform(A.edge_points(F.col("w"), F.col("s"), F.col("w") + 4, F.col("s") + 3), moved).alias("p"))
    end = lambda f, c: rnd(f(F.transform("p", lambda q: q[c])), 3)
    return t.select("s_suppkey", end(F.array_min, "x").alias("west"), end(F.array_min, "y").alias("south"), end(F.array_max, "x").alias("east"), end(F.array_max, "y").alias("north"))


@query(
    "zone_exceptions",
    """WITH t AS (SELECT s_suppkey, CAST(s_suppkey * 7 % 361 - 180 AS DOUBLE) AS lon, CAST(50 + s_suppkey * 3 % 34 AS DOUBLE) AS lat FROM supplier)
SELECT s_suppkey, CAST(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE least(floor((lon + 180) / 6) + 1, 60) END AS INTEGER) AS zone FROM t""",
)
def zone_exceptions(spark, sf_dir):
    """UTM zones of the far north, and of longitude 180."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 361 - 180).cast("double").alias("lon"), (50 + F.col("s_suppkey") * 3 % 34).cast("double").alias("lat"))
    return t.select("s_suppkey", utm_zone(F.col("lon"), F.col("lat")).alias("zone"))


@query("moving_area", f"WITH {G} SELECT g.row, g.col, round(sum(n.value) + 1e-9, 5) AS area, count(*) AS n FROM g JOIN g n ON n.col = g.col AND n.row BETWEEN g.row - 2 AND g.row + 2 GROUP BY g.row, g.col")
def moving_area(spark, sf_dir):
    """A moving sum over five rows of a column, by row number, so that holes count as such."""
    w = W.partitionBy("col").orderBy("row").rangeBetween(-2, 2)
    return grid(spark, sf_dir).select("row", "col", rnd(F.sum("value").over(w) + 1e-9, 5).alias("area"), F.count("value").over(w).alias("n"))


@query("priority_queue", "SELECT event_type AS topic, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY CAST(value AS BIGINT) % 4 DESC, ts, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 20")
def priority_queue(spark, sf_dir):
    """The next twenty messages of each topic by priority, then time (a queue's head is the feature); groups are limited before the shuffle."""
    # rounded as the oracle's cast rounds
    priority = F.rint("value").cast("long") % 4
    place = F.row_number().over(W.partitionBy("event_type").orderBy(priority.desc(), "ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("place", place).filter("place <= 20").select(F.col("event_type").alias("topic"), "event_id", "place")


@query("correction_method", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 2 THEN 'minnaert' WHEN 3 THEN 'c_correction' WHEN 4 THEN 'scs' WHEN 5 THEN 'gamma' ELSE 'cosine' END AS method FROM lineitem")
def correction_method(spark, sf_dir):
    """The correction that is applied for each method asked for: those without one of their own (scs_c, flat_earth) fall through to cosine."""
    names = F.array(*(F.lit(x) for x in ("cosine", "minnaert", "c_correction", "scs", "gamma", "scs_c", "flat_earth")))
    asked = F.get(names, F.col("l_linenumber").cast("int") - 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(asked.isin("scs_c", "flat_earth"), "cosine").otherwise(asked).alias("method"))
