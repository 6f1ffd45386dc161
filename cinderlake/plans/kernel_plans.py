"""Detection kernels over surrogate pixel tables.

``embeddings`` are band pixels (band b is the size of component b); ``events`` give backscatter as -value / 20 dB; ``lineitem`` gives temperatures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clip, rnd
from ..operators import kernels as K
from ..operators import statistics as S
from .registry import query, table


def pixels(spark: SparkSession, sf_dir: str, *bands: str) -> DataFrame:
    """vec_id, label and the named bands: absolute values of the first components, so that sums are positive."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.abs(e["embedding"][k].cast("double")).alias(b) for k, b in enumerate(bands)))


def _px(*bands: str) -> str:
    return "p AS (SELECT vec_id, label, " + ", ".join(f"abs(CAST(embedding[{k + 1}] AS DOUBLE)) AS {b}" for k, b in enumerate(bands)) + " FROM embeddings)"


_ND = "least(greatest(CASE WHEN {a} + {b} > 1e-6 THEN ({a} - {b}) / ({a} + {b}) END, -1.0), 1.0)"


def _nd(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 1e-6 THEN least(greatest(({a} - {b}) / ({a} + {b}), -1.0), 1.0) END"


@query(
    "ndwi_flood",
    f"""WITH {_px("green", "nir")}, n AS (SELECT vec_id, {_nd("green", "nir")} AS ndwi FROM p)
SELECT vec_id, round(ndwi, 6) AS ndwi, ndwi > 0 AS flood, round(least(greatest(0.5 + 0.5 * ndwi, 0.0), 1.0), 6) AS confidence FROM n WHERE ndwi IS NOT NULL""",
)
def ndwi_flood(spark, sf_dir):
    """Water by NDWI > 0 with its confidence; band sizes are used, since components may be negative."""
    n = pixels(spark, sf_dir, "green", "nir").select("vec_id", K.normalised_difference(F.col("green"), F.col("nir")).alias("ndwi")).filter("ndwi IS NOT NULL")
    flood, conf = K.ndwi_flood(F.col("ndwi"))
    return n.select("vec_id", rnd("ndwi").alias("ndwi"), flood.alias("flood"), rnd(conf).alias("confidence"))


@query(
    "ndwi_change",
    f"""WITH {_px("g0", "n0", "g1", "n1")}, n AS (SELECT vec_id, {_nd("g0", "n0")} AS pre, {_nd("g1", "n1")} AS post FROM p)
SELECT vec_id, round(post - pre, 6) AS delta, post - pre > 0.2 AND post > 0 AS flood FROM n WHERE pre IS NOT NULL AND post IS NOT NULL""",
)
def ndwi_change(spark, sf_dir):
    p = pixels(spark, sf_dir, "g0", "n0", "g1", "n1")
    n = p.select("vec_id", K.normalised_difference(F.col("g0"), F.col("n0")).alias("pre"), K.normalised_difference(F.col("g1"), F.col("n1")).alias("post")).dropna()
    return n.select("vec_id", rnd(F.col("post") - F.col("pre")).alias("delta"), ((F.col("post") - F.col("pre") > 0.2) & (F.col("post") > 0)).alias("flood"))


@query(
    "flood_stats",
    f"""WITH {_px("green", "nir")}, n AS (SELECT label, {_nd("green", "nir")} AS ndwi FROM p)
SELECT label, count(CASE WHEN ndwi > 0 THEN 1 END) AS pixels, round(count(CASE WHEN ndwi > 0 THEN 1 END) * 100.0 / 10000, 6) AS area_ha,
 round(100.0 * count(CASE WHEN ndwi > 0 THEN 1 END) / nullif(count(ndwi), 0), 6) AS percent,
 round(avg(CASE WHEN ndwi > 0 THEN least(greatest(0.5 + 0.5 * ndwi, 0.0), 1.0) END), 6) AS mean_confidence FROM n GROUP BY label""",
)
def flood_stats(spark, sf_dir):
    n = pixels(spark, sf_dir, "green", "nir").select("label", K.normalised_difference(F.col("green"), F.col("nir")).alias("ndwi"))
    flood, conf = K.ndwi_flood(F.col("ndwi"))
    return K.area_stats(n, flood, conf, 10.0, "label")


@query(
    "sar_threshold",
    """WITH s AS (SELECT event_id, -value / 20 AS db FROM events)
SELECT event_id, round(db, 6) AS db, db < -15 AS flood, round(least(greatest((-15 - db) / 15, 0.0), 1.0), 6) AS confidence FROM s""",
)
def sar_threshold(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("event_id", (-F.col("value") / 20).alias("db"))
    flood, conf = K.sar_flood(F.col("db"))
    return s.select("event_id", rnd("db").alias("db"), flood.alias("flood"), rnd(conf).alias("confidence"))


@query(
    "sar_change",
    """WITH s AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN -value / 20 END) AS pre, avg(CASE WHEN event_type = 'purchase' THEN -value / 20 END) AS post FROM events GROUP BY user_id)
SELECT user_id, round(pre, 6) AS pre, round(post, 6) AS post, post < -6 AND pre - post > 1 AS flood,
 round((least(greatest((-6 - post) / 6, 0.0), 1.0) + least(greatest((pre - post) / 3, 0.0), 1.0)) / 2, 6) AS confidence
FROM s WHERE pre IS NOT NULL AND post IS NOT NULL""",
)
def sar_change(spark, sf_dir):
    """Both scenes come from one pass: pre and post are conditional means of a cell."""
    db = -F.col("value") / 20
    kind = lambda k: F.avg(F.when(F.col("event_type") == k, db))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(kind("view").alias("pre"), kind("purchase").alias("post")).dropna()
    flood, conf = K.sar_change(F.col("pre"), F.col("post"), -6.0, 1.0)
    return s.select("user_id", rnd("pre").alias("pre"), rnd("post").alias("post"), flood.alias("flood"), rnd(conf).alias("confidence"))


@query(
    "change_detection",
    f"""WITH {_px("pre", "post")}, c AS (SELECT vec_id, post - pre AS diff, post / CASE WHEN abs(pre) < 1e-6 THEN 1e-6 ELSE pre END AS ratio,
  CASE WHEN post + pre > 1e-6 THEN (post - pre) / (post + pre) END AS nd FROM p),
m AS (SELECT *, avg(diff) OVER () AS mu, stddev_pop(diff) OVER () AS sd FROM c),
k AS (SELECT *, least(greatest(diff, mu - 3 * sd), mu + 3 * sd) AS clipped FROM m)
SELECT vec_id, round(clipped, 6) AS clipped, round(ratio, 4) AS ratio, round(nd, 6) AS nd, abs(clipped) > 0.15 AS changed,
 round(least(greatest(abs(clipped) / 0.15, 0.0), 1.0), 6) AS confidence, ratio < 0.85 AS sar_dark FROM k""",
)
def change_detection(spark, sf_dir):
    """Difference, ratio and normalised difference; the difference is clamped at 3 sigma of the scene."""
    p = pixels(spark, sf_dir, "pre", "post")
    c = p.select("vec_id", *(K.change_magnitude(F.col("pre"), F.col("post"), m).alias(n) for m, n in (("difference", "diff"), ("ratio", "ratio"), ("normalised", "nd"))))
    m = K.with_global(c, F.avg("diff").alias("mu"), F.stddev_pop("diff").alias("sd"))
    k = m.withColumn("clipped", F.least(F.greatest("diff", F.col("mu") - 3 * F.col("sd")), F.col("mu") + 3 * F.col("sd")))
    return k.select("vec_id", rnd("clipped").alias("clipped"), rnd("ratio", 4).alias("ratio"), rnd("nd").alias("nd"), (F.abs("clipped") > 0.15).alias("changed"), rnd(clip(F.abs("clipped") / 0.15, 0, 1)).alias("confidence"), (F.col("ratio") < 0.85).alias("sar_dark"))


@query(
    "multiband_change",
    """WITH c AS (SELECT vec_id, label, list_transform(range(1, 33), lambda i: abs(CAST(embedding[i + 32] AS DOUBLE)) - abs(CAST(embedding[i] AS DOUBLE))) AS d FROM embeddings)
SELECT vec_id, round(list_sum(d) / 32, 6) AS mean_change, abs(list_sum(d) / 32) > 0.01 AS changed FROM c""",
)
def multiband_change(spark, sf_dir):
    """Mean change over bands: the first half of a vector is the earlier scene, the second half the later one."""
    e = F.col("embedding")
    d = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.abs(F.get(e, i + 32).cast("double")) - F.abs(F.get(e, i).cast("double")))
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / 32
    return table(spark, sf_dir, "embeddings").select("vec_id", mean.alias("m")).select("vec_id", rnd("m").alias("mean_change"), (F.abs("m") > 0.01).alias("changed"))


_DNBR = f"""WITH {_px("n0", "s0", "n1", "s1")}, n AS (SELECT vec_id, {_nd("n0", "s0")} - ({_nd("n1", "s1")}) AS dnbr FROM p),
c AS (SELECT *, CASE WHEN dnbr < -0.10 THEN 1 WHEN dnbr < 0.10 THEN 0 WHEN dnbr < 0.27 THEN 2 WHEN dnbr < 0.44 THEN 3 WHEN dnbr < 0.66 THEN 4 WHEN dnbr >= 0.66 THEN 5 END AS severity FROM n)"""


def _burn(spark, sf_dir):
    p = pixels(spark, sf_dir, "n0", "s0", "n1", "s1")
    d = K.normalised_difference(F.col("n0"), F.col("s0")) - K.normalised_difference(F.col("n1"), F.col("s1"))
    return p.select("vec_id", d.alias("dnbr")).withColumn("severity", K.severity(F.col("dnbr")))


@query(
    "dnbr_severity",
    f"""{_DNBR} SELECT vec_id, round(dnbr, 6) AS dnbr, severity, dnbr > 0.10 AS burned,
 round(CASE WHEN dnbr > 0.10 THEN least(greatest(0.5 + 0.5 * (dnbr - 0.10) / (0.66 - 0.10), 0.5), 1.0) ELSE least(greatest(0.5 + 0.5 * (0.10 - dnbr) / 0.3, 0.0), 1.0) END, 6) AS confidence
 FROM c WHERE dnbr IS NOT NULL""",
)
def dnbr_severity(spark, sf_dir):
    d = F.col("dnbr")
    return _burn(spark, sf_dir).filter("dnbr IS NOT NULL").select("vec_id", rnd("dnbr").alias("dnbr"), "severity", (d > 0.10).alias("burned"), rnd(K.burn_confidence(d)).alias("confidence"))


@query(
    "burn_stats",
    f"""{_DNBR} SELECT coalesce(severity, 0) AS severity, count(*) AS pixels, round(count(*) * 900 / 10000.0, 6) AS area_ha FROM c GROUP BY coalesce(severity, 0)""",
)
def burn_stats(spark, sf_dir):
    """Class 0 counts invalid cells too."""
    return _burn(spark, sf_dir).groupBy(F.coalesce("severity", F.lit(0)).alias("severity")).agg(F.count("*").alias("pixels"), rnd(F.count("*") * 900 / F.lit(10000.0)).alias("area_ha"))


@query(
    "fire_simple_frp",
    """WITH t AS (SELECT l_orderkey, l_linenumber, 280 + l_quantity * 2 AS kelvin FROM lineitem),
b AS (SELECT coalesce(median(CASE WHEN kelvin <= 320 THEN kelvin END), 300) AS background FROM t)
SELECT l_orderkey, l_linenumber, kelvin, round(least(greatest((kelvin - 330) / 30, 0.0), 1.0), 6) AS confidence,
 round(greatest(0.0, 1000.0 * 1000.0 * 5.67e-8 * 0.98 * (pow(kelvin, 4) - pow(background, 4)) / 1e6), 4) AS frp_mw
FROM t, b WHERE kelvin > 320""",
)
def fire_simple_frp(spark, sf_dir):
    """Fire over 320 K and its radiative power over the median of the non-fire cells."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (280 + F.col("l_quantity") * 2).alias("kelvin"))
    fire, conf = K.simple_fire(F.col("kelvin"))
    t = S.with_median(t, F.when(~fire, F.col("kelvin")), "background", 300.0)
    return t.filter(fire).select("l_orderkey", "l_linenumber", "kelvin", rnd(conf).alias("confidence"), rnd(K.fire_power(F.col("kelvin"), F.col("background"), 1000.0), 4).alias("frp_mw"))


@query(
    "fire_stats",
    """WITH t AS (SELECT l_returnflag, 280 + l_quantity * 2 AS kelvin FROM lineitem),
b AS (SELECT coalesce(median(CASE WHEN kelvin <= 320 THEN kelvin END), 300) AS background FROM t),
f AS (SELECT *, greatest(0.0, 1000.0 * 1000.0 * 5.67e-8 * 0.98 * (pow(kelvin, 4) - pow(background, 4)) / 1e6) AS frp FROM t, b)
SELECT l_returnflag, count(CASE WHEN kelvin > 320 THEN 1 END) AS fires, round(count(CASE WHEN kelvin > 320 THEN 1 END) * 100.0, 2) AS area_ha,
 round(sum(CASE WHEN kelvin > 320 THEN frp END), 1) AS total_frp, round(avg(CASE WHEN kelvin > 320 THEN frp END), 4) AS mean_frp, round(max(CASE WHEN kelvin > 320 THEN frp END), 4) AS max_frp,
 max(CASE WHEN kelvin > 320 THEN kelvin END) AS max_kelvin, round(avg(CASE WHEN kelvin > 320 THEN kelvin END), 6) AS mean_kelvin, round(avg(CASE WHEN kelvin <= 320 THEN kelvin END), 6) AS mean_background
FROM f GROUP BY l_returnflag""",
)
def fire_stats(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", (280 + F.col("l_quantity") * 2).alias("kelvin"))
    k = F.col("kelvin")
    t = S.with_median(t, F.when(k <= K.FIRE_K, k), "background", 300.0)
    t = t.withColumn("frp", K.fire_power(k, F.col("background"), 1000.0))
    fire = lambda c: F.when(k > K.FIRE_K, c)
    n = F.count(fire(F.lit(1)))
    return t.groupBy("l_returnflag").agg(
        n.alias("fires"), rnd(n * 100.0, 2).alias("area_ha"), rnd(F.sum(fire(F.col("frp"))), 1).alias("total_frp"), rnd(F.avg(fire(F.col("frp"))), 4).alias("mean_frp"),
        rnd(F.max(fire(F.col("frp"))), 4).alias("max_frp"), F.max(fire(k)).alias("max_kelvin"), rnd(F.avg(fire(k))).alias("mean_kelvin"), rnd(F.avg(F.when(k <= K.FIRE_K, k))).alias("mean_background"),
    )


@query(
    "brightness_temperature",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS radiance FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1.4387774e4 / (11.0 * ln(1.191042e8 / (161051.0 * radiance) + 1)), 4) AS kelvin FROM t WHERE radiance > 0""",
)
def brightness_temperature(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    return t.select("l_orderkey", "l_linenumber", rnd(K.brightness_temperature(F.col("l_quantity") / 10, 11.0), 4).alias("kelvin"))


@query(
    "spectral_indices",
    f"""WITH {_px("blue", "red", "nir", "swir1", "swir2")}
SELECT vec_id, round({_nd("nir", "swir2")}, 6) AS nbr, round({_nd("nir", "red")}, 6) AS ndvi, round(least(greatest(1 / (pow(0.1 - red, 2) + pow(0.06 - nir, 2) + 1e-10), 0.0), 1000.0), 4) AS bai,
 round(10 * swir2 - 9.8 * swir1 + 2, 6) AS mirbi, round({_nd("swir2", "nir")}, 6) AS nbr2,
 round(CASE WHEN nir + 6 * red - 7.5 * blue + 1 <> 0 THEN least(greatest(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1), -1.0), 1.0) END, 6) AS evi FROM p""",
)
def spectral_indices(spark, sf_dir):
    p = pixels(spark, sf_dir, "blue", "red", "nir", "swir1", "swir2")
    made = K.spectral_indices(*(F.col(b) for b in ("blue", "red", "nir", "swir1", "swir2")))
    return p.select("vec_id", *(rnd(c, 4 if k == "bai" else 6).alias(k) for k, c in made.items()))


@query(
    "centroid_classifier",
    f"""WITH {_px("f0", "f1", "f2")}, t AS (SELECT *, label < 5 AS burned FROM p),
m AS (SELECT {", ".join(f"avg({f}) FILTER (WHERE burned) AS b_{f}, avg({f}) FILTER (WHERE NOT burned) AS u_{f}, stddev_pop({f}) AS s_{f}" for f in ("f0", "f1", "f2"))} FROM t),
w AS (SELECT *, {", ".join(f"abs(b_{f} - u_{f}) / (s_{f} + 1e-6) AS g_{f}" for f in ("f0", "f1", "f2"))} FROM m),
d AS (SELECT vec_id, sqrt({" + ".join(f"g_{f} / (g_f0 + g_f1 + g_f2) * pow((t.{f} - b_{f}) / (s_{f} + 1e-6), 2)" for f in ("f0", "f1", "f2"))}) AS db,
 sqrt({" + ".join(f"g_{f} / (g_f0 + g_f1 + g_f2) * pow((t.{f} - u_{f}) / (s_{f} + 1e-6), 2)" for f in ("f0", "f1", "f2"))}) AS du FROM t, w)
SELECT vec_id, round(1 - db / (db + du + 1e-6), 6) AS probability, 1 - db / (db + du + 1e-6) > 0.5 AS burned FROM d""",
)
def centroid_classifier(spark, sf_dir):
    """Two class centroids; features are weighted by how well they separate the classes."""
    names = ("f0", "f1", "f2")
    t = pixels(spark, sf_dir, *names).withColumn("burned", F.col("label") < 5)
    aggs = [a for f in names for a in (F.avg(F.when(F.col("burned"), F.col(f))).alias(f"b_{f}"), F.avg(F.when(~F.col("burned"), F.col(f))).alias(f"u_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    t = K.with_global(t, *aggs)
    gain = {f: F.abs(F.col(f"b_{f}") - F.col(f"u_{f}")) / (F.col(f"s_{f}") + 1e-6) for f in names}
    total = sum(gain.values())

    def distance(side):
        return F.sqrt(sum(gain[f] / total * F.pow((F.col(f) - F.col(f"{side}_{f}")) / (F.col(f"s_{f}") + 1e-6), 2) for f in names))

    t = t.select("vec_id", distance("b").alias("db"), distance("u").alias("du"))
    p = 1 - F.col("db") / (F.col("db") + F.col("du") + 1e-6)
    return t.select("vec_id", rnd(p).alias("probability"), (p > 0.5).alias("burned"))


@query(
    "wind_damage",
    f"""WITH {_px("n0", "r0", "n1", "r1")}, v AS (SELECT vec_id, {_nd("n0", "r0")} AS pre, {_nd("n1", "r1")} AS post FROM p)
SELECT vec_id, pre >= 0.3 AND post - pre <= -0.2 AS damaged, CASE WHEN pre >= 0.3 AND post - pre <= -0.1 THEN CASE WHEN post - pre <= -0.4 THEN 3 WHEN post - pre <= -0.2 THEN 2 ELSE 1 END ELSE 0 END AS severity,
 round(0.7 * least(greatest(-(post - pre) / 0.4, 0.0), 1.0) + 0.3 * least(greatest((pre - 0.1) / 0.9, 0.0), 1.0), 6) AS confidence FROM v WHERE pre IS NOT NULL AND post IS NOT NULL""",
)
def wind_damage(spark, sf_dir):
    p = pixels(spark, sf_dir, "n0", "r0", "n1", "r1")
    v = p.select("vec_id", K.normalised_difference(F.col("n0"), F.col("r0")).alias("pre"), K.normalised_difference(F.col("n1"), F.col("r1")).alias("post")).dropna()
    made = K.wind_damage(F.col("pre"), F.col("post"))
    return v.select("vec_id", made["damaged"].alias("damaged"), made["severity"].alias("severity"), rnd(made["confidence"]).alias("confidence"))


@query(
    "reflectance_scaling",
    """WITH b AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice AS v, max(l_extendedprice) OVER (PARTITION BY l_returnflag) AS top FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber, round(CASE WHEN top > 1 THEN v / 10000 ELSE v END, 6) AS reflectance FROM b""",
)
def reflectance_scaling(spark, sf_dir):
    """A band whose largest value is over 1 is divided by 10 000: band maxima are a small table."""
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    top = t.groupBy("l_returnflag").agg(F.max("v").alias("top"))
    return t.join(top, "l_returnflag").select("l_returnflag", "l_orderkey", "l_linenumber", rnd(F.when(F.col("top") > 1, F.col("v") / 10000).otherwise(F.col("v"))).alias("reflectance"))


@query(
    "dos",
    """WITH d AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS dark FROM lineitem GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, l.l_returnflag, round(greatest(l_extendedprice - dark, 0.0), 4) AS corrected FROM lineitem l JOIN d ON l.l_returnflag = d.l_returnflag""",
)
def dos(spark, sf_dir):
    """Dark-object subtraction with the first percentile of each band."""
    t = table(spark, sf_dir, "lineitem")
    dark = S.quantiles(t, "l_extendedprice", [0.01], "l_returnflag").select("l_returnflag", F.col("q")[0].alias("dark"))
    return t.join(F.broadcast(dark), "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag", rnd(F.greatest(F.col("l_extendedprice") - F.col("dark"), F.lit(0.0)), 4).alias("corrected"))


@query(
    "relative_norm",
    f"""WITH {_px("target", "reference")}, m AS (SELECT avg(target) AS tm, stddev_pop(target) AS ts, avg(reference) AS rm, stddev_pop(reference) AS rs FROM p)
SELECT vec_id, round((target - tm) / ts * rs + rm, 6) AS normalised FROM p, m""",
)
def relative_norm(spark, sf_dir):
    p = pixels(spark, sf_dir, "target", "reference")
    p = K.with_global(p, *(a(c).alias(f"{c}_{n}") for c in ("target", "reference") for n, a in (("m", F.avg), ("s", F.stddev_pop))))
    return p.select("vec_id", rnd((F.col("target") - F.col("target_m")) / F.col("target_s") * F.col("reference_s") + F.col("reference_m")).alias("normalised"))


@query(
    "pif_regression",
    f"""WITH {_px("target", "reference")}, f AS (SELECT regr_slope(reference, target) AS a, regr_intercept(reference, target) AS b, count(*) AS n FROM p WHERE abs(target - reference) < 0.1)
SELECT vec_id, round(a * target + b, 6) AS normalised, n AS invariant FROM p, f""",
)
def pif_regression(spark, sf_dir):
    """Pseudo-invariant features: cells that hardly differ give the gain and offset for all."""
    p = pixels(spark, sf_dir, "target", "reference")
    fit = p.filter("abs(target - reference) < 0.1").agg(F.regr_slope("reference", "target").alias("a"), F.regr_intercept("reference", "target").alias("b"), F.count("*").alias("n"))
    return p.crossJoin(F.broadcast(fit)).select("vec_id", rnd(F.col("a") * F.col("target") + F.col("b")).alias("normalised"), F.col("n").alias("invariant"))


_ILL = "least(greatest(cos(radians(slope)) * cos(radians(40.0)) + sin(radians(slope)) * sin(radians(40.0)) * cos(radians(150.0 - aspect)), 0.001), 1.0)"


@query(
    "terrain_correction",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100000 AS v, l_quantity AS slope, l_suppkey % 360 AS aspect FROM lineitem),
i AS (SELECT *, {_ILL} AS ill FROM t)
SELECT l_orderkey, l_linenumber, round(v * cos(radians(40.0)) / ill, 4) AS cosine, round(v * pow(cos(radians(40.0)) / ill, 0.5), 4) AS minnaert,
 round(v * (cos(radians(40.0)) + 0.5) / (ill + 0.5), 6) AS c_correction, round(v * cos(radians(slope)) * cos(radians(40.0)) / ill, 4) AS scs,
 CASE WHEN ill <= 0.001 THEN 0.0 WHEN slope > 40 THEN 0.3 WHEN v * cos(radians(40.0)) / ill > 2 * v THEN 0.5 ELSE 1.0 END AS quality FROM i""",
)
def terrain_correction(spark, sf_dir):
    """Illumination of a slope and the corrections by it; sun at zenith 40 and azimuth 150 degrees."""
    zenith, azimuth = 40.0, 150.0
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100000).alias("v"), F.col("l_quantity").alias("slope"), (F.col("l_suppkey") % 360).alias("aspect"))
    cz, sz = F.cos(F.radians(F.lit(zenith))), F.sin(F.radians(F.lit(zenith)))
    slope = F.radians("slope")
    t = t.withColumn("ill", clip(F.cos(slope) * cz + F.sin(slope) * sz * F.cos(F.radians(F.lit(azimuth) - F.col("aspect"))), 0.001, 1))
    v, ill = F.col("v"), F.col("ill")
    cosine = v * cz / ill
    return t.select(
        "l_orderkey", "l_linenumber", rnd(cosine, 4).alias("cosine"), rnd(v * F.pow(cz / ill, 0.5), 4).alias("minnaert"), rnd(v * (cz + 0.5) / (ill + 0.5)).alias("c_correction"),
        rnd(v * F.cos(slope) * cz / ill, 4).alias("scs"), F.when(ill <= 0.001, 0.0).when(F.col("slope") > 40, 0.3).when(cosine > 2 * v, 0.5).otherwise(1.0).alias("quality"),
    )


@query(
    "sar_dual_pol",
    f"""WITH {_px("vv", "vh")} SELECT vec_id, round(CASE WHEN vv > 0 THEN 10 * log10(vv) END, 6) AS vv_db, round(CASE WHEN vh > 0 THEN 10 * log10(vh) END, 6) AS vh_db,
 round(CASE WHEN vh > 1e-6 THEN vv / vh END, 3) AS ratio FROM p""",
)
def sar_dual_pol(spark, sf_dir):
    """Linear power to decibel, and the polarisation ratio."""
    db = lambda c: F.when(F.col(c) > 0, 10 * F.log10(c))
    return pixels(spark, sf_dir, "vv", "vh").select("vec_id", rnd(db("vv")).alias("vv_db"), rnd(db("vh")).alias("vh_db"), rnd(F.when(F.col("vh") > 1e-6, F.col("vv") / F.col("vh")), 3).alias("ratio"))


@query(
    "cloud_spectral",
    f"""WITH {_px("blue", "red", "nir")}, q AS (SELECT {", ".join(f"quantile_cont({b}, 0.02) AS l_{b}, quantile_cont({b}, 0.98) AS h_{b}" for b in ("blue", "red", "nir"))} FROM p),
n AS (SELECT vec_id, {", ".join(f"least(greatest(({b} - l_{b}) / (h_{b} - l_{b}), 0.0), 1.0) AS {b}" for b in ("blue", "red", "nir"))} FROM p, q)
SELECT vec_id, (blue + red + nir) / 3 > 0.6 AS bright, blue > 0.5 AND nir > 0.5 AS blue_nir, (blue + red + nir) / 3 > 0.6 AND blue > 0.5 AND nir > 0.5 AS cloud FROM n""",
)
def cloud_spectral(spark, sf_dir):
    """Brightness and blue-NIR tests after a stretch between the 2nd and 98th percentiles."""
    bands = ("blue", "red", "nir")
    p = pixels(spark, sf_dir, *bands)
    p = S.with_quantiles(p, {f"{n}_{b}": (b, q) for b in bands for n, q in (("l", 0.02), ("h", 0.98))})
    n = p.select("vec_id", *(clip((F.col(b) - F.col(f"l_{b}")) / (F.col(f"h_{b}") - F.col(f"l_{b}")), 0, 1).alias(b) for b in bands))
    bright, pair = (F.col("blue") + F.col("red") + F.col("nir")) / 3 > 0.6, (F.col("blue") > 0.5) & (F.col("nir") > 0.5)
    return n.select("vec_id", bright.alias("bright"), pair.alias("blue_nir"), (bright & pair).alias("cloud"))
