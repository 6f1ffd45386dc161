"""Statistics, calibration and quality queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import clip, rnd
from ..operators import statistics as S
from ..operators.kernels import with_global
from .registry import query, table


@query(
    "band_stats",
    f"""SELECT l_returnflag AS band, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(var_pop(l_quantity), 5) AS var, sum(l_quantity) AS sum, count(*) AS n, count(l_quantity) AS valid,
 {", ".join(f"quantile_cont(l_quantity, {p / 100}) AS p{p}" for p in S.PERCENTILES)}, count(DISTINCT l_quantity) AS n_unique, max(l_quantity) - min(l_quantity) AS range, round(stddev_pop(l_quantity) / abs(avg(l_quantity)), 6) AS cv, round(abs(avg(l_quantity)) / stddev_pop(l_quantity), 6) AS snr FROM lineitem GROUP BY l_returnflag""",
)
def band_stats(spark, sf_dir):
    b = S.band_statistics(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("band"), "l_quantity"), "l_quantity", "band")
    return b.select(
        "band", "min", "max", rnd("mean").alias("mean"), rnd("std").alias("std"), rnd("var", 5).alias("var"), "sum", "n", "valid", *(F.get("pct", F.lit(k)).alias(f"p{p}") for k, p in enumerate(S.PERCENTILES)), "n_unique",
        (F.col("max") - F.col("min")).alias("range"), rnd(F.try_divide("std", F.abs("mean"))).alias("cv"), rnd(F.try_divide(F.abs("mean"), "std")).alias("snr"),
    )


@query(
    "band_histogram",
    """WITH s AS (SELECT l_returnflag AS band, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT band, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 32)), 31) AS INTEGER) AS bin, count(*) AS count FROM lineitem JOIN s ON l_returnflag = band GROUP BY ALL""",
)
def band_histogram(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("band"), "l_extendedprice"), "l_extendedprice", 32, "band")


@query(
    "percentile_stretch",
    """WITH s AS (SELECT l_returnflag AS band, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest((l_extendedprice - lo) / (hi - lo), 0.0), 1.0), 6) AS stretched FROM lineitem JOIN s ON l_returnflag = band""",
)
def percentile_stretch(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    s = S.quantiles(t, "l_extendedprice", (0.02, 0.98), "l_returnflag").select("l_returnflag", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return t.join(F.broadcast(s), "l_returnflag").select("l_orderkey", "l_linenumber", "l_partkey", rnd(clip((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")), 0, 1)).alias("stretched"))


@query("sigma_clip", "WITH m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events) SELECT event_id, round(least(greatest(value, mu - 2 * sd), mu + 2 * sd), 6) AS clipped, abs(value - mu) > 2 * sd AS outlier FROM events, m")
def sigma_clip(spark, sf_dir):
    e = with_global(table(spark, sf_dir, "events").select("event_id", "value"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    lo, hi = F.col("mu") - 2 * F.col("sd"), F.col("mu") + 2 * F.col("sd")
    return e.select("event_id", rnd(F.least(F.greatest("value", lo), hi)).alias("clipped"), (F.abs(F.col("value") - F.col("mu")) > 2 * F.col("sd")).alias("outlier"))


@query("sensitivity", "SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_samp(l_quantity, l_extendedprice) / var_pop(l_quantity), 3) AS slope, round(covar_samp(l_quantity, l_extendedprice) / var_pop(l_quantity) * avg(l_quantity) / avg(l_extendedprice), 6) AS elasticity FROM lineitem GROUP BY l_returnflag HAVING count(*) >= 10")
def sensitivity(spark, sf_dir):
    """The covariance is a sample one, the variance that of the population."""
    slope = F.covar_samp("l_quantity", "l_extendedprice") / F.var_pop("l_quantity")
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), rnd(F.corr("l_quantity", "l_extendedprice")).alias("corr"), rnd(slope, 3).alias("slope"), rnd(slope * F.avg("l_quantity") / F.avg("l_extendedprice")).alias("elasticity"))
    return g.filter("n >= 10")


_SCORE = "s AS (SELECT l.quality AS y, least(greatest((n_chars % 1000) / 1000.0, 0.0), 1.0) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL)"


def scores(spark, sf_dir):
    """Labelled observations and a stand-in probability."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return d.join(lab.filter("y IS NOT NULL"), "doc_id").select("y", ((F.col("n_chars") % 1000) / 1000.0).alias("p"))


@query(
    "calibration_brier",
    f"""WITH {_SCORE}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM s GROUP BY 1), t AS (SELECT count(*) AS total, avg(y) AS base, avg(pow(p - y, 2)) AS brier, var_pop(p) AS sharp FROM s)
SELECT round(sum(n / total * abs(mp - my)), 6) AS ece, round(max(abs(mp - my)), 6) AS mce, round(any_value(brier), 6) AS brier, round(sum(n / total * pow(mp - my, 2)), 6) AS reliability, round(sum(n / total * pow(my - base, 2)), 6) AS resolution, round(any_value(sharp), 6) AS sharpness FROM b, t""",
)
def calibration_brier(spark, sf_dir):
    s = scores(spark, sf_dir)
    b = s.groupBy(S.calibration_bins(F.col("p"), 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    t = s.agg(F.count("*").alias("total"), F.avg("y").alias("base"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.var_pop("p").alias("sharp"))
    share, gap = F.col("n") / F.col("total"), F.abs(F.col("mp") - F.col("my"))
    return b.crossJoin(F.broadcast(t)).agg(
        rnd(F.sum(share * gap)).alias("ece"), rnd(F.max(gap)).alias("mce"), rnd(F.first("brier")).alias("brier"), rnd(F.sum(share * gap * gap)).alias("reliability"), rnd(F.sum(share * F.pow(F.col("my") - F.col("base"), 2))).alias("resolution"), rnd(F.first("sharp")).alias("sharpness")
    )


@query("reliability_diagram", f"WITH {_SCORE} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS forecast, round(avg(y), 6) AS observed FROM s GROUP BY 1")
def reliability_diagram(spark, sf_dir):
    return scores(spark, sf_dir).groupBy(S.calibration_bins(F.col("p"), 10).alias("bin")).agg(F.count("*").alias("n"), rnd(F.avg("p")).alias("forecast"), rnd(F.avg("y")).alias("observed"))


@query(
    "param_grid_search",
    f"""WITH {_SCORE}, g AS (SELECT unnest(range(1, 20)) / 20 AS threshold), c AS (SELECT threshold, sum(CASE WHEN p >= threshold AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p >= threshold AND y = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN p < threshold AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM s, g GROUP BY threshold)
SELECT threshold, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, row_number() OVER (ORDER BY round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) DESC, threshold) = 1 AS best FROM c""",
)
def param_grid_search(spark, sf_dir):
    """All thresholds in one pass: the grid is a fixed array expanded on each row and counted with partial aggregates."""
    s = scores(spark, sf_dir).withColumn("threshold", F.explode(F.array(*(F.lit(k / 20) for k in range(1, 20)))))
    hit, y = F.col("p") >= F.col("threshold"), F.col("y") == 1
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    c = s.groupBy("threshold").agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.withColumn("v", f1).select("threshold", rnd("v").alias("f1"), (F.row_number().over(W.orderBy(F.round("v", 9).desc(), "threshold")) == 1).alias("best"))


@query(
    "uncertainty_metrics",
    """WITH g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, avg(l_quantity) AS mu, stddev_samp(l_quantity) AS sd, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem GROUP BY 1),
m AS (SELECT l.l_returnflag, avg(pow(l_quantity - mu, 3)) AS m3, avg(pow(l_quantity - mu, 4)) AS m4 FROM lineitem l JOIN g ON l.l_returnflag = g.l_returnflag GROUP BY 1)
SELECT l_returnflag, round(mu, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, round(sd / abs(mu), 6) AS cv, round(mu - 1.959964 * sd / sqrt(n), 6) AS ci_low, round(mu + 1.959964 * sd / sqrt(n), 6) AS ci_high, round(1.959964 * sd * sqrt(1 + 1 / n), 6) AS pi95, iqr,
 round(m3 / pow(sd, 3) * sqrt(n * (n - 1)) / (n - 2), 6) AS skewness, round(((n + 1) * (m4 / pow(sd, 4) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)), 6) AS kurtosis FROM g JOIN m USING (l_returnflag)""",
)
def uncertainty_metrics(spark, sf_dir):
    """Two passes: central moments about each band's mean."""
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    g = t.groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"), F.avg("l_quantity").alias("mu"), F.stddev_samp("l_quantity").alias("sd"), (F.percentile("l_quantity", F.lit(0.75)) - F.percentile("l_quantity", F.lit(0.25))).alias("iqr"))
    off = F.col("l_quantity") - F.col("mu")
    m = t.join(g.select("l_returnflag", "mu"), "l_returnflag").groupBy("l_returnflag").agg(F.avg(F.pow(off, 3)).alias("m3"), F.avg(F.pow(off, 4)).alias("m4"))
    n, mu, sd = F.col("n"), F.col("mu"), F.col("sd")
    half = 1.959964 * sd / F.sqrt(n)
    return g.join(m, "l_returnflag").select(
        "l_returnflag", rnd(mu).alias("mean"), rnd(sd).alias("sd"), rnd(sd / F.sqrt(n)).alias("se"), rnd(sd / F.abs(mu)).alias("cv"), rnd(mu - half).alias("ci_low"), rnd(mu + half).alias("ci_high"), rnd(1.959964 * sd * F.sqrt(1 + 1 / n)).alias("pi95"), "iqr",
        rnd(S.adjusted_skewness(n, F.col("m3"), sd)).alias("skewness"), rnd(S.adjusted_kurtosis(n, F.col("m4"), sd)).alias("kurtosis"),
    )


@query(
    "historical_baseline",
    """WITH m AS (SELECT month(o_orderdate) AS month, count(*) AS n, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1 HAVING count(*) > 1)
SELECT CAST(month AS INTEGER) AS month, n, round(mean, 2) AS mean, round(std, 2) AS std, low, high FROM m""",
)
def historical_baseline(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), rnd(F.avg("o_totalprice"), 2).alias("mean"), rnd(F.stddev_pop("o_totalprice"), 2).alias("std"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return m.filter("n > 1")


@query(
    "historical_anomaly",
    """WITH b AS (SELECT month(o_orderdate) AS month, avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY 1), z AS (SELECT o_orderkey, CASE WHEN sd > 1e-10 THEN (o_totalprice - mu) / sd ELSE 0 END AS z FROM orders JOIN b ON month(o_orderdate) = month)
SELECT o_orderkey, round(z, 6) AS z, CASE WHEN abs(z) >= 1.7 THEN 'critical' WHEN abs(z) >= 1.6 THEN 'high' WHEN abs(z) >= 1.5 THEN 'moderate' ELSE 'low' END AS level FROM z WHERE abs(z) >= 1.4""",
)
def historical_anomaly(spark, sf_dir):
    """z against the month's baseline (twelve rows, joined back)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("month"))
    b = o.groupBy("month").agg(F.avg("o_totalprice").alias("mu"), F.stddev_pop("o_totalprice").alias("sd"))
    z = o.join(F.broadcast(b), "month").withColumn("z", F.when(F.col("sd") > 1e-10, (F.col("o_totalprice") - F.col("mu")) / F.col("sd")).otherwise(0.0))  # twelve rows at most
    a = F.abs("z")
    return z.filter(a >= 1.4).select("o_orderkey", rnd("z").alias("z"), F.when(a >= 1.7, "critical").when(a >= 1.6, "high").when(a >= 1.5, "moderate").otherwise("low").alias("level"))


@query(
    "zonal_quantile",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS b FROM lineitem),
z AS (SELECT l_quantity, CASE WHEN l_extendedprice < b[1] THEN 0 WHEN l_extendedprice < b[2] THEN 1 WHEN l_extendedprice < b[3] THEN 2 WHEN l_extendedprice < b[4] THEN 3 ELSE 4 END AS zone FROM lineitem, q)
SELECT zone, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, max(l_quantity) AS max FROM z GROUP BY zone""",
)
def zonal_quantile(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    z = t.crossJoin(F.broadcast(S.quantiles(t, "l_extendedprice", (0.2, 0.4, 0.6, 0.8)).select(F.col("q").alias("b"))))  # one row
    zone = F.size(F.filter("b", lambda x: x <= F.col("l_extendedprice")))
    return z.groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), rnd(F.avg("l_quantity")).alias("mean"), rnd(F.stddev_pop("l_quantity")).alias("std"), F.max("l_quantity").alias("max"))


@query(
    "percentile_of_value",
    f"""WITH q AS (SELECT quantile_cont(o_totalprice, [{", ".join(str(p / 100) for p in S.PERCENTILES)}]) AS v FROM orders),
s AS (SELECT o_orderkey, o_totalprice AS x, v, [{", ".join(map(str, S.PERCENTILES))}]::DOUBLE[] AS p, len(list_filter(v, lambda y: y <= o_totalprice)) AS k FROM orders, q)
SELECT o_orderkey, round(CASE WHEN k = 0 THEN 1.0 WHEN k = 9 THEN 99.0 ELSE p[k] + (p[k + 1] - p[k]) * (x - v[k]) / (v[k + 1] - v[k]) END, 6) AS percentile FROM s""",
)
def percentile_of_value(spark, sf_dir):
    """Piecewise-linear position between stored percentiles."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    o = o.crossJoin(F.broadcast(S.quantiles(o, "x", [p / 100 for p in S.PERCENTILES]).select(F.col("q").alias("v"))))  # one row
    o = o.withColumn("k", F.size(F.filter("v", lambda y: y <= F.col("x"))))
    p = F.array(*(F.lit(float(x)) for x in S.PERCENTILES))
    at = lambda a, i: F.get(a, i)
    k, v = F.col("k"), F.col("v")
    line = at(p, k - 1) + (at(p, k) - at(p, k - 1)) * (F.col("x") - at(v, k - 1)) / (at(v, k) - at(v, k - 1))
    return o.select("o_orderkey", rnd(F.when(k == 0, 1.0).when(k == 9, 99.0).otherwise(line)).alias("percentile"))


@query("grouping_sets_stats", "SELECT event_type, CAST(user_id % 7 AS VARCHAR) AS grp, count(*) AS n, round(sum(value), 4) AS total, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 7), ())")
def grouping_sets_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).cast("string").alias("grp"), "value")
    a = (F.count("*").alias("n"), rnd(F.sum("value"), 4).alias("total"), rnd(F.avg((F.col("value") > 50).cast("double"))).alias("rate"))
    return e.groupingSets([[F.col("event_type")], [F.col("grp")], []], F.col("event_type"), F.col("grp")).agg(*a)


@query("rollup_usage", "SELECT l_returnflag, l_linestatus, count(*) AS items, sum(l_quantity) AS bytes FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_usage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("items"), F.sum("l_quantity").alias("bytes"))


@query("recurring_patterns", "SELECT user_id, event_type, count(*) AS n, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_seen, list_sort(list(event_id))[1:3]::VARCHAR AS samples FROM events GROUP BY user_id, event_type HAVING count(*) >= 3")
def recurring_patterns(spark, sf_dir):
    """Groups seen at least three times with their first three samples; a bounded minimum list is kept, not all ids."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("first_seen"), F.max("ts").cast("string").alias("last_seen"), F.slice(F.array_sort(F.collect_list("event_id")), 1, 3).alias("s"))
    return g.filter("n >= 3").select("user_id", "event_type", "n", "first_seen", "last_seen", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("samples"))


@query(
    "anomaly_shares",
    """WITH g AS (SELECT l_returnflag, avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(100 * avg(CASE WHEN abs(l_extendedprice - mu) > 2 * sd THEN 1.0 ELSE 0.0 END), 6) AS z_percent, round(100 * avg(CASE WHEN l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END), 6) AS iqr_percent,
 round(100 * avg(CASE WHEN l_extendedprice >= 0.99 * top THEN 1.0 ELSE 0.0 END), 6) AS saturated_percent FROM lineitem l JOIN g ON l.l_returnflag = g.l_returnflag GROUP BY 1""",
)
def anomaly_shares(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"))
    g = t.groupBy("l_returnflag").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), F.max("v").alias("top"))
    g = g.join(S.quantiles(t, "v", (0.25, 0.75), "l_returnflag").select("l_returnflag", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")), "l_returnflag")
    v, iqr = F.col("v"), F.col("q3") - F.col("q1")
    share = lambda c: rnd(100 * F.avg(c.cast("double")))
    return t.join(F.broadcast(g), "l_returnflag").groupBy("l_returnflag").agg(share(F.abs(v - F.col("mu")) > 2 * F.col("sd")).alias("z_percent"), share((v < F.col("q1") - 0.5 * iqr) | (v > F.col("q3") + 0.5 * iqr)).alias("iqr_percent"), share(v >= 0.99 * F.col("top")).alias("saturated_percent"))


@query(
    "class_histogram",
    "WITH c AS (SELECT unnest(range(0, 12)) AS class), t AS (SELECT CAST(l_partkey % 17 AS BIGINT) AS class, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(c.class AS INTEGER) AS class, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM lineitem), 6) AS percent FROM c LEFT JOIN t USING (class)",
)
def class_histogram(spark, sf_dir):
    """Twelve scene classes, those without cells too."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 17).cast("int").alias("class")).agg(F.count("*").alias("n"))
    total = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("total"))
    c = spark.range(12).select(F.col("id").cast("int").alias("class")).join(t, "class", "left").crossJoin(F.broadcast(total))
    return c.select("class", F.coalesce("n", F.lit(0)).alias("n"), rnd(100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("percent"))


@query(
    "band_completeness",
    """WITH p AS (SELECT label, [abs(embedding[1]) > 0.02, abs(embedding[2]) > 0.02, abs(embedding[3]) > 0.02] AS ok FROM embeddings)
SELECT label, round(100 * avg(ok[1]::INT), 6) AS b0, round(100 * avg(ok[2]::INT), 6) AS b1, round(100 * avg(ok[3]::INT), 6) AS b2, round(100 * avg((ok[1] AND ok[2] AND ok[3])::INT), 6) AS all_bands FROM p GROUP BY label""",
)
def band_completeness(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = e.select("label", *((F.abs(e["embedding"][k]) > F.lit(0.02)).cast("int").alias(f"o{k}") for k in range(3)))
    return p.groupBy("label").agg(*(rnd(100 * F.avg(f"o{k}")).alias(f"b{k}") for k in range(3)), rnd(100 * F.avg(F.col("o0") * F.col("o1") * F.col("o2"))).alias("all_bands"))


@query("ensemble_spread", "WITH m AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), u AS (SELECT vec_id, unnest(x) AS v FROM m) SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS spread, round(max(v) - min(v), 6) AS range, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM u GROUP BY vec_id")
def ensemble_spread(spark, sf_dir):
    """Members are array elements, so each cell is reduced within its row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("x"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    e = e.withColumn("mean", total(F.col("x")) / F.size("x"))
    var = total(F.transform("x", lambda v: F.pow(v - F.col("mean"), 2))) / (F.size("x") - 1)
    return e.select("vec_id", rnd("mean").alias("mean"), rnd(F.sqrt(var)).alias("spread"), rnd(F.array_max("x") - F.array_min("x")).alias("range"), rnd(F.size(F.filter("x", lambda v: v > 0)) / F.size("x")).alias("agreement"))


@query(
    "error_budget",
    "WITH b AS (SELECT event_type AS source, sqrt(avg(pow(value - 20, 2))) AS u FROM events GROUP BY 1) SELECT source, round(u, 6) AS u, round(u * u / sum(u * u) OVER (), 6) AS share, u * u / sum(u * u) OVER () > 0.5 AS dominant, round(sqrt(0.8 * sum(u * u) OVER () + 0.2 * pow(sum(u) OVER (), 2)), 6) AS combined FROM b",
)
def error_budget(spark, sf_dir):
    """Contributions of error sources and their correlated sum; as many rows as sources."""
    b = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.sqrt(F.avg(F.pow(F.col("value") - 20, 2))).alias("u"))
    b = with_global(b, F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum("u").alias("su"))
    share = F.col("u") * F.col("u") / F.col("uu")
    return b.select("source", rnd("u").alias("u"), rnd(share).alias("share"), (share > 0.5).alias("dominant"), rnd(F.sqrt(0.8 * F.col("uu") + 0.2 * F.col("su") * F.col("su"))).alias("combined"))


@query(
    "entropy",
    "WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), p AS (SELECT user_id, greatest(n / sum(n) OVER (PARTITION BY user_id), 1e-10) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY user_id",
)
def entropy(spark, sf_dir):
    """From counts in one aggregate each: H = log2 N - sum(n log2 n) / N."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    return c.groupBy("user_id").agg(rnd(F.greatest(h, F.lit(0.0))).alias("entropy"))


@query("storage_usage", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def storage_usage(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("bytes"))


def bootstrap(spark, sf_dir, replicates: int = 50, seed: int = 7):
    """Poisson bootstrap: each row's weight in a replicate is drawn from a hash, so a rerun gives the same result and no sample is collected."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "event_id", "rep"), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    # inverse of the Poisson(1) distribution function
    w = sum(((u > c).cast("int") for c in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885)), F.lit(0))
    m = e.withColumn("w", w).groupBy("event_type", "rep").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("m"))
    return m.groupBy("event_type").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))


query("bootstrap_ci")(bootstrap)


@query("monte_carlo")
def monte_carlo(spark, sf_dir, draws: int = 64, seed: int = 11):
    """Uncertainty of a ratio by seeded normal draws (Box-Muller from hashes), each row by itself: its draws are an array, so nothing is shuffled."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    t = table(spark, sf_dir, "lineitem").select(*key, F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    u = lambda s, k: (F.pmod(F.xxhash64(F.lit(seed + s), *key, k), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    # radius and angle are computed once for each draw, in an array before that of the ratios
    polar = lambda k: F.struct(F.sqrt(-2 * F.log(u(1, k))).alias("radius"), (2 * F.pi() * u(2, k)).alias("angle"))
    ratio = lambda z: F.col("b") * (1 + 0.05 * z["radius"] * F.cos(z["angle"])) / (F.col("a") * (1 + 0.05 * z["radius"] * F.sin(z["angle"])))
    t = t.select(*key, F.transform(F.transform(F.sequence(F.lit(1), F.lit(draws)), polar), ratio).alias("draws"))
    total = lambda f: F.aggregate("draws", F.lit(0.0), lambda acc, x: acc + f(x))
    t = t.withColumn("mean", total(lambda x: x) / draws)
    return t.select(*key, "mean", F.sqrt(total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / (draws - 1)).alias("sd"))
