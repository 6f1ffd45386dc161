"""Gating, degraded modes, fallbacks, reviews, sensor selection and fusion planning.  ``orders`` are products or checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import Kept
from ..functions.expr import clip, rnd
from ..operators import statistics as S
from ..operators.kernels import with_global
from .registry import query, table


@query(
    "gating_decision",
    """WITH c AS (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 20000 THEN 1 END) AS hard, count(CASE WHEN o_totalprice < 60000 THEN 1 END) AS soft, count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS warn, avg(o_totalprice) / 500000 AS confidence FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN hard > 0 THEN 'block' WHEN soft > 2 OR confidence < 0.4 THEN 'review' WHEN warn > 5 OR soft > 0 THEN 'warn' ELSE 'pass' END AS status,
 round(CASE WHEN hard > 0 THEN 0.0 WHEN soft > 2 OR confidence < 0.4 THEN greatest(0.5, 1 - 0.1 * soft) WHEN warn > 5 OR soft > 0 THEN greatest(0.8, 1 - 0.02 * (warn + soft)) ELSE 1.0 END, 6) AS modifier FROM c""",
)
def gating_decision(spark, sf_dir):
    """Checks of a product to one status: block before review before warn before pass."""
    n = lambda c: F.count(F.when(c, 1))
    price, pr = F.col("o_totalprice"), F.col("o_orderpriority")
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(n((pr == "1-URGENT") & (price < 20000)).alias("hard"), n(price < 60000).alias("soft"), n(pr == "5-LOW").alias("warn"), (F.avg(price) / 500000).alias("confidence"))
    block, review, warn = F.col("hard") > 0, (F.col("soft") > 2) | (F.col("confidence") < 0.4), (F.col("warn") > 5) | (F.col("soft") > 0)
    modifier = F.when(block, 0.0).when(review, F.greatest(F.lit(0.5), 1 - 0.1 * F.col("soft"))).when(warn, F.greatest(F.lit(0.8), 1 - 0.02 * (F.col("warn") + F.col("soft")))).otherwise(1.0)
    return c.select("o_custkey", F.when(block, "block").when(review, "review").when(warn, "warn").otherwise("pass").alias("status"), rnd(modifier).alias("modifier"))


@query(
    "degraded_confidence",
    """WITH f AS (SELECT o_orderkey, 1 - o_custkey % 100 / 100.0 AS cloud, least(o_orderkey % 101 / 100.0, 1.0) AS coverage, CASE WHEN o_orderstatus = 'F' THEN 0.5 END AS baseline FROM orders),
g AS (SELECT o_orderkey, list_filter([cloud, coverage, baseline], lambda x: x IS NOT NULL) AS fs FROM f), c AS (SELECT o_orderkey, CASE WHEN list_min(fs) <= 0 THEN 0.0 ELSE exp(list_avg(list_transform(fs, lambda x: ln(x)))) END AS conf FROM g)
SELECT o_orderkey, round(conf, 6) AS confidence, CASE WHEN conf >= 0.8 - 1e-9 THEN 'full' WHEN conf >= 0.5 - 1e-9 THEN 'partial' WHEN conf >= 0.3 - 1e-9 THEN 'minimal' ELSE 'emergency' END AS level FROM c""",
)
def degraded_confidence(spark, sf_dir):
    """Geometric mean of the factors at hand, and the mode it allows."""
    fs = F.array_compact(F.array(1 - F.col("o_custkey") % 100 / 100.0, F.least(F.col("o_orderkey") % 101 / 100.0, F.lit(1.0)), F.when(F.col("o_orderstatus") == "F", 0.5)))
    g = table(spark, sf_dir, "orders").select("o_orderkey", fs.alias("fs"))
    mean = F.aggregate("fs", F.lit(0.0), lambda a, x: a + F.log(x)) / F.size("fs")
    c = g.select("o_orderkey", F.when(F.array_min("fs") <= 0, 0.0).otherwise(F.exp(mean)).alias("c"))
    k = F.col("c")
    return c.select("o_orderkey", rnd(k).alias("confidence"), F.when(k >= 0.8 - 1e-9, "full").when(k >= 0.5 - 1e-9, "partial").when(k >= 0.3 - 1e-9, "minimal").otherwise("emergency").alias("level"))


#: Fallback chains with the typical quality of each algorithm.
CHAINS = {
    "flood": (("sar_change", 0.85), ("optical_change", 0.80), ("ndwi", 0.75), ("hand", 0.70), ("forecast", 0.55), ("static", 0.50)),
    "wildfire": (("dnbr", 0.85), ("thermal", 0.80)),
    "storm": (("sar_change", 0.80), ("optical_change", 0.75)),
}
_CHAIN = ", ".join(f"('{e}', {k}, '{a}', {q})" for e, c in CHAINS.items() for k, (a, q) in enumerate(c))


@query(
    "algorithm_fallback",
    f"""WITH p(event, pos, algorithm, quality) AS (VALUES {_CHAIN}), o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'flood' WHEN 'F' THEN 'wildfire' ELSE 'storm' END AS event FROM orders),
j AS (SELECT o_orderkey, o.event, pos, algorithm, quality, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) AS rn FROM o JOIN p ON o.event = p.event WHERE (o_orderkey + pos) % 3 <> 0)
SELECT o_orderkey, event, algorithm, CAST(CASE WHEN pos = 0 THEN 0 ELSE round(1 - quality, 6) END AS DOUBLE) AS degradation FROM j WHERE rn = 1""",
)
def algorithm_fallback(spark, sf_dir):
    """First algorithm of a chain that is available; a chain is an array, so nothing is shuffled."""
    event = F.when(F.col("o_orderstatus") == "O", "flood").when(F.col("o_orderstatus") == "F", "wildfire").otherwise("storm")
    o = table(spark, sf_dir, "orders").select("o_orderkey", event.alias("event"))
    chain = None
    for e, steps in CHAINS.items():
        arr = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(a).alias("algorithm"), F.lit(q).alias("quality")) for k, (a, q) in enumerate(steps)))
        chain = F.when(F.col("event") == e, arr) if chain is None else chain.when(F.col("event") == e, arr)
    left = F.filter(chain, lambda s: (F.col("o_orderkey") + s["pos"]) % 3 != 0)
    o = o.withColumn("b", F.get(left, F.lit(0))).filter("b IS NOT NULL")
    return o.select("o_orderkey", "event", "b.algorithm", F.when(F.col("b.pos") == 0, 0.0).otherwise(F.round(1 - F.col("b.quality"), 6)).alias("degradation"))


#: What a sensor can observe, in order of choice, with its capability.
SENSORS = (("water", "sar", "high"), ("water", "optical", "medium"), ("depth", "dem", "high"), ("burn", "optical", "high"), ("burn", "sar", "medium"), ("fire", "thermal", "high"), ("fire", "optical", "medium"), ("vegetation", "optical", "high"), ("vegetation", "sar", "medium"), ("structure", "sar", "high"), ("structure", "optical", "medium"))
_SENS = ", ".join(f"({k}, '{o}', '{s}', '{c}')" for k, (o, s, c) in enumerate(SENSORS))


@query(
    "sensor_selection",
    f"""WITH s(pos, observable, sensor, capability) AS (VALUES {_SENS}), n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'optical' WHEN n_nationkey % 3 = 1 THEN 'sar' ELSE 'none' END AS down FROM nation)
SELECT n_nationkey, observable, arg_min(sensor, pos) AS sensor, round(CASE WHEN arg_min(capability, pos) = 'high' THEN 0.9 ELSE 0.6 END, 6)::DOUBLE AS confidence FROM n, s WHERE sensor <> down GROUP BY ALL""",
)
def sensor_selection(spark, sf_dir):
    """First capable and reliable sensor of each observable at each place; the capability matrix is a fixed array."""
    matrix = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(o).alias("observable"), F.lit(s).alias("sensor"), F.lit(c).alias("capability")) for k, (o, s, c) in enumerate(SENSORS)))
    key = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(key % 3 == 0, "optical").when(key % 3 == 1, "sar").otherwise("none").alias("down"), F.explode(matrix).alias("s")).filter("s.sensor <> down")
    best = n.groupBy("n_nationkey", F.col("s.observable").alias("observable")).agg(F.min_by("s", "s.pos").alias("b"))
    return best.select("n_nationkey", "observable", "b.sensor", F.when(F.col("b.capability") == "high", 0.9).otherwise(0.6).alias("confidence"))


@query(
    "fusion_plan",
    """WITH c AS (SELECT o_orderkey, o_custkey, o_orderstatus AS sensor, (o_totalprice / 500000 + o_orderkey % 10 / 10.0) / 2 AS quality FROM orders WHERE o_totalprice > 5000),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, sensor ORDER BY round(quality, 9) DESC, o_orderkey) AS rn FROM c), t AS (SELECT * FROM k WHERE rn <= CASE sensor WHEN 'O' THEN 3 WHEN 'F' THEN 5 ELSE 1 END),
w AS (SELECT o_custkey, sensor, o_orderkey, quality, quality / sum(quality) OVER (PARTITION BY o_custkey, sensor) AS weight FROM t)
SELECT o_custkey, count(DISTINCT sensor) AS sensors, count(*) AS datasets, round(max(weight), 6) AS top_weight, round(0.4 * count(DISTINCT sensor) / 3.0 + 0.6 * avg(quality), 6) AS confidence FROM w GROUP BY o_custkey""",
)
def fusion_plan(spark, sf_dir):
    """Requirement filter, strategy-dependent top k of each sensor, normalised weights, plan confidence."""
    c = table(spark, sf_dir, "orders").filter("o_totalprice > 5000").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("sensor"), ((F.col("o_totalprice") / 500000 + F.col("o_orderkey") % 10 / 10.0) / 2).alias("quality"))
    w = W.partitionBy("o_custkey", "sensor")
    k = F.when(F.col("sensor") == "O", 3).when(F.col("sensor") == "F", 5).otherwise(1)
    t = c.withColumn("rn", F.row_number().over(w.orderBy(F.round("quality", 9).desc(), "o_orderkey"))).filter("rn <= 5").filter(F.col("rn") <= k)
    t = t.withColumn("weight", F.col("quality") / F.sum("quality").over(w))
    return t.groupBy("o_custkey").agg(F.countDistinct("sensor").alias("sensors"), F.count("*").alias("datasets"), rnd(F.max("weight")).alias("top_weight"), rnd(0.4 * F.countDistinct("sensor") / 3.0 + 0.6 * F.avg("quality")).alias("confidence"))


@query(
    "reviewer_choice",
    """WITH r AS (SELECT c_custkey AS product, c_nationkey, c_mktsegment = 'MACHINERY' AS critical FROM customer), e AS (SELECT s_suppkey AS reviewer, s_nationkey, s_suppkey % 7 AS load, s_suppkey % 2 = 0 AS priority FROM supplier),
j AS (SELECT product, reviewer, row_number() OVER (PARTITION BY product ORDER BY CASE WHEN critical AND NOT priority THEN 1 ELSE 0 END, load, reviewer) AS rn FROM r JOIN e ON c_nationkey = s_nationkey) SELECT product, reviewer FROM j WHERE rn = 1""",
)
def reviewer_choice(spark, sf_dir):
    """Critical items prefer reviewers with priority access, then the least load: a reviewer is chosen once a (domain, critical) pair and joined."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("reviewer"), (F.col("s_suppkey") % 7).alias("load"), (F.col("s_suppkey") % 2 == 0).alias("priority"))
    pick = lambda critical: F.min_by("reviewer", F.struct((F.lit(critical) & ~F.col("priority")).cast("int"), "load", "reviewer"))
    best = e.groupBy("c_nationkey").agg(pick(True).alias("urgent"), pick(False).alias("usual"))
    return table(spark, sf_dir, "customer").join(best, "c_nationkey").select(F.col("c_custkey").alias("product"), F.when(F.col("c_mktsegment") == "MACHINERY", F.col("urgent")).otherwise(F.col("usual")).alias("reviewer"))


@query("flag_summary", "WITH f AS (SELECT DISTINCT o_custkey, o_orderpriority AS flag, CASE o_orderpriority WHEN '1-URGENT' THEN 0.6 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 0.95 ELSE 1.0 END AS m FROM orders) SELECT o_custkey, count(*) AS flags, round(exp(sum(ln(m))), 6) AS modifier FROM f GROUP BY o_custkey")
def flag_summary(spark, sf_dir):
    """Product of the modifiers of distinct flags."""
    p = F.col("o_orderpriority")
    f = table(spark, sf_dir, "orders").select("o_custkey", p.alias("flag"), F.when(p == "1-URGENT", 0.6).when(p == "2-HIGH", 0.8).when(p == "3-MEDIUM", 0.95).otherwise(1.0).alias("m")).distinct()
    return f.groupBy("o_custkey").agg(F.count("*").alias("flags"), rnd(F.exp(F.sum(F.log("m")))).alias("modifier"))


@query(
    "quality_score",
    """SELECT o_orderkey, round(least(greatest(0.35 * (1 - o_custkey % 100 / 100.0) + 0.15 * (1 - o_orderkey % 50 / 50.0) + 0.15 * (1 - o_totalprice / 500000) + 0.10 * (1 - o_orderkey % 30 / 30.0) + 0.10 * (1 - o_orderkey % 10 / 10.0) + 0.15 * (1 - o_custkey % 7 / 7.0), 0.0), 1.0), 6) AS optical,
 round(1 - 0.5 * least(greatest((date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') - 30) / 60.0, 0.0), 1.0), 6) AS freshness FROM orders""",
)
def quality_score(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = 0.35 * (1 - c % 100 / 100.0) + 0.15 * (1 - k % 50 / 50.0) + 0.15 * (1 - F.col("o_totalprice") / 500000) + 0.10 * (1 - k % 30 / 30.0) + 0.10 * (1 - k % 10 / 10.0) + 0.15 * (1 - c % 7 / 7.0)
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rnd(clip(s, 0, 1)).alias("optical"), rnd(1 - 0.5 * clip((age - 30) / 60.0, 0, 1)).alias("freshness"))


@query("condition_class", "SELECT o_orderkey, CASE WHEN o_custkey % 100 < 5 THEN 'clear' WHEN o_custkey % 100 < 10 THEN 'mostly_clear' WHEN o_custkey % 100 < 50 THEN 'partly_cloudy' WHEN o_custkey % 100 < 80 THEN 'mostly_cloudy' ELSE 'overcast' END AS sky, CASE WHEN o_custkey % 100 > 80 THEN 'sar_only' WHEN o_orderstatus = 'O' THEN 'complementary' ELSE 'ensemble' END AS strategy FROM orders")
def condition_class(spark, sf_dir):
    from ..functions.expr import classes

    cloud = F.col("o_custkey") % 100
    sky = classes(cloud, (5, 10, 50, 80), ("clear", "mostly_clear", "partly_cloudy", "mostly_cloudy", "overcast"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sky.alias("sky"), F.when(cloud > 80, "sar_only").when(F.col("o_orderstatus") == "O", "complementary").otherwise("ensemble").alias("strategy"))


@query(
    "mode_transitions",
    """WITH t AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS level, lag(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
SELECT o_custkey, count(CASE WHEN level <> prev THEN 1 END) AS transitions, count(CASE WHEN level > prev THEN 1 END) AS degradations, count(CASE WHEN level < prev THEN 1 END) AS recoveries FROM t GROUP BY o_custkey""",
)
def mode_transitions(spark, sf_dir):
    s = F.col("o_orderstatus")
    level = F.when(s == "O", 0).when(s == "P", 1).otherwise(2)
    t = table(spark, sf_dir, "orders").select("o_custkey", level.alias("level"), F.lag(level).over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("prev"))
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.col("level"), F.col("prev")
    return t.groupBy("o_custkey").agg(n(a != b).alias("transitions"), n(a > b).alias("degradations"), n(a < b).alias("recoveries"))


@query(
    "sensor_coincidence",
    """WITH s AS (SELECT event_type AS sensor, min(epoch(ts)) AS a, max(epoch(ts)) AS b, avg(value) AS m FROM events GROUP BY 1) SELECT x.sensor AS s1, y.sensor AS s2, abs(x.a - y.a) <= 3600 AS coincident, round(abs(x.m - y.m), 5) AS bias FROM s x JOIN s y ON x.sensor < y.sensor""",
)
def sensor_coincidence(spark, sf_dir):
    """All pairs of sensors: the input is one row a sensor."""
    from ..operators.temporal import micros

    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sensor")).agg((F.min(micros("ts")) / 1e6).alias("a"), F.avg("value").alias("m"))
    x, y = s.select(F.col("sensor").alias("s1"), F.col("a").alias("a1"), F.col("m").alias("m1")), s.select(F.col("sensor").alias("s2"), F.col("a").alias("a2"), F.col("m").alias("m2"))
    j = x.join(y, F.col("s1") < F.col("s2"))
    return j.select("s1", "s2", (F.abs(F.col("a1") - F.col("a2")) <= 3600).alias("coincident"), rnd(F.abs(F.col("m1") - F.col("m2")), 5).alias("bias"))


@query(
    "best_change_pair",
    """WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1998-07-01', CAST(o_orderdate AS DATE)) AS d FROM orders), a AS (SELECT o_custkey, arg_max(o_orderkey, (d, -o_orderkey)) AS pre, max(d) AS pd FROM o WHERE d < 0 GROUP BY 1), b AS (SELECT o_custkey, arg_min(o_orderkey, (d, o_orderkey)) AS post, min(d) AS qd FROM o WHERE d > 0 GROUP BY 1)
SELECT o_custkey, pre, post, CAST(qd - pd AS INTEGER) AS gap_days FROM a JOIN b USING (o_custkey)""",
)
def best_change_pair(spark, sf_dir):
    """The closest scenes before and after an event: the smallest gap needs no cross product."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff(F.col("o_orderdate"), F.lit("1998-07-01").cast("date")).alias("d"))
    k, d = F.col("o_orderkey"), F.col("d")
    g = o.groupBy("o_custkey").agg(F.max_by(F.when(d < 0, k), F.when(d < 0, F.struct(d, -k))).alias("pre"), F.max(F.when(d < 0, d)).alias("pd"), F.min_by(F.when(d > 0, k), F.when(d > 0, F.struct(d, k))).alias("post"), F.min(F.when(d > 0, d)).alias("qd")).dropna()
    return g.select("o_custkey", "pre", "post", (F.col("qd") - F.col("pd")).alias("gap_days"))


@query(
    "plan_hash",
    "SELECT o_custkey, substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)), 1, 16) AS plan FROM orders GROUP BY o_custkey",
)
def plan_hash(spark, sf_dir):
    """Reproducibility hash of a plan's sorted parts."""
    ids = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 16).alias("plan"))


@query(
    "histogram_match",
    """WITH s AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_quantity * 2 AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
sc AS (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE / sum(n) OVER () AS c FROM s), rc AS (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE / sum(n) OVER () AS c FROM r)
SELECT sc.v AS value, (SELECT min(v) FROM rc WHERE rc.c >= sc.c - 1e-12) AS matched FROM sc""",
)
def histogram_match(spark, sf_dir):
    """Each distinct value to the smallest reference value whose share is as large: distinct values are merged in one order."""
    t = table(spark, sf_dir, "lineitem")

    def cdf(flag, factor):
        g = t.filter(F.col("l_returnflag") == flag).groupBy((F.col("l_quantity") * factor).alias("v")).agg(F.count("*").alias("n"))
        g = with_global(g, F.sum("n").alias("total"))
        return S.running_sum(g, "v", "n", "upto").select("v", (F.col("upto") / F.col("total")).alias("c"))

    # the reference's value counts from its own share on: values are looked up upwards, a share's reference values first
    both = cdf("A", 1).select(F.lit(1).alias("side"), "v", (F.col("c") - 1e-12).alias("c"), F.lit(None).cast("double").alias("r")).union(cdf("R", 2).select(F.lit(2), "v", "c", "v"))
    return S.next_value(both, ["c", "side", "v"], "r", "matched").filter("side = 1").select(F.col("v").alias("value"), "matched")


@query("lineage_closure", "WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), r AS (SELECT child, parent, 1 AS depth FROM e UNION ALL SELECT r.child, e.parent, depth + 1 FROM r JOIN e ON r.parent = e.child) SELECT child, parent AS ancestor, CAST(depth AS INTEGER) AS depth FROM r")
def lineage_closure(spark, sf_dir):
    """All ancestors of every product, a level a round: each level is written once, so the depth meets no limit of a recursive query."""
    keep = Kept(spark, "lineage")
    e = table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent"))
    up = e.select(F.col("child").alias("ancestor"), "parent")
    level = out = keep(e.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    while level.limit(1).count():
        level = keep(level.join(up, "ancestor").select("child", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth")))
        out = out.unionByName(level)
    return out
