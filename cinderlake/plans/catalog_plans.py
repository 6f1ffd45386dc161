"""Broker, search, taxonomy and metadata queries.  ``orders`` are candidate datasets, ``part`` and ``supplier`` carry boxes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.expr import rnd
from ..operators import catalog as C
from .registry import query, table

EVENT = "1998-07-01"


def candidates(spark, sf_dir):
    """Candidates: id, data_type, provider, days from the event, coverage, cloud, resolution, flags."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = o.select(
        F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderstatus").alias("data_type"), F.datediff("o_orderdate", F.lit(EVENT).cast("date")).alias("days"), (F.col("o_orderkey") % 101).cast("double").alias("coverage"),
        F.when(F.col("o_orderstatus") == "F", (F.col("o_custkey") % 100).cast("double")).alias("cloud"), (F.col("o_totalprice") / 5000).alias("resolution"),
        E_flag(F.col("o_orderpriority")).alias("quality_flag"),
    )
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("provider"), F.when(F.col("c_mktsegment") == "MACHINERY", "commercial").when(F.col("c_mktsegment") == "BUILDING", "open_restricted").otherwise("open").alias("cost_tier"), (F.col("c_custkey") % 10 / 10).alias("preference"))
    return o.join(c, "o_custkey").drop("o_custkey")


def E_flag(p):
    return F.when(p == "1-URGENT", "excellent").when(p == "2-HIGH", "good").when(p == "3-MEDIUM", "fair").when(p == "5-LOW", "poor").otherwise("unknown")


CAND = """cand AS (SELECT o_orderkey AS id, o_orderstatus AS data_type, date_diff('day', DATE '1998-07-01', CAST(o_orderdate AS DATE)) AS days, CAST(o_orderkey % 101 AS DOUBLE) AS coverage,
 CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 100 AS DOUBLE) END AS cloud, o_totalprice / 5000 AS resolution, n_name AS provider, c_custkey % 10 / 10 AS preference,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'excellent' WHEN '2-HIGH' THEN 'good' WHEN '3-MEDIUM' THEN 'fair' WHEN '5-LOW' THEN 'poor' ELSE 'unknown' END AS quality_flag,
 CASE c_mktsegment WHEN 'MACHINERY' THEN 'commercial' WHEN 'BUILDING' THEN 'open_restricted' ELSE 'open' END AS cost_tier
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
hard AS (SELECT * FROM cand WHERE coverage >= 50 AND coalesce(cloud, 0) <= 80 AND resolution <= 80),
scored AS (SELECT *, 0.25 * coverage / 100 + 0.20 * exp(-abs(days) / 7) + 0.15 * exp(-resolution / 100) + 0.15 * (1 - coalesce(cloud, 0) / 100)
 + 0.10 * CASE quality_flag WHEN 'excellent' THEN 1.0 WHEN 'good' THEN 0.8 WHEN 'fair' THEN 0.6 WHEN 'poor' THEN 0.3 ELSE 0.5 END + 0.10 * CASE cost_tier WHEN 'open' THEN 1.0 WHEN 'open_restricted' THEN 0.7 WHEN 'commercial' THEN 0.3 ELSE 0.5 END + 0.05 * preference AS total FROM hard)"""


def hard_filter(c):
    """Coverage of at least 50 %, cloud (none counts as 0) and resolution of at most 80."""
    return c.filter((F.col("coverage") >= 50) & (F.coalesce("cloud", F.lit(0.0)) <= 80) & (F.col("resolution") <= 80))


def scored(spark, sf_dir):
    return C.broker_scores(hard_filter(candidates(spark, sf_dir)), F.col("days"))


@query("broker_rank", f"WITH {CAND} SELECT id, data_type, provider, round(total, 6) AS total, rank FROM (SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY round(total, 9) DESC, id) AS rank FROM scored) WHERE rank <= 4")
def broker_rank(spark, sf_dir):
    """Discover, filter, score, and keep the best of each data type with three runners-up."""
    return C.top_per_group(scored(spark, sf_dir), 4, ["data_type"], F.round("total", 9).desc(), F.col("id")).select("id", "data_type", "provider", rnd("total").alias("total"), "rank")


@query(
    "constraint_filter",
    f"""WITH {CAND} SELECT id, coverage >= 50 AS ok_coverage, cloud IS NULL OR cloud <= 60 AS ok_cloud, resolution <= 60 AS ok_resolution, days BETWEEN -400 AND 400 AS ok_time,
 coverage >= 50 AND (cloud IS NULL OR cloud <= 60) AND resolution <= 60 AND days BETWEEN -400 AND 400 AS passed FROM cand""",
)
def constraint_filter(spark, sf_dir):
    """Each rule's verdict and whether all pass; an unknown cloud cover passes."""
    rules = {"ok_coverage": F.col("coverage") >= 50, "ok_cloud": F.col("cloud").isNull() | (F.col("cloud") <= 60), "ok_resolution": F.col("resolution") <= 60, "ok_time": F.col("days").between(-400, 400)}
    c = candidates(spark, sf_dir).select("id", *(v.alias(k) for k, v in rules.items()))
    return c.withColumn("passed", F.col("ok_coverage") & F.col("ok_cloud") & F.col("ok_resolution") & F.col("ok_time"))


@query("rank_by_type", f"WITH {CAND} SELECT data_type, id, round(total, 6) AS total, row_number() OVER (PARTITION BY data_type, provider ORDER BY round(total, 9) DESC, id) AS rank FROM scored")
def rank_by_type(spark, sf_dir):
    w = W.partitionBy("data_type", "provider").orderBy(F.round("total", 9).desc(), "id")
    return scored(spark, sf_dir).select("data_type", "id", rnd("total").alias("total"), F.row_number().over(w).alias("rank"))


@query(
    "tradeoff_diff",
    f"""WITH {CAND}, b AS (SELECT data_type, arg_max(id, (round(total, 9), -id)) AS best, max(total) AS top FROM scored GROUP BY data_type),
r AS (SELECT s.*, best, top, row_number() OVER (PARTITION BY s.data_type ORDER BY round(total, 9) DESC, id) AS rank FROM scored s JOIN b USING (data_type))
SELECT data_type, id, best, round(top - total, 6) AS behind FROM r WHERE rank BETWEEN 2 AND 4""",
)
def tradeoff_diff(spark, sf_dir):
    s = scored(spark, sf_dir)
    best = s.groupBy("data_type").agg(F.max_by("id", F.struct(F.round("total", 9), -F.col("id"))).alias("best"), F.max("total").alias("top"))
    r = C.top_per_group(s.select("data_type", "id", "total"), 4, ["data_type"], F.round("total", 9).desc(), F.col("id")).filter("rank > 1")
    return r.join(F.broadcast(best), "data_type").select("data_type", "id", "best", rnd(F.col("top") - F.col("total")).alias("behind"))


@query(
    "fallback_merge",
    f"""WITH {CAND}, strict AS (SELECT * FROM cand WHERE coverage >= 90 AND coalesce(cloud, 0) <= 10 AND resolution <= 20), kept AS (SELECT provider, data_type, count(*) AS n, false AS relaxed FROM strict GROUP BY ALL),
loose AS (SELECT provider, data_type, count(*) AS n, true AS relaxed FROM cand WHERE coverage >= 45 AND coalesce(cloud, 0) <= 15 AND resolution <= 40 GROUP BY ALL)
SELECT * FROM kept UNION ALL SELECT * FROM loose l WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.provider = l.provider AND k.data_type = l.data_type)""",
)
def fallback_merge(spark, sf_dir):
    """Where the strict limits leave nothing, limits relaxed by the fixed factors (coverage * .5, cloud * 1.5, resolution * 2)."""
    c = candidates(spark, sf_dir)
    pick = lambda cov, cloud, res, flag: c.filter((F.col("coverage") >= cov) & (F.coalesce("cloud", F.lit(0.0)) <= cloud) & (F.col("resolution") <= res)).groupBy("provider", "data_type").agg(F.count("*").alias("n")).withColumn("relaxed", F.lit(flag))
    kept, loose = pick(90, 10, 20, False), pick(45, 15, 40, True)
    return kept.unionByName(loose.join(kept, ["provider", "data_type"], "left_anti"))


@query(
    "temporal_overlap_search",
    """WITH r AS (SELECT l_orderkey, l_linenumber, o_orderdate AS s, l_shipdate AS e, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)
SELECT l_orderkey, l_linenumber, l_returnflag, s >= TIMESTAMP '1998-01-01' AND e <= TIMESTAMP '1998-12-31' AS during, s <= TIMESTAMP '1998-01-01' AND e >= TIMESTAMP '1998-12-31' AS contains,
 round((epoch(least(e, TIMESTAMP '1998-12-31')) - epoch(greatest(s, TIMESTAMP '1998-01-01'))) / epoch(TIMESTAMP '1998-12-31' - TIMESTAMP '1998-01-01'), 6) AS overlap FROM r WHERE s <= TIMESTAMP '1998-12-31' AND e >= TIMESTAMP '1998-01-01'""",
)
def temporal_overlap_search(spark, sf_dir):
    """Ranges that overlap the query year, their other predicates and the share of the year they cover."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("s"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_shipdate").cast("timestamp").alias("e"))
    qs, qe = F.lit("1998-01-01").cast("timestamp"), F.lit("1998-12-31").cast("timestamp")
    s, e = F.col("s"), F.col("e")
    r = li.join(o, li["l_orderkey"] == o["o_orderkey"]).filter(e >= s).filter(E.TEMPORAL["overlaps"](s, e, qs, qe))
    sec = F.unix_timestamp
    return r.select("l_orderkey", "l_linenumber", "l_returnflag", E.TEMPORAL["during"](s, e, qs, qe).alias("during"), E.TEMPORAL["contains"](s, e, qs, qe).alias("contains"), rnd((sec(F.least(e, qe)) - sec(F.greatest(s, qs))) / (sec(qe) - sec(qs))).alias("overlap"))


def part_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w, s = (F.col("p_partkey") * 37 % 340 - 170).cast("double"), (F.col("p_partkey") * 53 % 150 - 75).cast("double")
    size = F.col("p_size") / 10
    return p.select("p_partkey", w.alias("w"), s.alias("s"), (w + size).alias("e"), (s + size).alias("n"))


def supplier_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "supplier")
    w, s = (F.col("s_suppkey") * 71 % 340 - 170).cast("double"), (F.col("s_suppkey") * 29 % 150 - 75).cast("double")
    return p.select("s_suppkey", w.alias("qw"), s.alias("qs"), (w + 4).alias("qe"), (s + 3).alias("qn"))


_BOX = """p AS (SELECT p_partkey, CAST(p_partkey * 37 % 340 - 170 AS DOUBLE) AS w, CAST(p_partkey * 53 % 150 - 75 AS DOUBLE) AS s, p_partkey * 37 % 340 - 170 + p_size / 10 AS e, p_partkey * 53 % 150 - 75 + p_size / 10 AS n FROM part),
q AS (SELECT s_suppkey, CAST(s_suppkey * 71 % 340 - 170 AS DOUBLE) AS qw, CAST(s_suppkey * 29 % 150 - 75 AS DOUBLE) AS qs, s_suppkey * 71 % 340 - 166.0 AS qe, s_suppkey * 29 % 150 - 72.0 AS qn FROM supplier)"""


@query(
    "bbox_overlap_join",
    f"""WITH {_BOX} SELECT s_suppkey, p_partkey, w >= qw AND e <= qe AND s >= qs AND n <= qn AS inside, round(100 * (least(e, qe) - greatest(w, qw)) * (least(n, qn) - greatest(s, qs)) / ((qe - qw) * (qn - qs)), 6) AS coverage FROM p JOIN q ON w <= qe AND e >= qw AND s <= qn AND n >= qs""",
)
def bbox_overlap_join(spark, sf_dir):
    """Overlap join of boxes as an equi-join on shared 8-degree grid cells; a pair is kept in the first cell that both have, so once."""
    area = E.overlap_area([F.col(x) for x in "wsen"], [F.col(f"q{x}") for x in "wsen"])
    inside = E.box_contains([F.col(f"q{x}") for x in "wsen"], [F.col(x) for x in "wsen"])
    coverage = rnd(100 * area / ((F.col("qe") - F.col("qw")) * (F.col("qn") - F.col("qs"))))
    j = C.box_pairs(part_boxes(spark, sf_dir), supplier_boxes(spark, sf_dir), 8.0, {"inside": inside, "coverage": coverage})
    return j.select("s_suppkey", "p_partkey", "inside", "coverage")


@query(
    "affected_population",
    f"""WITH {_BOX}, a AS (SELECT s_suppkey, s_suppkey % 40 * 100.0 AS area, qw - 8 AS qw, qs, qe + 8 AS qe, qn + 8 AS qn FROM q), m AS (SELECT a.s_suppkey, count(*) AS counties, sum(p_partkey % 1000 * 10) AS people FROM a JOIN p ON w <= qe AND e >= qw AND s <= qn AND n >= qs GROUP BY a.s_suppkey)
SELECT a.s_suppkey, coalesce(counties, 0) AS counties, CAST(coalesce(floor(people * least(1.0, area / (counties * 1000.0))), 0) AS BIGINT) AS affected, CASE WHEN counties BETWEEN 1 AND 3 THEN 'medium' ELSE 'low' END AS confidence FROM a LEFT JOIN m USING (s_suppkey)""",
)
def affected_population(spark, sf_dir):
    """People of the counties (boxes of parts) that each supplier's event box overlaps, by area."""
    counties = part_boxes(spark, sf_dir).withColumn("population", F.col("p_partkey") % 1000 * 10)
    events = supplier_boxes(spark, sf_dir).select("s_suppkey", (F.col("qw") - 8).alias("qw"), "qs", (F.col("qe") + 8).alias("qe"), (F.col("qn") + 8).alias("qn"))
    return C.affected_population(events, "s_suppkey", counties, F.col("s_suppkey") % 40 * 100.0, 8.0)


@query(
    "index_query_score",
    f"""WITH {_BOX}, h AS (SELECT p_partkey, (least(e, 20.0) - greatest(w, -20.0)) * (least(n, 20.0) - greatest(s, -20.0)) / 1600 AS sp, 1 - (p_partkey % 10) / 10 AS tm FROM p WHERE w <= 20 AND e >= -20 AND s <= 20 AND n >= -20)
SELECT p_partkey, round(least(sqrt(sp * tm), 1.0), 6) AS score FROM h ORDER BY round(sqrt(sp * tm), 9) DESC, p_partkey LIMIT 25""",
)
def index_query_score(spark, sf_dir):
    """Exact top hits of a box query by sqrt(spatial * temporal overlap); the limit is the feature."""
    box = [F.lit(x) for x in (-20.0, -20.0, 20.0, 20.0)]
    mine = [F.col(x) for x in "wsen"]
    h = part_boxes(spark, sf_dir).filter(E.boxes_intersect(mine, box)).withColumn("score", F.sqrt(E.overlap_area(mine, box) / 1600 * (1 - F.col("p_partkey") % 10 / 10)))
    return h.orderBy(F.round("score", 9).desc(), "p_partkey").limit(25).select("p_partkey", rnd(F.least("score", F.lit(1.0))).alias("score"))


@query(
    "point_in_box_near",
    f"""WITH {_BOX}, t AS (SELECT s_suppkey, qw + 2 AS x, qs + 1.5 AS y FROM q), d AS (SELECT s_suppkey, p_partkey, greatest(w - x, 0.0, x - e) AS dx, greatest(s - y, 0.0, y - n) AS dy FROM t JOIN p ON w - 1 <= x AND e + 1 >= x AND s - 1 <= y AND n + 1 >= y)
SELECT s_suppkey, p_partkey, CASE WHEN dx = 0 AND dy = 0 THEN 'inside' ELSE 'near' END AS zone, round(sqrt(dx * dx + dy * dy), 6) AS distance FROM d WHERE sqrt(dx * dx + dy * dy) <= 1""",
)
def point_in_box_near(spark, sf_dir):
    """Points inside zones or within a distance of them; distinct zones and points meet in grid cells, their rows are joined back."""
    size, box = 8.0, list("wsen")
    parts = part_boxes(spark, sf_dir)
    suppliers = supplier_boxes(spark, sf_dir).select("s_suppkey", (F.col("qw") + 2).alias("x"), (F.col("qs") + 1.5).alias("y"))
    p = parts.select(*box).distinct().withColumn("c", F.explode(C.box_cells(F.col("w") - 1, F.col("s") - 1, F.col("e") + 1, F.col("n") + 1, size)))
    t = suppliers.select("x", "y").distinct().withColumn("c", F.struct(F.floor(F.col("x") / size).alias("x"), F.floor(F.col("y") / size).alias("y")))
    dx, dy = F.greatest(F.col("w") - F.col("x"), F.lit(0.0), F.col("x") - F.col("e")), F.greatest(F.col("s") - F.col("y"), F.lit(0.0), F.col("y") - F.col("n"))
    met = p.join(t, "c").select(*box, "x", "y", dx.alias("dx"), dy.alias("dy")).withColumn("distance", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).filter("distance <= 1")
    d = parts.join(met, box).join(suppliers, ["x", "y"])
    return d.select("s_suppkey", "p_partkey", F.when((F.col("dx") == 0) & (F.col("dy") == 0), "inside").otherwise("near").alias("zone"), rnd("distance").alias("distance"))


@query("page_limit_offset", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS total FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_limit_offset(spark, sf_dir):
    """One page in a total order, with the full count."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    page = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    return page.crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))


@query("tag_match_all_any", "WITH t AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS tags FROM documents) SELECT doc_id, list_has_all(tags, ['the', 'and', 'of']) AS has_all, list_has_any(tags, ['les', 'und', 'los']) AS has_any FROM t")
def tag_match_all_any(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("tags"))
    lit = lambda *x: F.array(*map(F.lit, x))
    return t.select("doc_id", (F.size(F.array_intersect("tags", lit("the", "and", "of"))) == 3).alias("has_all"), F.arrays_overlap("tags", lit("les", "und", "los")).alias("has_any"))


@query("wildcard_match", "SELECT p_partkey, p_type, p_name, p_type = 'ECONOMY' OR starts_with(p_name, 'red ') AS prefix, p_name GLOB '*ring*' AS globbed FROM part")
def wildcard_match(spark, sf_dir):
    """A suffix wildcard as a prefix test, and a shell pattern."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", ((F.col("p_type") == "ECONOMY") | F.col("p_name").startswith("red ")).alias("prefix"), F.rlike("p_name", C.glob_to_regex(F.lit("*ring*"))).alias("globbed"))


@query("missing_types_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_types_anti(spark, sf_dir):
    have = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(have, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("data_requirements", "WITH a AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS have FROM orders GROUP BY o_custkey) SELECT o_custkey, list_has_all(have, ['1-URGENT', '5-LOW']) AS runnable, CAST(2 - len(list_intersect(have, ['1-URGENT', '5-LOW'])) AS INTEGER) AS missing FROM a")
def data_requirements(spark, sf_dir):
    """Algorithms whose required data types are all available: containment of arrays."""
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("have"))
    miss = F.size(F.array_except(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), "have"))
    return a.select("o_custkey", (miss == 0).alias("runnable"), miss.alias("missing"))


_STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS)
_KW = rf"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


@query("keyword_extract", f"WITH k AS (SELECT doc_id, {_KW} AS kw FROM documents) SELECT doc_id, CAST(len(kw) AS INTEGER) AS n, CAST(len(list_distinct(kw)) AS INTEGER) AS n_distinct, kw[1] AS first FROM k")
def keyword_extract(spark, sf_dir):
    k = table(spark, sf_dir, "documents").select("doc_id", C.keywords(F.col("text")).alias("kw"))
    return k.select("doc_id", F.size("kw").alias("n"), F.size(F.array_distinct("kw")).alias("n_distinct"), F.get("kw", F.lit(0)).alias("first"))


_CLASSES = {"news": ("then", "this", "that"), "news.local": ("there", "here", "onthe"), "recipe": ("ing", "with", "from"), "poem": ("than", "hand", "heat"), "french": ("les", "des", "que"), "german": ("und", "die", "der")}
_TAX = ", ".join(f"('{c}', '{w}')" for c, ws in _CLASSES.items() for w in ws)


@query(
    "intent_classify",
    f"""WITH k AS (SELECT doc_id, len(kw) AS n, unnest(list_distinct(kw)) AS w FROM (SELECT doc_id, {_KW} AS kw FROM documents)), t(class, w) AS (VALUES {_TAX}),
m AS (SELECT doc_id, class, count(*) AS hits, any_value(n) AS n FROM k JOIN t USING (w) GROUP BY ALL),
x AS (SELECT *, max(hits) OVER (PARTITION BY doc_id) AS top FROM m),
c AS (SELECT doc_id, class, least(hits / greatest(top, least(n, 3)) + 0.02 * (len(class) - len(replace(class, '.', ''))), 0.99) * CASE WHEN hits < top / 2 THEN 0.7 ELSE 1 END AS conf FROM x),
s AS (SELECT *, sum(conf) OVER (PARTITION BY doc_id) AS total FROM c), r AS (SELECT doc_id, class, CASE WHEN total > 1 THEN conf / total ELSE conf END AS conf FROM s)
SELECT doc_id, class, round(conf, 6) AS confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(conf, 9) DESC, class) AS rank FROM r) WHERE rank <= 3""",
)
def intent_classify(spark, sf_dir):
    """Keyword matches against a taxonomy (a literal table), confidences, top 3 alternatives of each text; only words of the taxonomy leave a text's array."""
    known = F.array(*(F.lit(w) for w in sorted({w for ws in _CLASSES.values() for w in ws})))
    k = table(spark, sf_dir, "documents").select("doc_id", C.keywords(F.col("text")).alias("kw")).select("doc_id", F.size("kw").alias("n"), F.explode(F.array_intersect("kw", known)).alias("w"))
    t = spark.createDataFrame([(c, w) for c, ws in _CLASSES.items() for w in ws], "class string, w string")
    m = k.join(F.broadcast(t), "w").groupBy("doc_id", "class").agg(F.count("*").alias("hits"), F.first("n").alias("n"))  # t is fixed
    w = W.partitionBy("doc_id")
    depth = F.length("class") - F.length(F.replace("class", F.lit("."), F.lit("")))
    x = m.withColumn("top", F.max("hits").over(w))
    conf = F.least(F.col("hits") / F.greatest("top", F.least("n", F.lit(3))) + 0.02 * depth, F.lit(0.99)) * F.when(F.col("hits") < F.col("top") / 2, 0.7).otherwise(1.0)
    s = x.withColumn("conf", conf).withColumn("total", F.sum("conf").over(w)).withColumn("conf", F.when(F.col("total") > 1, F.col("conf") / F.col("total")).otherwise(F.col("conf")))
    return C.top_per_group(s, 3, ["doc_id"], F.round("conf", 9).desc(), F.col("class")).select("doc_id", "class", rnd("conf").alias("confidence"), "rank")


@query("cache_key_hash", "SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderstatus, printf('%.4f', o_totalprice), CAST(o_custkey AS VARCHAR))), 1, 32) AS key, md5(o_orderpriority) AS checksum FROM orders")
def cache_key_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.sha_key(F.col("o_orderstatus"), F.format_string("%.4f", "o_totalprice"), F.col("o_custkey").cast("string")).alias("key"), F.md5("o_orderpriority").alias("checksum"))


@query(
    "eviction_running_sum",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS used FROM orders)
SELECT o_custkey, o_orderkey, used > 100000000 AS evicted FROM r""",
)
def eviction_running_sum(spark, sf_dir):
    """Least recently used first: what lies beyond the capacity of each cache, newest entries counted first; sums in whole cents."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w) > 100000000).alias("evicted"))


@query("latest_version", "SELECT o_custkey, max(o_orderdate)::VARCHAR AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_version(spark, sf_dir):
    """Latest row of each key without a sort."""
    best = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("latest"), best.alias("o_orderkey"))


@query("keep_latest_n", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 3 AND o_orderdate < TIMESTAMP '2000-01-01'")
def keep_latest_n(spark, sf_dir):
    """Checkpoints to delete: beyond the newest three of an execution and older than the cutoff."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).filter("n > 3 AND o_orderdate < '2000-01-01'").select("o_custkey", "o_orderkey")


@query(
    "tile_index",
    """WITH t AS (SELECT s_suppkey, CAST(s_suppkey * 71 % 340 - 170 AS DOUBLE) AS lon, CAST(s_suppkey * 29 % 150 - 75 AS DOUBLE) AS lat FROM supplier)
SELECT s_suppkey, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 1024) AS BIGINT) AS ty, CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS utm, round(111320.0 * cos(radians(lat)), 4) AS metres,
 CAST(ceil(5000 / 448.0) AS BIGINT) AS tiles_across FROM t WHERE NOT (lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12) AND NOT (lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42)""",
)
def tile_index(spark, sf_dir):
    """Web-Mercator tile, UTM zone (outside the exceptional zones), metres a degree, and tiles across 5000 pixels of 512 with overlap 32."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 71 % 340 - 170).cast("double").alias("lon"), (F.col("s_suppkey") * 29 % 150 - 75).cast("double").alias("lat"))
    lon, lat = F.col("lon"), F.col("lat")
    t = t.filter(~((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)) & ~((lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42)))
    x, y = E.mercator_tile(lon, lat, 10)
    return t.select("s_suppkey", x.cast("long").alias("tx"), y.cast("long").alias("ty"), E.utm_zone(lon, lat).alias("utm"), rnd(E.metres_per_degree(lat), 4).alias("metres"), F.ceil(F.lit(5000) / 448.0).alias("tiles_across"))


@query(
    "antimeridian_boxes",
    """WITH b AS (SELECT s_suppkey, CAST(s_suppkey * 71 % 340 - 170 AS DOUBLE) AS w, CASE WHEN s_suppkey * 71 % 340 - 170 + s_suppkey % 40 > 180 THEN s_suppkey * 71 % 340 - 530.0 + s_suppkey % 40 ELSE s_suppkey * 71 % 340 - 170.0 + s_suppkey % 40 END AS e FROM supplier)
SELECT s_suppkey, w > e AS crosses, CAST(CASE WHEN w <= e THEN e - w ELSE 360 - w + e END AS DOUBLE) AS width, CASE WHEN w > e THEN true ELSE w <= -170 OR e >= 170 END AS meets_query FROM b""",
)
def antimeridian_boxes(spark, sf_dir):
    """Boxes over the antimeridian against a query box from 170 to -170 degrees."""
    k = F.col("s_suppkey")
    w = (k * 71 % 340 - 170).cast("double")
    e = w + k % 40
    b = table(spark, sf_dir, "supplier").select("s_suppkey", w.alias("w"), F.when(e > 180, e - 360).otherwise(e).alias("e"))
    box = [F.col("w"), F.lit(-10.0), F.col("e"), F.lit(10.0)]
    return b.select("s_suppkey", (F.col("w") > F.col("e")).alias("crosses"), E.box_width(F.col("w"), F.col("e")).alias("width"), E.boxes_intersect(box, [F.lit(170.0), F.lit(-5.0), F.lit(-170.0), F.lit(5.0)]).alias("meets_query"))


@query("text_context", "SELECT doc_id, CASE WHEN contains(lower(text), 'after') OR contains(lower(text), 'then') THEN 'post_event' WHEN contains(lower(text), 'during') THEN 'active' WHEN contains(lower(text), 'before') THEN 'pre_event' END AS temporal_context, contains(lower(text), 'storm') OR contains(lower(text), 'hean') AS caused FROM documents")
def text_context(spark, sf_dir):
    low = F.lower("text")
    has = lambda *w: F.greatest(*(F.contains(low, F.lit(x)) for x in w))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(has("after", "then"), "post_event").when(F.contains(low, F.lit("during")), "active").when(F.contains(low, F.lit("before")), "pre_event").alias("temporal_context"), has("storm", "hean").alias("caused"))


@query("json_metadata", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, event_type || ':' || regexp_extract(props, '[0-9]+') AS tag, sha256(props) AS digest FROM events")
def json_metadata(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("int").alias("k"), F.concat_ws(":", "event_type", k).alias("tag"), F.sha2("props", 256).alias("digest"))


@query("set_difference", "WITH c AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-28'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03') SELECT *, 'new' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM b EXCEPT SELECT * FROM c)")
def set_difference(spark, sf_dir):
    """New and resolved issue keys: one pass over the rows instead of two set operations."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max((F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz")).cast("int")).alias("now"), F.max((F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")).cast("int")).alias("past"))
    return e.filter("now <> past").select("user_id", "event_type", F.when(F.col("now") == 1, "new").otherwise("resolved").alias("change"))


@query("provider_pairs", "WITH a AS (SELECT unnest(['optical', 'sar', 'dem']) AS adapter) SELECT adapter, n_name AS provider FROM a, nation WHERE (adapter = 'sar' AND n_nationkey % 2 = 0) OR (adapter = 'optical' AND n_nationkey % 3 = 0) OR (adapter = 'dem' AND n_nationkey % 5 = 0)")
def provider_pairs(spark, sf_dir):
    """Adapters against the providers that they support."""
    n = table(spark, sf_dir, "nation")
    supports = F.array_compact(F.array(*(F.when(F.col("n_nationkey") % m == 0, F.lit(a)) for a, m in (("sar", 2), ("optical", 3), ("dem", 5)))))
    return n.select(F.explode(supports).alias("adapter"), F.col("n_name").alias("provider"))
