"""Time-series queries over ``events`` (series: event type or user) and ``orders``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import temporal as T
from .registry import query, table

_EP = "CAST(floor(epoch(ts)) AS BIGINT)"
JAN, FEB = 1704067200, 1706745600  # 2024-01-01 and 2024-02-01


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("quality", 1 - F.get_json_object("props", "$.k").cast("int") / 100)


def series(spark, sf_dir):
    """event_type, user_id, id, t (seconds), value."""
    return table(spark, sf_dir, "events").select("event_type", "user_id", F.col("event_id").alias("id"), T.epoch("ts").alias("t"), "value")


@query(
    "temporal_bins",
    f"""SELECT event_type, {_EP} // 21600 * 21600 AS start, CAST({_EP} // 21600 * 21600 + 10800 AS DOUBLE) AS centre, round(avg(value) + 1e-9, 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum,
 count(*) AS count, arg_min(value, (ts, value)) AS first, arg_max(value, (ts, value)) AS last, round(avg(1 - CAST(regexp_extract(props, '[0-9]+') AS INT) / 100) + 1e-9, 6) AS quality FROM events GROUP BY ALL""",
)
def temporal_bins(spark, sf_dir):
    b = T.bin_aggregate(events(spark, sf_dir), 21600, "value", "quality", "event_type")
    return b.select("event_type", "start", "centre", rnd(F.col("mean") + 1e-9).alias("mean"), rnd("median").alias("median"), "min", "max", rnd("sum", 4).alias("sum"), "count", "first", "last", rnd(F.col("quality") + 1e-9).alias("quality"))


@query(
    "anchored_bins",
    f"""WITH e AS (SELECT *, {_EP} - 1704070800 AS off, 1 - CAST(regexp_extract(props, '[0-9]+') AS INT) / 100 AS q FROM events),
b AS (SELECT off // 43200 AS bin, value, q FROM e WHERE off >= 0 AND off < 2500000)
SELECT bin, 'bin_' || bin AS label, count(*) AS layers, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(sum(q * value) / CASE WHEN sum(q) = 0 THEN 1 ELSE sum(q) END, 6) AS weighted, count(CASE WHEN q > 0 THEN 1 END) AS coverage FROM b GROUP BY bin""",
)
def anchored_bins(spark, sf_dir):
    """Bins anchored at the start time, half-open; a layer exactly at the end is left out."""
    begin, length, width = 1704070800, 2500000, 43200
    off = T.epoch("ts") - begin
    e = events(spark, sf_dir).withColumn("off", off).filter((F.col("off") >= 0) & (F.col("off") < length))
    w = F.sum("quality")
    return e.groupBy(F.floor(F.col("off") / width).alias("bin")).agg(
        F.count("*").alias("layers"), rnd(F.avg("value")).alias("mean"), rnd(F.median("value")).alias("median"), rnd(F.sum(F.col("quality") * F.col("value")) / F.when(w == 0, 1).otherwise(w)).alias("weighted"), F.count(F.when(F.col("quality") > 0, 1)).alias("coverage"),
    ).withColumn("label", F.concat(F.lit("bin_"), F.col("bin")))


def targets(spark, sf_dir, hours=6):
    """Every series at every ``hours`` of January 2024."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    steps = F.sequence(F.lit(JAN).cast("long"), F.lit(FEB).cast("long"), F.lit(hours * 3600).cast("long"))
    return kinds.select("event_type", F.explode(steps).alias("t"))


_TARGETS = "g AS (SELECT event_type, unnest(range(1704067200, 1706745601, 21600)) AS target FROM (SELECT DISTINCT event_type FROM events))"


@query(
    "asof_interpolate",
    f"""WITH s AS (SELECT event_type, {_EP} AS t, max(value) AS value FROM events GROUP BY ALL), {_TARGETS},
b AS (SELECT g.event_type, g.target, s.t AS bt, s.value AS bv FROM g ASOF LEFT JOIN s ON g.event_type = s.event_type AND g.target >= s.t),
a AS (SELECT b.*, s.t AS nt, s.value AS av FROM b ASOF LEFT JOIN s ON b.event_type = s.event_type AND b.target <= s.t)
SELECT event_type, target, round(CASE WHEN bt IS NULL OR nt IS NULL THEN coalesce(bv, av) WHEN nt = bt THEN bv ELSE bv + (av - bv) * (target - bt) / (nt - bt) END, 5) AS value,
 round(CASE WHEN bt IS NULL OR nt IS NULL THEN 0.5 ELSE 1 - 0.3 * least(least(target - bt, nt - target) / 3600, 24) / 24 END, 6) AS quality FROM a WHERE bt IS NOT NULL OR nt IS NOT NULL""",
)
def asof_interpolate(spark, sf_dir):
    """Linear interpolation at target times, quality decaying with the distance; extrapolation at half quality."""
    s = series(spark, sf_dir).groupBy("event_type", "t").agg(F.max("value").alias("value"))
    m = T.bracket(targets(spark, sf_dir), s, "event_type", 86400)
    b, a, t = F.col("before"), F.col("after"), F.col("target")
    one = b.isNull() | a.isNull()
    line = b["value"] + (a["value"] - b["value"]) * (t - b["t"]) / F.nullif(a["t"] - b["t"], F.lit(0))
    value = F.when(one, F.coalesce(b["value"], a["value"])).when(a["t"] == b["t"], b["value"]).otherwise(line)
    hours = F.least(F.least(t - b["t"], a["t"] - t) / 3600, F.lit(24))
    return m.filter(b.isNotNull() | a.isNotNull()).select("event_type", "target", rnd(value, 5).alias("value"), rnd(F.when(one, 0.5).otherwise(1 - 0.3 * hours / 24)).alias("quality"))


@query(
    "nearest_align",
    f"""WITH s AS (SELECT event_type, {_EP} AS t, max(value) AS value FROM events GROUP BY ALL), {_TARGETS},
m AS (SELECT g.event_type, target, s.t AS sample, value, abs(s.t - target) AS gap, row_number() OVER (PARTITION BY g.event_type, target ORDER BY abs(s.t - target), s.t) AS rn FROM g JOIN s ON g.event_type = s.event_type AND s.t BETWEEN target - 3600 AND target + 3600)
SELECT event_type, target, sample, value, gap FROM m WHERE rn = 1""",
)
def nearest_align(spark, sf_dir):
    s = series(spark, sf_dir).groupBy("event_type", "t").agg(F.max("value").alias("value"))
    return T.nearest_within(targets(spark, sf_dir), s, "event_type", 3600)


@query(
    "overlap_times",
    f"""WITH s AS (SELECT DISTINCT event_type, {_EP} AS t FROM events)
SELECT t FROM s a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM s b WHERE b.event_type = 'click' AND b.t BETWEEN a.t - 600 AND a.t + 600) AND EXISTS (SELECT 1 FROM s b WHERE b.event_type = 'purchase' AND b.t BETWEEN a.t - 600 AND a.t + 600)""",
)
def overlap_times(spark, sf_dir):
    """Times of the first series with a sample within tolerance in every other: semi joins on time cells."""
    tol = 600
    s = series(spark, sf_dir).select("event_type", "t").distinct()
    out = s.filter("event_type = 'view'").select("t")
    for kind in ("click", "purchase"):
        other = s.filter(F.col("event_type") == kind).select(F.col("t").alias("o"), F.floor(F.col("t") / tol).alias("cell"))
        near = out.withColumn("cell", F.explode(F.array(*(F.floor(F.col("t") / tol) + k for k in (-1, 0, 1))))).join(other, "cell").filter(F.abs(F.col("t") - F.col("o")) <= tol)
        out = out.join(near.select("t").distinct(), "t", "left_semi")
    return out


@query(
    "time_match",
    """WITH f AS (SELECT event_id AS fid, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'view'), o AS (SELECT event_id AS oid, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'click'),
m AS (SELECT fid, oid, abs(f.t - o.t) AS gap, row_number() OVER (PARTITION BY fid ORDER BY CASE WHEN f.t = o.t THEN 0 ELSE 1 END, o.t, oid) AS rn FROM f JOIN o ON f.user_id = o.user_id AND abs(f.t - o.t) < 1800)
SELECT fid, oid, gap FROM m WHERE rn = 1""",
)
def time_match(spark, sf_dir):
    """Exact match first, else the first observation under 1800 s away."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", T.epoch("ts").alias("t"))
    f = e.filter("event_type = 'view'").select(F.col("event_id").alias("fid"), "user_id", "t", F.explode(F.array(*(F.floor(F.col("t") / 1800) + k for k in (-1, 0, 1)))).alias("cell"))
    o = e.filter("event_type = 'click'").select(F.col("event_id").alias("oid"), "user_id", F.col("t").alias("ot"), F.floor(F.col("t") / 1800).alias("cell"))
    m = f.join(o, ["user_id", "cell"]).withColumn("gap", F.abs(F.col("t") - F.col("ot"))).filter("gap < 1800")
    best = F.min_by(F.struct("oid", "gap"), F.struct((F.col("gap") != 0).cast("int"), "ot", "oid"))
    return m.groupBy("fid").agg(best.alias("b")).select("fid", "b.oid", "b.gap")


@query(
    "pre_post_pair",
    """WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1998-07-01', CAST(o_orderdate AS DATE)) AS d, o_totalprice / 5000 AS cloud FROM orders),
k AS (SELECT *, CASE WHEN d BETWEEN -365 AND -1 THEN 'pre' WHEN d BETWEEN 1 AND 365 THEN 'post' END AS side FROM o WHERE cloud <= 80)
SELECT o_custkey, arg_min(o_orderkey, (cloud, o_orderkey)) FILTER (WHERE side = 'pre') AS pre, arg_min(o_orderkey, (cloud, o_orderkey)) FILTER (WHERE side = 'post') AS post FROM k WHERE side IS NOT NULL GROUP BY o_custkey HAVING count(DISTINCT side) = 2""",
)
def pre_post_pair(spark, sf_dir):
    """The clearest scene on either side of an event: one conditional aggregate instead of two joins."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff(F.col("o_orderdate"), F.lit("1998-07-01").cast("date")).alias("d"), (F.col("o_totalprice") / 5000).alias("cloud")).filter("cloud <= 80 AND d BETWEEN -365 AND 365 AND d <> 0")
    side = lambda c: F.min_by(F.when(c, F.col("o_orderkey")), F.when(c, F.struct("cloud", "o_orderkey")))
    return o.groupBy("o_custkey").agg(side(F.col("d") < 0).alias("pre"), side(F.col("d") > 0).alias("post")).dropna()


@query(
    "gap_detection",
    f"""WITH s AS (SELECT DISTINCT event_type, {_EP} AS t FROM events), n AS (SELECT event_type, t, lead(t) OVER w AS nxt, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY event_type ORDER BY t)),
g AS (SELECT event_type, t AS start, coalesce(nxt, 1706745600) AS stop FROM n UNION ALL SELECT event_type, 1704067200, t FROM n WHERE n = 1) SELECT event_type, start, stop FROM g WHERE stop - start > 3600""",
)
def gap_detection(spark, sf_dir):
    return T.gaps(series(spark, sf_dir).select("event_type", "t").distinct(), "event_type", 3600, JAN, FEB)


@query(
    "densify",
    f"""WITH s AS (SELECT DISTINCT event_type, {_EP} AS t FROM events), n AS (SELECT t, lead(t) OVER (ORDER BY t) AS nxt FROM s WHERE event_type = 'signup'),
f AS (SELECT DISTINCT s.t FROM s JOIN n ON s.t > n.t AND s.t < n.nxt WHERE s.event_type = 'view' AND n.nxt - n.t > 7200)
SELECT t, 'primary' AS origin FROM s WHERE event_type = 'signup' UNION ALL SELECT t, 'filler' FROM f WHERE t NOT IN (SELECT t FROM s WHERE event_type = 'signup')""",
)
def densify(spark, sf_dir):
    """Fillers strictly inside a long gap of the primary series: an as-of bracket finds each filler's gap, so no range join is needed."""
    s = series(spark, sf_dir)
    primary = s.filter("event_type = 'signup'").select(F.lit(0).alias("k"), "t", F.lit(0.0).alias("value")).distinct()
    filler = s.filter("event_type = 'view'").select(F.lit(0).alias("k"), "t").distinct()
    m = T.bracket(filler, primary, "k", 86400).filter(F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before.t") < F.col("target")) & (F.col("after.t") > F.col("target")) & (F.col("after.t") - F.col("before.t") > 7200))
    return primary.select("t", F.lit("primary").alias("origin")).union(m.select(F.col("target").alias("t"), F.lit("filler").alias("origin")))


def _steps(spark, sf_dir):
    """Per user in time order: value, t and those of the row before."""
    w = W.partitionBy("user_id").orderBy("t", "id")
    s = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), T.micros("ts").alias("t"), "value")
    return s.withColumn("pv", F.lag("value").over(w)).withColumn("pt", F.lag("t").over(w))


_STEPS = "s AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t, value, lag(value) OVER w AS pv, lag(epoch_us(ts)) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(
    "rate_of_change",
    f"""WITH {_STEPS}, r AS (SELECT user_id, id, (value - pv) / ((t - pt) / 3600000000) AS rate FROM s WHERE t > pt),
m AS (SELECT user_id, CASE WHEN stddev_pop(abs(rate)) > 0 THEN avg(abs(rate)) + 2 * stddev_pop(abs(rate)) ELSE 10 * avg(abs(rate)) END AS lim FROM r GROUP BY user_id)
SELECT user_id, id, round(rate, 3) AS rate FROM r JOIN m USING (user_id) WHERE abs(rate) > lim""",
)
def rate_of_change(spark, sf_dir):
    r = _steps(spark, sf_dir).filter("t > pt").select("user_id", "id", ((F.col("value") - F.col("pv")) / ((F.col("t") - F.col("pt")) / 3600000000)).alias("rate"))
    size = F.abs("rate")
    m = r.groupBy("user_id").agg(F.when(F.stddev_pop(size) > 0, F.avg(size) + 2 * F.stddev_pop(size)).otherwise(10 * F.avg(size)).alias("lim"))
    return r.join(m, "user_id").filter(size > F.col("lim")).select("user_id", "id", rnd("rate", 3).alias("rate"))


@query(
    "sudden_change",
    f"""WITH {_STEPS}, d AS (SELECT user_id, id, value - pv AS diff FROM s WHERE pv IS NOT NULL), m AS (SELECT user_id, avg(diff) AS mu, stddev_pop(diff) AS sd FROM d GROUP BY user_id)
SELECT user_id, id, round((diff - mu) / sd, 6) AS z FROM d JOIN m USING (user_id) WHERE sd > 1e-9 AND abs((diff - mu) / sd) > 3""",
)
def sudden_change(spark, sf_dir):
    d = _steps(spark, sf_dir).filter("pv IS NOT NULL").select("user_id", "id", (F.col("value") - F.col("pv")).alias("diff"))
    m = d.groupBy("user_id").agg(F.avg("diff").alias("mu"), F.stddev_pop("diff").alias("sd")).filter("sd > 1e-9")
    z = (F.col("diff") - F.col("mu")) / F.col("sd")
    return d.join(m, "user_id").filter(F.abs(z) > 3).select("user_id", "id", rnd(z).alias("z"))


@query(
    "monotonicity",
    f"""WITH {_STEPS} SELECT user_id, count(CASE WHEN value > pv THEN 1 END) AS up, count(CASE WHEN value < pv THEN 1 END) AS down, count(CASE WHEN value = pv THEN 1 END) AS flat,
 round(least(count(CASE WHEN value > pv THEN 1 END), count(CASE WHEN value < pv THEN 1 END)) / nullif(count(pv), 0), 6) AS violation FROM s GROUP BY user_id""",
)
def monotonicity(spark, sf_dir):
    v, p = F.col("value"), F.col("pv")
    up, down = F.count(F.when(v > p, 1)), F.count(F.when(v < p, 1))
    return _steps(spark, sf_dir).groupBy("user_id").agg(up.alias("up"), down.alias("down"), F.count(F.when(v == p, 1)).alias("flat"), rnd(F.least(up, down) / F.nullif(F.count("pv"), F.lit(0))).alias("violation"))


@query(
    "lag1_autocorr",
    """WITH m AS (SELECT user_id, avg(value) AS mu, var_pop(value) AS v FROM events GROUP BY user_id),
s AS (SELECT e.user_id, value - mu AS x, lead(value) OVER (PARTITION BY e.user_id ORDER BY ts, event_id) - mu AS y, v FROM events e JOIN m USING (user_id))
SELECT user_id, round(avg(x * y) / any_value(v), 6) AS autocorr, count(y) AS n FROM s WHERE v > 1e-12 GROUP BY user_id""",
)
def lag1_autocorr(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    m = e.groupBy("user_id").agg(F.avg("value").alias("mu"), F.var_pop("value").alias("v")).filter("v > 1e-12")
    nxt = e.withColumn("nxt", F.lead("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).join(m, "user_id")
    y = F.col("nxt") - F.col("mu")
    return nxt.groupBy("user_id").agg(rnd(F.avg((F.col("value") - F.col("mu")) * y) / F.first("v")).alias("autocorr"), F.count("nxt").alias("n"))


@query(
    "exceedance_runs",
    """WITH s AS (SELECT user_id, event_id, ts, value > 50 AS hot, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
i AS (SELECT user_id, n - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s WHERE hot), r AS (SELECT user_id, count(*) AS len FROM i GROUP BY user_id, k),
p AS (SELECT user_id, avg(CAST(hot AS INT)) AS prob FROM s GROUP BY user_id) SELECT user_id, count(*) AS runs, round(avg(len), 6) AS mean_run, max(len) AS max_run, round(any_value(prob), 6) AS probability FROM r JOIN p USING (user_id) GROUP BY user_id""",
)
def exceedance_runs(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("t"), (F.col("value") > 50).alias("hot"))
    r = T.runs(s, "user_id", "hot").groupBy("user_id").agg(F.count("*").alias("runs"), rnd(F.avg("length")).alias("mean_run"), F.max("length").alias("max_run"))
    return r.join(s.groupBy("user_id").agg(rnd(F.avg(F.col("hot").cast("int"))).alias("probability")), "user_id")


@query(
    "revisit_stats",
    f"""WITH s AS (SELECT event_type, {_EP} - lag({_EP}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT event_type, count(*) AS acquisitions, round(avg(gap) / 3600, 6) AS mean_revisit_h, max(gap) AS max_gap_s FROM s GROUP BY event_type""",
)
def revisit_stats(spark, sf_dir):
    """Times between acquisitions of each kind; a kind's rows are ordered by the day, not all in one task."""
    s = T.with_prior(table(spark, sf_dir, "events").select("event_type", T.epoch("ts").alias("t")), "event_type", 86400).withColumn("gap", F.col("t") - F.col("prior"))
    return s.groupBy("event_type").agg(F.count("*").alias("acquisitions"), rnd(F.avg("gap") / 3600).alias("mean_revisit_h"), F.max("gap").alias("max_gap_s"))


@query(
    "forward_fill",
    """WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
g AS (SELECT user_id, CAST(CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day FROM (SELECT DISTINCT user_id FROM events), (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events))
SELECT g.user_id, g.day, last_value(value IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.day) AS value FROM g LEFT JOIN d ON g.user_id = d.user_id AND g.day = d.day""",
)
def forward_fill(spark, sf_dir):
    """Step interpolation on a daily grid over the days of the table."""
    e = table(spark, sf_dir, "events")
    d = e.filter("event_type = 'view'").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("value").alias("value"))
    span = e.agg(F.min("ts").cast("date").alias("lo"), F.max("ts").cast("date").alias("hi"))
    days = F.transform(F.sequence("lo", "hi"), lambda x: F.date_format(x, "yyyy-MM-dd"))
    g = e.select("user_id").distinct().crossJoin(F.broadcast(span)).select("user_id", F.explode(days).alias("day"))  # one row
    w = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return g.join(d, ["user_id", "day"], "left").select("user_id", "day", F.last("value", True).over(w).alias("value"))


@query(
    "request_counter",
    """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_hour FROM events""",
)
def request_counter(spark, sf_dir):
    """Exact sliding count per client: strictly later than an hour ago."""
    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-3599999999, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", T.micros("ts").alias("t")).select("event_id", "user_id", F.count("*").over(w).alias("in_hour"))


_DAYS = "d AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT f.user_id, f.day, f.v AS f, o.v AS o FROM d f JOIN d o ON f.user_id = o.user_id AND o.day = f.day + 1)"


def forecast_pairs(spark, sf_dir):
    """Persistence forecast: a user's daily mean against that of the next day."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.avg("value").alias("v"))
    return d.select("user_id", (F.col("day") + 1).alias("day"), F.col("v").alias("f")).join(d.withColumnRenamed("v", "o"), ["user_id", "day"]).select("user_id", (F.col("day") - 1).alias("day"), "f", "o")


def verification(p, *by):
    e = F.col("f") - F.col("o")
    return p.groupBy(*by).agg(F.count("*").alias("n"), rnd(F.sqrt(F.avg(e * e))).alias("rmse"), rnd(F.avg(F.abs(e))).alias("mae"), rnd(F.avg(e)).alias("bias"), rnd(F.corr("f", "o")).alias("corr"), rnd(1 - F.var_pop(e) / F.nullif(F.var_pop("o"), F.lit(0.0))).alias("explained"))


_VER = "count(*) AS n, round(sqrt(avg(pow(f - o, 2))), 6) AS rmse, round(avg(abs(f - o)), 6) AS mae, round(avg(f - o), 6) AS bias, round(corr(f, o), 6) AS corr, round(1 - var_pop(f - o) / nullif(var_pop(o), 0), 6) AS explained"


@query("forecast_verify", f"WITH {_DAYS} SELECT {_VER} FROM p")
def forecast_verify(spark, sf_dir):
    return verification(forecast_pairs(spark, sf_dir))


@query("lead_time_metrics", f"WITH {_DAYS} SELECT day % 4 AS lead, {_VER} FROM p GROUP BY day % 4")
def lead_time_metrics(spark, sf_dir):
    return verification(forecast_pairs(spark, sf_dir).withColumn("lead", F.col("day") % 4), "lead")


@query(
    "contingency",
    f"""WITH {_DAYS}, t AS (SELECT unnest([10.0, 25.0, 50.0, 100.0])::DOUBLE AS threshold),
c AS (SELECT threshold, count(CASE WHEN f >= threshold AND o >= threshold THEN 1 END)::DOUBLE AS a, count(CASE WHEN f >= threshold AND o < threshold THEN 1 END)::DOUBLE AS b,
 count(CASE WHEN f < threshold AND o >= threshold THEN 1 END)::DOUBLE AS c, count(CASE WHEN f < threshold AND o < threshold THEN 1 END)::DOUBLE AS d FROM p, t GROUP BY threshold)
SELECT threshold, a AS hits, b AS false_alarms, c AS misses, d AS rejections, round(a / nullif(a + c, 0), 6) AS pod, round(b / nullif(a + b, 0), 6) AS far, round(a / nullif(a + b + c, 0), 6) AS csi, round((a + b) / nullif(a + c, 0), 6) AS bias,
 round(2 * (a * d - b * c) / nullif((a + c) * (c + d) + (a + b) * (b + d), 0), 6) AS hss, round(a / nullif(a + c, 0) - b / nullif(b + d, 0), 6) AS pss FROM c""",
)
def contingency(spark, sf_dir):
    """All thresholds in one pass: rows are expanded by the four thresholds and counted with partial aggregates."""
    p = forecast_pairs(spark, sf_dir).withColumn("threshold", F.explode(F.array(*(F.lit(x) for x in (10.0, 25.0, 50.0, 100.0)))))
    f, o = F.col("f") >= F.col("threshold"), F.col("o") >= F.col("threshold")
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    g = p.groupBy("threshold").agg(n(f & o).alias("a"), n(f & ~o).alias("b"), n(~f & o).alias("c"), n(~f & ~o).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    over = F.try_divide
    made = {"pod": over(a, a + c), "far": over(b, a + b), "csi": over(a, a + b + c), "bias": over(a + b, a + c), "hss": over(2 * (a * d - b * c), (a + c) * (c + d) + (a + b) * (b + d)), "pss": over(a, a + c) - over(b, b + d)}
    return g.select("threshold", a.alias("hits"), b.alias("false_alarms"), c.alias("misses"), d.alias("rejections"), *(rnd(v).alias(k) for k, v in made.items()))
