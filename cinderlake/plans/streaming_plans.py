"""Streaming queries over ``events`` (read as a stream, run over all available input) against their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators.temporal import epoch
from ..streaming import events as S
from .registry import query


def _start(w="w.start"):
    return epoch(w).alias("start")


@query("stream_tumbling", "SELECT CAST(floor(epoch(ts)) AS BIGINT) // 86400 * 86400 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = S.run_once(S.tumbling(S.source(spark, sf_dir), "1 day", "event_type"), "complete")
    return out.select(_start(), "event_type", "n", rnd("total", 4).alias("total"))


@query(
    "stream_sliding_rate",
    "WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), w AS (SELECT user_id, t // 21600 * 21600 - k * 21600 AS start FROM e, (SELECT unnest(range(0, 4)) AS k)) SELECT start, user_id, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1",
)
def stream_sliding_rate(spark, sf_dir):
    """Requests per client in windows of a day every six hours."""
    out = S.run_once(S.sliding(S.source(spark, sf_dir), "24 hours", "6 hours", "user_id"), "complete")
    return out.filter("n > 1").select(_start(), "user_id", "n")


@query("stream_dedupe", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe(spark, sf_dir):
    """One event a key; the lateness covers the whole input here, so the result is the set of keys."""
    out = S.run_once(S.deduplicate(S.source(spark, sf_dir), "60 days", "user_id", "event_type"))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_session",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT user_id, t, sum(opens) OVER (PARTITION BY user_id ORDER BY t) AS k FROM e)
SELECT user_id, CAST(min(t) // 1000000 AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session(spark, sf_dir):
    """Sessions of a client that end after an hour of silence."""
    out = S.run_once(S.sessions(S.source(spark, sf_dir), "1 hour", "user_id"), "complete")
    return out.select("user_id", _start(), "n")


@query(
    "stream_watermark",
    "WITH w AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 86400 * 86400 AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT start, event_type, n FROM w WHERE start + 86400 <= (SELECT max(epoch(ts)) FROM events) - 3600",
)
def stream_watermark(spark, sf_dir):
    """Append mode: windows that the watermark (an hour behind) has closed."""
    events = S.source(spark, sf_dir).withWatermark("at", "1 hour")
    return S.run_once(S.tumbling(events, "1 day", "event_type").select("w", "event_type", "n")).select(_start(), "event_type", "n")


@query(
    "stream_dispatch",
    "WITH s AS (SELECT unnest(['audit', 'billing', 'alerts', 'alerts']) AS hook, unnest(['view', 'purchase', 'error', 'signup']) AS event_type) SELECT hook, event_type, count(*) AS n FROM events JOIN s USING (event_type) WHERE epoch(ts) + 3600 * (event_id % 200) > epoch(TIMESTAMP '2024-01-12 00:00:00') GROUP BY ALL",
)
def stream_dispatch(spark, sf_dir):
    """Live messages to the hooks that subscribe to them."""
    hooks = spark.createDataFrame([("audit", ["view"]), ("billing", ["purchase"]), ("alerts", ["error", "signup"])], "hook string, types array<string>")
    events = S.source(spark, sf_dir).withColumn("ttl", 3600 * (F.col("event_id") % 200))
    out = S.run_once(S.dispatch(S.live(events, "ttl", "2024-01-12 00:00:00"), hooks).select("event_id", "event_type", "hook"))
    return out.groupBy("hook", "event_type").agg(F.count("*").alias("n"))


@query("stream_rate_limit", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events")
def stream_rate_limit(spark, sf_dir):
    """Exact requests in the hour before each request, kept as state per client."""
    return S.run_once(S.request_rate(S.source(spark, sf_dir), "user_id", 3600))
