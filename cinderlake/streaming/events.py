"""Structured Streaming over the event table: windows, de-duplication and sessions.

Each function takes a streaming (or batch) DataFrame and returns one; ``run_once`` drives a query over what is available into a
written table, with its checkpoint in the shared folder, so that a restarted run goes on where the last one ended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder


def source(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table as a stream with a time-zoned event time ``at`` (streams need that type for watermarks)."""
    batch = spark.read.parquet(f"{folder}/{name}.parquet")
    # a stream reads files by pattern; a table of part files is a folder
    path = f"{folder}/{name}.parquet"
    single = batch.inputFiles()[0].rsplit("/", 1)[-1] == f"{name}.parquet"
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/{name}[.]parquet" if single else path)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, *by: str) -> DataFrame:
    w = F.window("at", width)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, *by: str) -> DataFrame:
    return events.groupBy(F.window("at", width, step).alias("w"), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, *by: str) -> DataFrame:
    return events.groupBy(F.session_window("at", gap).alias("w"), *by).agg(F.count("*").alias("n"))


def deduplicate(events: DataFrame, lateness: str, *keys: str) -> DataFrame:
    """One event for each key within the lateness."""
    return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(list(keys))


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run over all available input and return what was written.  In complete mode each batch replaces the table."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{root}/out")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out"))
    q = writer.start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def live(events: DataFrame, ttl_seconds: str, now: str) -> DataFrame:
    """Messages whose time to live has not passed at ``now``."""
    return events.filter(F.unix_timestamp("at") + F.col(ttl_seconds) > F.unix_timestamp(F.lit(now).cast("timestamp")))


def dispatch(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event to each hook that takes its type: a stream-static join; subscriptions (hook, types) are read anew for each batch."""
    hooks = subscriptions.select("hook", F.explode("types").alias("event_type"))
    return events.join(hooks, "event_type")


def request_rate(events: DataFrame, by: str, seconds: int) -> DataFrame:
    """Exact sliding counts: for each event the client's events strictly later than ``seconds`` before it.

    The state of a client is the times of its last ``seconds``; it is dropped when the client has been silent for longer.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    width = seconds * 1_000_000

    def count(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        got = pd.concat(list(frames)).sort_values(["t", "event_id"])
        times, lo, out = recent + got["t"].tolist(), 0, []
        times.sort()
        for n, t in enumerate(times):
            while times[lo] <= t - width:
                lo += 1
            last = n + 1
            while last < len(times) and times[last] == t:
                last += 1
            out.append((t, last - lo))
        counts = dict(out)
        state.update((times[lo:],))
        state.setTimeoutTimestamp(times[-1] // 1000 + seconds * 1000 + 1)
        yield pd.DataFrame({"event_id": got["event_id"], by: key[0], "n": got["t"].map(counts)})

    rows = events.withWatermark("at", "1 minute").select("event_id", by, "at", F.unix_micros("at").alias("t"))
    return rows.groupBy(by).applyInPandasWithState(count, f"event_id long, {by} long, n long", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
