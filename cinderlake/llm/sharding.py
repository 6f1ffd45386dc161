"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

A group is all rows with one text.  A group stays whole unless it has over 1/``heavy`` of the table's bytes or rows (half a shard by default), which no shard
may have room for; it is then cut into the fewest pieces of that size, its rows being dealt to the pieces in turn.  What is packed is crates: each group (or piece of one) with over
1/``LARGE`` of the table is a crate of its own, so the rule acts on groups wherever they matter; smaller groups are hashed whole into ``crates`` others (a parameter, so that the number of crates does not grow with the
input).  Only
the crates' sums are packed: in descending size each goes where the dot product of its vector with the shards' residual capacity is
highest among shards that it fits, all three dimensions being scaled by their totals.  Then crates move or swap between
the fullest and emptiest shard in bytes while that narrows the gap.  The list of crates (three numbers each) is the only thing the driver sees.

Slots number a shard's rows from 0 without gaps: a crate's rows are dealt into ``LANES`` lanes and numbered within each by (doc_id, text); a
lane begins where the crate's earlier lanes end, and a crate where the shard's earlier crates end, so that no task holds a whole shard or a hot group.

With an ``order`` (each row's place ``at`` in a sequence of the whole table, as that of a mix's files) a shard's slots follow that sequence instead: rows are
counted by shard and stretch of ``STRETCH`` places, numbered within a stretch, and a stretch begins where the shard's earlier ones end.

Law: ``bytes`` (sizes near equal).  Edge cases: a null text has size 1, crc32 0 and no tokens; null doc_ids sort first; repeated
rows are numbered in any order among themselves; an empty table gives no rows; extra columns are ignored by ``shard`` and
kept by ``shard_documents``, whose own columns replace any of the same names.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

SHARDS, CRATES, LARGE, LANES, STRETCH = 8, 4096, 1024, 16, 4096


def pack(sums: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each crate; ``sums`` is (crates, 3): bytes, tokens, rows."""
    return even_out(sums, first_places(sums, shards), shards)


def first_places(sums: np.ndarray, shards: int) -> np.ndarray:
    scaled = sums / np.maximum(sums.sum(axis=0), 1)
    room = np.full((shards, 3), 1.0 / shards)
    place = np.zeros(len(sums), np.int64)
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        fits = (room - scaled[i] >= -1e-12).all(axis=1)
        score = np.where(fits, room @ scaled[i], -np.inf) if fits.any() else room.min(axis=1)
        place[i] = int(np.argmax(score))
        room[place[i]] -= scaled[i]
    return place


def even_out(sums: np.ndarray, place: np.ndarray, shards: int, rounds: int = 2000) -> np.ndarray:
    """Move a crate, or swap two, between the fullest and emptiest shard in bytes while the gap narrows; of the
    choices within a hair of the best the one that keeps rows most even is taken."""
    size, rows = sums[:, 0].astype(float), sums[:, 2].astype(float)
    load = np.bincount(place, weights=size, minlength=shards)
    count = np.bincount(place, weights=rows, minlength=shards)
    for _ in range(rounds):
        big, small = int(load.argmax()), int(load.argmin())
        gap = load[big] - load[small]
        a, b = np.flatnonzero(place == big), np.append(np.flatnonzero(place == small), -1)
        if not len(a) or gap <= 1:
            break
        give = size[a][:, None] - np.where(b >= 0, size[b], 0)[None, :]
        after = np.abs(gap - 2 * give)
        least = after.min()
        if least >= gap:
            break
        near = after <= max(least, min(gap / 4, load.mean() * 1e-5))
        tilt = np.abs((count[big] - count[small]) - 2 * (rows[a][:, None] - np.where(b >= 0, rows[b], 0)[None, :]))
        i, j = np.unravel_index(np.argmin(np.where(near, tilt, np.inf)), after.shape)
        x, y = a[i], b[j]
        place[x] = small
        for c, at, to in ((x, big, small), (y, small, big)):
            if c >= 0:
                load[at] -= size[c]
                load[to] += size[c]
                count[at] -= rows[c]
                count[to] += rows[c]
        if y >= 0:
            place[y] = big
    return place


def measures() -> dict[str, Column]:
    """size, tokens, text_crc32 and a 128-bit key of the text."""
    text = F.coalesce("text", F.lit(""))
    return {
        "size": (F.octet_length(text) + 1).cast("long"),
        "tokens": F.regexp_count(text, F.lit(r"\S+")).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "text_a": F.xxhash64(text),
        "text_b": F.xxhash64(F.lit(0x5EED), text),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures; texts are not moved."""
    return docs.select("doc_id", *(c.alias(k) for k, c in measures().items()))


def in_sequence(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures and ``at``: each row's place in the sequence of the files that it was read from (by task, file of the task and row), or of the plan where ``docs`` is no table of files."""
    keep = ["doc_id", "source", *(c.alias(k) for k, c in measures().items())]
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    try:
        at = F.struct(number(r"part-(\d+)").alias("task"), number(r"-c(\d+)").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row"))
        return docs.select(*keep, at.alias("at"))
    except AnalysisException:
        zero = F.lit(0).cast("long")
        return docs.select(*keep, F.struct(zero.alias("task"), zero.alias("file"), F.lit("").alias("name"), F.monotonically_increasing_id().alias("row")).alias("at"))


def shard(docs: DataFrame, shards: int = SHARDS, crates: int = CRATES, heavy: int | None = None, order: DataFrame | None = None) -> DataFrame:
    """doc_id, size, tokens, text_crc32, text_a, text_b, crate, shard, slot for each row.

    A group of over 1/``heavy`` of the table (2 * ``shards`` by default) is cut.
    ``order`` has the same rows as ``docs``: doc_id, source, the measures and ``at``; ``source`` and ``at`` are then kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    rows = measured(docs) if order is None else order
    rows = scratch.keep(rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "measured")
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    size, count = total["size"] or 0, total["rows"]
    groups = rows.groupBy("text_a", "text_b").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    share = F.greatest(F.col("s") / max(size, 1), F.col("n") / max(count, 1))
    # at most 2 * LARGE groups
    large = groups.filter(share > 1 / LARGE).select("text_a", "text_b", F.least("n", F.ceil(share * (heavy or 2 * shards))).cast("int").alias("pieces")).orderBy("text_a", "text_b").collect()
    first = np.append(0, np.cumsum([r["pieces"] for r in large]))
    own = spark.createDataFrame([(*r, crates + int(k)) for r, k in zip(large, first, strict=False)], "text_a long, text_b long, pieces int, first int")
    rows = rows.join(F.broadcast(own), ["text_a", "text_b"], "left")
    rows = rows.withColumn("crate", F.coalesce(F.col("first") + F.pmod("deal", "pieces"), F.pmod("text_a", F.lit(crates))).cast("int")).drop("pieces", "first")
    sums = rows.groupBy("crate").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("crate").collect()
    place = pack(np.array([(r["size"], r["tokens"], r["rows"]) for r in sums], np.int64).reshape(-1, 3), shards)
    columns = ["doc_id", "size", "tokens", "text_crc32", "text_a", "text_b", "crate", "shard"]
    if order is not None:
        where = spark.createDataFrame([(r["crate"], int(p)) for r, p in zip(sums, place, strict=True)], "crate int, shard int")
        return in_order(rows.join(F.broadcast(where), "crate")).select(*columns, "slot", "source", "at")
    begin, used = [], [0] * shards
    for r, p in zip(sums, place, strict=True):
        begin.append((r["crate"], int(p), used[p]))
        used[p] += r["rows"]
    where = spark.createDataFrame(begin, "crate int, shard int, begin long")
    rows = rows.withColumn("lane", F.pmod(F.shiftright("deal", 20), F.lit(LANES)).cast("int"))
    lanes = rows.groupBy("crate", "lane").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("crate").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lanes = lanes.select("crate", "lane", before.alias("before")).join(F.broadcast(where), "crate").select("crate", "lane", "shard", (F.col("begin") + F.col("before")).alias("begin"))
    number = F.row_number().over(W.partitionBy("crate", "lane").orderBy("doc_id", "text_a", "text_b"))
    rows = rows.withColumn("number", number).join(lanes, ["crate", "lane"])
    return rows.select(*columns, (F.col("begin") + F.col("number") - 1).cast("long").alias("slot"))


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with the gapless ``slot`` of each in its shard's sequence by ``at``."""
    rows = rows.withColumn("stretch", F.struct("at.task", "at.file", "at.name", F.expr(f"at.row div {STRETCH}").alias("part")))
    ends = rows.groupBy("shard", "stretch").agg(F.count("*").alias("n"))
    begin = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("shard", "stretch", begin.alias("begin"))
    number = F.row_number().over(W.partitionBy("shard", "stretch").orderBy("at", "doc_id", "text_a", "text_b"))
    return rows.withColumn("number", number).join(ends, ["shard", "stretch"]).withColumn("slot", (F.col("begin") + F.col("number") - 1).cast("long"))


def shard_documents(docs: DataFrame, order: DataFrame | None = None, **options) -> DataFrame:
    """The documents with ``shard`` and ``slot``; rows alike in doc_id and text share the smallest slot's shard and get their slots in any order."""
    key = ["doc_id", *(["source"] if order is not None else []), "text_a", "text_b"]
    number = lambda *more: F.row_number().over(W.partitionBy(*key).orderBy(*more))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.drop("shard", "slot", "text_a", "text_b", "copy").withColumns({"text_a": F.xxhash64(text), "text_b": F.xxhash64(F.lit(0x5EED), text)})
    keyed = keyed.withColumn("copy", number("text_a"))
    placed = shard(docs, order=order, **options).withColumn("copy", number("slot")).select(*key, "copy", "shard", "slot")
    a, b = keyed.alias("a"), placed.alias("b")
    same = F.lit(True)
    for k in [*key, "copy"]:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if k in ("doc_id", "source") else F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, same).select("a.*", "b.shard", "b.slot").drop("text_a", "text_b", "copy")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder a shard; files hold rows in slot order."""
    placed = shard_documents(docs, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
