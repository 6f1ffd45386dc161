"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's documents are put in a hash order and cut into blocks.  With weight w (of a total of 1), block k of a source is released at
floor(k / w) and due at ceil((k + 1) / w); at each slot the released block with the earliest deadline runs (ties: the first source by name).  As weights
add up to 1 every block meets its window, so each source is less than one block off its ideal share at every slot, however
long the schedule is.  Weights are taken as whole numbers, with ``DIGITS`` decimals below the largest one's first digit, and all arithmetic is exact.  When a source is used up its slots stay idle; the other sources keep their proportions.  No row is dropped or repeated: the
mix is an order, by (slot, place).

The schedule is cut into segments of ``segment`` slots that are built in parallel, a row each.  What a segment needs of all slots before it is which sources' open blocks
(released before, due after its start; one a source at most) have run.  With c(a) = the blocks released before slot a, less a, blocks can stay open
if and only if, for every a up to the start, at most c(a) of those released before a stay.  So each segment gives the least c(a) of its slots, a running minimum over the
segments in which one block is open gives the bound at the block's release, and earliest deadline first leaves
open the blocks of latest deadlines that these bounds allow.  A segment then runs its slots from that state.

Numbering a source without one task for the hot source: rows are dealt into at most 4096 parts a source by a hash of doc_id,
numbered within each part, and a part begins where the source's earlier parts end.

Default weights are the sources' byte shares to the power ``temperature``.  Edge cases: a null source is a
source of its own; null doc_ids sort last in their part; repeated rows and ties are ordered by text; an empty table gives no
rows; a source with no weight, or none above 0, has no share: its blocks follow after all others in turn; if no source has one, all are equal.
The number of sources is taken as bounded: they are one row's array, and a slot takes a step a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

SEGMENT, BLOCK, TEMPERATURE, DIGITS = 512, 16, 0.5, 10


def targets(sources: DataFrame) -> DataFrame:
    """source, weight, blocks -> one row: list (source, rank, w, blocks), total (of w), slots (until the last source is used up)."""
    row = sources.agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), "blocks"))).alias("given"))
    row = row.filter("size(given) > 0").selectExpr("given", "array_max(transform(given, x -> x.weight)) AS top")
    whole = f"CASE WHEN top <= 0 THEN 1 WHEN x.weight > 0 THEN greatest(1, cast(round(x.weight * pow(10D, {DIGITS} - floor(log10(top)))) AS bigint)) ELSE 0 END"
    row = row.selectExpr(f"transform(given, (x, i) -> named_struct('source', x.source, 'rank', i + 1, 'w', cast({whole} AS bigint), 'blocks', x.blocks)) AS list")
    row = row.selectExpr("list", "aggregate(list, 0L, (a, x) -> a + x.w) AS total")
    last = "cast((cast(x.blocks AS decimal(18, 0)) * cast(total AS decimal(18, 0)) + x.w - 1) div x.w AS bigint)"
    return row.selectExpr("list", "total", f"array_max(transform(filter(list, x -> x.w > 0), x -> {last})) AS slots")


def _segments(spark: SparkSession, row: DataFrame, slots: int, segment: int) -> DataFrame:
    """p, total, s (rank, w, blocks, base, rem): at the segment's start a source has ``base`` whole blocks due and ``rem`` of ``total`` of the next one."""
    segs = spark.range(-(-slots // segment)).withColumnRenamed("id", "p").crossJoin(F.broadcast(row.select("list", "total")))  # one row
    at = f"cast(p * {segment} AS decimal(20, 0)) * cast(x.w AS decimal(18, 0))"
    segs = segs.selectExpr("p", "total", f"transform(filter(list, x -> x.w > 0), x -> named_struct('rank', x.rank, 'w', x.w, 'blocks', x.blocks, 'at', {at})) AS s")
    return segs.selectExpr("p", "total", "transform(s, x -> named_struct('rank', x.rank, 'w', x.w, 'blocks', x.blocks, 'base', x.at div total, 'rem', cast(x.at % total AS bigint))) AS s")


def _open_blocks(segs: DataFrame, segment: int) -> DataFrame:
    """p, late: the ranks of sources whose open block has not run when segment p starts; no row where there are none."""
    owed = segs.selectExpr("p", "total", "s", "aggregate(s, 0L, (a, x) -> a + x.rem) div total AS owed")
    least = "aggregate(s, 0L, (a, x) -> a + (x.rem + t * x.w + total - 1) div total) - owed - t"
    ends = owed.selectExpr("p", "total", "s", f"transform(sequence(1, {segment}), t -> {least}) AS backlog")
    ends = ends.selectExpr("p", "total", "backlog", f"filter(transform(s, x -> named_struct('x', x, 'j', (x.rem + {segment} * x.w) div total)), y -> (y.x.rem + {segment} * y.x.w) % total > 0) AS s")
    ends = ends.selectExpr("p", "total", "backlog", "inline(s)")
    begin = "CASE WHEN j = 0 THEN -((x.rem + x.w - 1) div x.w) ELSE (j * total - x.rem) div x.w END"
    ends = ends.selectExpr("p + 1 AS p", "x.rank AS rank", "x.base + j AS k", f"{begin} AS begin", f"((j + 1) * total - x.rem + x.w - 1) div x.w - {segment} AS due", "backlog")
    ends = ends.selectExpr("p", "rank", "k", f"begin - {segment} AS begin", "due", f"array_min(slice(backlog, greatest(begin, 0) + 1, {segment})) AS low")
    ends = ends.withColumn("low", F.min("low").over(W.partitionBy("rank", "k").orderBy("p")))
    states = ends.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("due", "rank", "begin", "low"))).alias("open"))
    room = "forall(acc.room, y -> y.begin < x.begin OR y.low >= 1)"
    taken = "named_struct('room', transform(acc.room, y -> named_struct('begin', y.begin, 'low', y.low - IF(y.begin >= x.begin, 1, 0))), 'late', array_append(acc.late, x.rank))"
    start = "named_struct('room', transform(open, y -> named_struct('begin', y.begin, 'low', y.low)), 'late', cast(array() AS array<int>))"
    return states.selectExpr("p", f"aggregate(reverse(open), {start}, (acc, x) -> IF({room}, {taken}, acc), acc -> acc.late) AS late")


def schedule(spark: SparkSession, row: DataFrame, slots: int, segment: int = SEGMENT) -> DataFrame:
    """rank, block, slot: the slot of each block under earliest deadline first; ``row`` as ``targets`` gives it."""
    segs = _segments(spark, row, slots, segment)
    segs = segs.join(_open_blocks(segs, segment), "p", "left")
    job = lambda x, j: (
        f"named_struct('due', (({j} + 1) * total - {x}.rem + {x}.w - 1) div {x}.w, 'rank', {x}.rank, 'begin', IF({j} = 0, 0, ({j} * total - {x}.rem) div {x}.w), "
        f"'j', {j}, 'w', {x}.w, 'rem', {x}.rem, 'base', {x}.base, 'blocks', {x}.blocks)"
    )
    first = "IF(y.rem = 0 OR array_contains(late, y.rank), 0L, 1L)"
    segs = segs.selectExpr("p", "total", f"transform(s, y -> {job('y', first)}) AS s")
    # the pick is bound as a lambda's variable, so that it is found once a slot
    pick = "array(array_min(filter(acc.s, x -> x.begin <= t)))"
    run = f"named_struct('s', transform(acc.s, x -> IF(x.rank = y.rank, {job('x', '(x.j + 1)')}, x)), 'ran', array_append(acc.ran, named_struct('rank', y.rank, 'block', y.base + y.j, 'real', y.base + y.j < y.blocks)))"
    start = "named_struct('s', s, 'ran', cast(array() AS array<struct<rank: int, block: bigint, real: boolean>>))"
    ran = segs.selectExpr("p", f"aggregate(sequence(0, {segment - 1}), {start}, (acc, t) -> transform({pick}, y -> {run})[0], acc -> acc.ran) AS ran")
    return ran.selectExpr("p", "posexplode(ran) AS (at, run)").filter("run.real").selectExpr("run.rank AS rank", "run.block AS block", f"p * {segment} + at AS slot")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, segment: int = SEGMENT, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, source, text_key, block (number within the source), slot, place (within the block)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("bytes"))
    rows = scratch.keep(rows.withColumn("part", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 3)), "rows")
    parts = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sources = parts.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.ceil(F.sum("n") / block).alias("blocks"))
    if weights is None:
        # the root of whole bytes, so that every engine gets the same shares
        sources = sources.select("source", F.pow(F.col("bytes").cast("double"), temperature).alias("weight"), "blocks")
    else:
        given = weights.select(F.col("source").alias("given"), "weight")
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select("source", "weight", "blocks")
    row = scratch.keep(targets(sources), "targets")
    slots = (row.select("slots").first() or [0])[0]
    begin = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("source", "part", begin.alias("begin")).alias("a")
    ranks = row.selectExpr("slots", "size(list) AS sources", "inline(list)").alias("b")
    parts = parts.join(ranks, F.col("a.source").eqNullSafe(F.col("b.source"))).selectExpr("a.source AS s", "part AS p", "begin", "rank", "slots", "sources")
    place = F.row_number().over(W.partitionBy("source", "part").orderBy(F.col("doc_id").asc_nulls_last(), "text_key")) - 1
    rows = rows.withColumn("place", place)
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["s"]) & (rows["part"] == parts["p"]))
    rows = rows.withColumn("index", (F.col("begin") + F.col("place")).cast("long")).withColumn("block", F.expr(f"index div {block}"))
    rows = rows.join(schedule(spark, row, slots, segment), ["rank", "block"], "left")
    slot = F.coalesce("slot", F.col("slots") + F.col("block") * F.col("sources") + F.col("rank") - 1)
    return rows.select("doc_id", "source", "text_key", "block", slot.alias("slot"), (F.col("index") % block).alias("place"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents in the order of the mix: the written files, in sequence, are the schedule (``sharding.in_sequence`` reads it)."""
    order = mix(docs, **options).groupBy("doc_id", "source", "text_key").agg(F.min(F.struct("slot", "place")).alias("at"))
    key = F.md5(F.coalesce(F.col("a.text"), F.lit("")))
    a, b = docs.alias("a"), order.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (key == F.col("b.text_key"))
    return a.join(b, same).orderBy("b.at").select("a.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "place")


ORACLE = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key, strlen(coalesce(text, '')) + 1 AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS part FROM documents),
sources AS (SELECT source, pow(CAST(sum(size) AS DOUBLE), 0.5) AS weight, (count(*) + 15) // 16 AS blocks FROM rows_ GROUP BY source),
ranked AS (
  SELECT source, blocks, greatest(1, CAST(round(weight * pow(10.0, 10 - floor(log10(max(weight) OVER ())))) AS BIGINT)) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS rank
  FROM sources),
fixed AS (
  SELECT list(w ORDER BY rank) AS ws, CAST(sum(w) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n,
         max(CAST((blocks * CAST(t AS HUGEINT) + w - 1) // w AS BIGINT)) AS slots
  FROM (SELECT *, sum(w) OVER () AS t FROM ranked)),
sched AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(range(1, n + 1), lambda i: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM fixed
  UNION ALL
  SELECT slot, list_transform(range(1, n + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (
    SELECT s.slot + 1 AS slot, done, n,
           list_min(list_filter(list_transform(range(1, n + 1), lambda i:
             struct_pack(d := ((done[i] + 1) * total + ws[i] - 1) // ws[i], i := i, r := (done[i] * total) // ws[i])),
             lambda x: x.r <= s.slot + 1)).i AS pick
    FROM sched s, fixed WHERE s.slot + 1 < slots)),
turns AS (SELECT pick AS rank, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn FROM sched WHERE slot >= 0),
indexed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY part, doc_id NULLS LAST, text_key) - 1 AS idx FROM rows_)
SELECT i.doc_id, i.source, idx // 16 AS block, CAST(t.slot AS BIGINT) AS slot, CAST(idx % 16 AS BIGINT) AS place
FROM indexed i JOIN ranked s ON i.source IS NOT DISTINCT FROM s.source
JOIN turns t ON t.rank = s.rank AND t.turn = idx // 16
"""
