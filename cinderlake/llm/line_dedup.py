"""Line deduplication with levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.  Keys are held as 128-bit
hashes (two 64-bit hashes of different seeds) in *runs*: tables hashed into ``buckets`` and sorted by hash within
each.  A new batch reduces its lines to one row a key (partial aggregation first, so a line found in a third of all
documents costs one row a task), merge-anti-joins every run without moving or sorting the run's rows, and adds what is new as a run of
level 0.  ``fanout`` runs of a level are compacted into one run of the next: a merge join of their sorted buckets, one task and one new file a bucket, without a shuffle.

Who owns a key: the smallest doc_id of the first batch that held it.  With batches in doc_id order that is the smallest
doc_id of all.  A document keeps its lines with owned keys and its lines with short keys; the decision goes back as
the set of keys each document owns, one row a document, so that no join has a hot key.

Edge cases: null or empty text is one empty line, kept.  Rows with one doc_id count as one document and each of them keeps
the lines owned by that id.  A null doc_id counts as the largest id.  Repeated lines within the owner stay.  An empty table gives no rows.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

BLANK = " \t\n\x0b\x0c\r"
MIN_KEY = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 9223372036854775807  # stands for a null doc_id


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), _UPPER, _LOWER)


def _high(key: Column) -> Column:
    return F.xxhash64(key)


def _low(key: Column) -> Column:
    return F.xxhash64(F.lit(0x5EED), key)


@contextlib.contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made in here take a bucket of one file as sorted, as it was written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """A store of owned line hashes; ``add`` takes batches, ``apply`` removes lines that others own, ``release`` ends its use of the catalog."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2, min_key: int = MIN_KEY):
        self.spark, self.fanout, self.min_key = spark, fanout, min_key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "line-runs")
        self.levels: list[list[str]] = [[]]

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _save(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(self.buckets, "high", "low").sortBy("high", "low")
        # hashes neither compress nor repeat
        writer = writer.option("compression", "none").option("parquet.enable.dictionary", "false")
        writer.option("path", self.scratch.path(name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def keys(self, docs: DataFrame) -> DataFrame:
        """One row for each distinct key of the batch with the smallest doc_id that has it."""
        lines = docs.select(
            F.coalesce("doc_id", F.lit(LAST_ID)).alias("owner"),
            F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"),
        ).select("owner", line_key(F.col("line")).alias("key"))
        lines = lines.filter(F.char_length("key") >= self.min_key)
        hashed = lines.select("owner", _high(F.col("key")).alias("high"), _low(F.col("key")).alias("low"))
        return hashed.groupBy("high", "low").agg(F.min("owner").alias("owner"))

    def _unseen(self, new: DataFrame) -> DataFrame:
        for name in self.runs:
            new = new.join(self.spark.table(name).select("high", "low").hint("merge"), ["high", "low"], "left_anti")
        return new

    def add(self, docs: DataFrame) -> None:
        """Anti-join the batch's keys with all runs, add the new ones as a run and compact full levels."""
        with sorted_scans(self.spark):
            self.levels[0].append(self._save(self._unseen(self.keys(docs)).repartition(self.buckets, "high", "low")))
            level = 0
            while len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._compact(self.levels[level]))
                self.levels[level] = []
                level += 1

    def _merged(self, one: str, other: str) -> DataFrame:
        """No key is in two runs, so an outer merge join of their buckets is the merge."""
        b = self.spark.table(other).withColumnRenamed("owner", "owner_b").hint("merge")
        return self.spark.table(one).join(b, ["high", "low"], "full_outer").select("high", "low", F.coalesce("owner", "owner_b").alias("owner"))

    def _compact(self, names: list[str]) -> str:
        name = names[0]
        for other in names[1:]:
            merged = self._save(self._merged(name, other))
            for old in (name, other):
                self._drop(old)
            name = merged
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema("high long, low long, owner long").parquet(self.scratch.path(name))

    def release(self) -> None:
        """Forget the tables in the session's catalog; their files stay for frames that ``apply`` gave."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def apply(self, docs: DataFrame) -> DataFrame:
        """doc_id, text, n_lines, n_dropped, kept_text: each row of ``docs`` after dropping lines owned elsewhere.

        In-row membership: the few keys that are not owned are dealt into about sqrt(lines) lists, so that a text of n lines takes n ** 1.5 steps at most.
        """
        if not self.runs:
            owned = self.spark.createDataFrame([], "owner long, high long")
        else:
            owned = self._read(self.runs[0]).select("owner", "high")
            for name in self.runs[1:]:
                owned = owned.unionByName(self._read(name).select("owner", "high"))
        mine = owned.groupBy("owner").agg(F.collect_list("high").alias("mine"))
        base = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("owner"))

        def hashed(line: Column) -> Column:
            key = line_key(line)
            return F.when(F.char_length(key) >= self.min_key, _high(key))

        none = F.array().cast("array<bigint>")
        rows = base.join(mine, "owner", "left").select("doc_id", "text", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), F.coalesce("mine", none).alias("mine"))
        rows = rows.withColumn("hashes", F.transform("lines", hashed))
        rows = rows.withColumn("lost", F.array_except(F.array_compact("hashes"), "mine")).drop("mine")
        rows = rows.withColumn("ways", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("lost")))).cast("int"))
        rows = rows.withColumn(
            "lists",
            F.when(F.size("lost") > 0, F.transform(F.sequence(F.lit(0), F.col("ways") - 1), lambda k: F.filter("lost", lambda h: F.pmod(h, F.col("ways")) == k))),
        )
        stays = lambda h: h.isNull() | ~F.array_contains(F.get(F.col("lists"), F.pmod(h, F.col("ways")).cast("int")), h)
        kept = F.when(F.size("lost") == 0, F.col("lines")).otherwise(F.filter("lines", lambda line, i: stays(F.get(F.col("hashes"), i))))
        rows = rows.withColumn("kept", kept)
        return rows.select(
            "doc_id",
            "text",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("kept_text"),
        )


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_key: int = MIN_KEY) -> DataFrame:
    """Deduplicate a whole table, taken as ``batches`` doc_id ranges in ascending order."""
    spark = docs.sparkSession
    runs = LineRuns(spark, fanout=fanout, min_key=min_key)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        runs.add(docs)
    else:
        step = (high - low) // batches + 1
        for k in range(batches):
            start, end = low + k * step, low + (k + 1) * step
            part = (F.col("doc_id") >= start) & (F.col("doc_id") < end)
            if k == batches - 1:
                part = (F.col("doc_id") >= start) | F.col("doc_id").isNull()
            runs.add(docs.filter(part))
    out = runs.apply(docs)
    runs.release()
    return out


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_SQL_KEY = r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, {_SQL_KEY} AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS dropped FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
