"""Grouping spelling variants by a symmetric-delete join.

Words are counted a document at a time (each task adds up what it sees, then counts are summed by word).  Every word gives itself and its distinct single
deletions as keys: the keys are hashes, got for all deletions of a word from prefix sums, so a word of L code points costs L keys of 16 bytes and no
string is copied.  Two words at distance one share exactly one key: the shorter word itself, or the two words without the code point that differs.
Words that share a key are paired once, by number; each pair's distance is then computed exactly, so that keys that collide or words two edits apart fall out.
Aggregation gives each word its near words' count and its form; forms are joined on until every word has its root, twice as far each round.

Scale: counts are added before the shuffle, so a hot word is a row a task.  The pairs are of distinct words only; at most (L + 1) x 90 words have one key of
L code points, whatever the number of documents.  Joins are merges by hint, as written tables of words
and numbers are far larger in memory than on disk, so that Spark would broadcast them through the driver; adaptive execution splits what is uneven.  A root is at most log2(n) forms away,
as n at least doubles from form to form, so rounds are few.

``mark`` deletes a code point of some runs before they are counted (h = crc32 of ``<doc_id>:<run>``; if ``mark`` divides h, the code point h % length).

Edge cases: a null text has no words; a null doc_id is written as the empty text; repeated rows count each time; a text is read in blocks cut between
runs, so very long texts need no more memory than their longest run; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .textvec import BASE, INVERSE, mix

MARK, LETTERS, TIMES, RATIO = 97, 5, 3, 2
BLOCK, HELD = 1 << 20, 1 << 18  # code points of a block; words that a task holds before it gives their counts

RUN = re.compile("[a-z\u00c0-\u00ff]+")
OTHER = re.compile("[^a-z\u00c0-\u00ff]")


def blocks(text: str) -> Iterator[str]:
    """Pieces of about ``BLOCK`` code points, cut between runs."""
    at = 0
    while len(text) - at > BLOCK:
        cut = OTHER.search(text, at + BLOCK)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def counts(docs: DataFrame, mark: int = MARK, letters: int = LETTERS) -> DataFrame:
    """word, n: of all words of at least ``letters`` code points."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, lower in zip(batch.column("doc_id"), pc.ascii_lower(batch.column("text")), strict=True):
                seed = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for block in blocks(lower.as_py() or ""):
                    for word, n in Counter(RUN.findall(block)).items():
                        if len(word) < letters:  # it only gets shorter
                            continue
                        h = zlib.crc32(word.encode(), seed)
                        if h % mark == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < letters:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield give()
        yield give()

    texts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def delete_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each word (its own, then a key for each distinct deletion), and where each word's begin and end."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    end = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = np.append(0, end[:-1])
    n = len(points)
    power, back = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n + 1, b, np.uint64))) for b in (BASE, INVERSE))
    prefix = np.append(np.uint64(0), np.cumsum((points + np.uint64(1)) * power[:n]))
    size = end - begin
    whole = (prefix[end] - prefix[begin]) * back[begin]
    first = np.ones(n, bool)  # of a run of one code point: the others give the same word
    first[1:] = points[1:] != points[:-1]
    first[begin[size > 0]] = True
    at = np.flatnonzero(first)
    word = np.searchsorted(end, at, "right")
    b, e = begin[word], end[word]
    less = (prefix[at] - prefix[b]) * back[b] + (prefix[e] - prefix[at + 1]) * back[b + 1]
    mixed = [mix(h + k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for h, k in ((whole, size), (less, e - b - 1))]
    order = np.argsort(np.append(np.arange(len(words)), word), kind="stable")
    return np.concatenate(mixed)[order].view(np.int64), np.append(0, np.cumsum(1 + np.bincount(word, minlength=len(words))))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b (numbers), word_a, n_a, word_b, n_b: each pair of ``words`` (id, word, n) at distance one, once."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, ends = delete_keys(batch.column("word"))
            ids = np.repeat(batch.column("id").to_numpy(), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(ids)], schema=schema)

    keys = words.select("id", "word").mapInArrow(keyed, "key long, id long")
    pairs = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")).hint("merge"), "key").filter("a < b").select("a", "b").distinct()
    left, right = (words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(F.levenshtein("word_a", "word_b", 1) == 1)


def variants(docs: DataFrame, mark: int = MARK, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``letters`` code points that occurs ``times`` times."""
    scratch = Scratch(docs.sparkSession, "spelling")
    found = scratch.keep(counts(docs, mark, letters).filter(F.col("n") >= times), "words")
    words = scratch.keep(found.withColumn("id", F.monotonically_increasing_id()), "numbered")
    pairs = scratch.keep(near_pairs(words), "pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.struct((-F.col("n_b")).alias("less"), F.col("word_b").alias("word"), F.col("b").alias("id")).alias("to")),
                                          F.struct(F.col("b").alias("id"), F.struct((-F.col("n_a")).alias("less"), F.col("word_a").alias("word"), F.col("a").alias("id")).alias("to")))).alias("p")).select("p.*")
    best = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("to").alias("to"))
    enough = -F.col("to.less") >= F.lit(ratio) * F.col("n")
    linked = words.join(best.hint("merge"), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *(F.when(enough, c).alias(a) for a, c in (("form", F.col("to.word")), ("form_n", -F.col("to.less")), ("form_id", F.col("to.id")))),
    )
    linked = scratch.keep(linked, "linked")
    # a word with a form points to it, then to what that points to, until nothing moves
    points, moved, k = scratch.keep(linked.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id")), "points-0"), 1, 0
    while moved:
        k += 1
        on = points.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        stepped = points.join(on.hint("merge"), "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved"))
        points = scratch.keep(stepped, f"points-{k}")
        moved = points.filter("moved").limit(1).count()
    roots = points.select("id", "root_id").join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")).hint("merge"), "root_id").select("id", "root")
    return linked.join(roots.hint("merge"), "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
