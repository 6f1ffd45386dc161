"""N-gram Jaccard self-join: MinHash banding, then verification on full word 5-gram sets.

Steps, all distributed:

1. ``signatures``: one pass over the texts gives each document a 128-bit fingerprint of its shingle set and its band hashes.
   Bands and rows are chosen so that a pair at the threshold shares a band with at least the target recall.
2. Documents with one shingle set are a class of copies; from here on only class representatives (smallest doc_id) count.
3. Representatives that share a band hash form a bucket.  A bucket is cut into blocks of about ``block`` members and ``block_shingles`` shingles at
   most and handled by pairs of blocks, so no task holds a whole hot bucket or many long texts, and none of its pairs is lost.
4. ``plan``: of a block pair, only pairs that share no earlier band are open here, so each pair is verified
   once; only members with open pairs fetch their shingle sets.
5. ``verify``: exact Jaccard on the sets.  A block pair gives each member's number of linked documents and a spanning
   forest of its links, not the pairs; the number of rows stays linear in the members.
6. Connected components over the forest edges (large-star and small-star rounds on DataFrames).

Edge cases: null and empty texts, and texts without words, have the empty shingle set and are copies of each other; texts of 1 to 4 words
have one shingle of all their words.  Rows repeating a doc_id: rows with equal shingle sets are one document; if the
sets differ, the row with the smallest fingerprint counts.  Rows with a null doc_id take no part and give no rows.  Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, table, whole_groups
from .textvec import fold, minhash, mix, ngrams, pieces, tokens

WORDS, THRESHOLD, RECALL, MAX_HASHES, BLOCK, BLOCK_SHINGLES = 5, 0.8, 0.9999, 128, 1000, 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose band count for the recall stays within ``most`` hash functions."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1) if threshold < 1 else (1, 1)
    for rows in range(1, 17):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _shingles(column, words: int):
    return ngrams(tokens(column), words, short=True)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, fp_a, fp_b (fingerprint of the shingle set), shingles (their number), bands (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in pieces(whole.column(1))):
            grams = _shingles(batch.column(1), words)
            n = batch.num_rows
            fp = np.zeros((n, 2), np.uint64)
            for i in np.flatnonzero(grams.count):
                s = np.unique(grams.hash[grams.offset[i] : grams.offset[i + 1]])
                fp[i] = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
            folded = fold(minhash(grams, bands * rows).reshape(n, bands, rows))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(folded.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), pa.array(grams.count.astype(np.int64)), lists], ["doc_id", "fp_a", "fp_b", "shingles", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp_a long, fp_b long, shingles long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """rep, shingles: the sorted distinct shingle hashes as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in pieces(whole.column(1))):
            grams = _shingles(batch.column(1), words)
            packed = [np.unique(grams.hash[a:b]).tobytes() for a, b in zip(grams.offset[:-1], grams.offset[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


UNIT = ["band", "hash", "low", "high"]


def _matrix(column: pa.ChunkedArray, bands: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, bands) if len(column) else np.zeros((0, bands), np.int64)


def _open(sig: np.ndarray, block: np.ndarray, i: int, band: int, low: int, high: int) -> np.ndarray:
    """Positions of i's partners in this unit: in the other block (or later in the same one), with no earlier common band."""
    if low == high:
        js = np.arange(i + 1, len(sig))
    else:
        js = np.flatnonzero(block == high) if block[i] == low else np.zeros(0, np.int64)
    if band and len(js):
        js = js[~(sig[js, :band] == sig[i, :band]).any(axis=1)]
    return js


def _plan(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for t, at in whole_groups(batches, UNIT):
        sig, block = _matrix(t.column("bands"), bands), t.column("block").to_numpy()
        band, low, high = (t.column(k).to_numpy() for k in ("band", "low", "high"))
        need = np.zeros(t.num_rows, bool)
        for a, b in zip(at[:-1], at[1:], strict=True):
            s = sig[a:b]
            for i in range(b - a):
                js = _open(s, block[a:b], i, band[a], low[a], high[a])
                if len(js):
                    need[a + i] = True
                    need[a + js] = True
        yield from t.filter(pa.array(need)).combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch], bands: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for t, at in whole_groups(batches, UNIT):
        sig, block, rep, copies = _matrix(t.column("bands"), bands), t.column("block").to_numpy(), t.column("rep").to_numpy(), t.column("copies").to_numpy()
        band, low, high = (t.column(k).to_numpy() for k in ("band", "low", "high"))
        packed = pa.concat_arrays(c.cast(pa.large_binary()) for c in t.column("shingles").chunks)
        offs = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 8
        flat = np.frombuffer(packed.buffers()[2], np.uint64)
        out_rep, out_root, out_links = [], [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = b - a
            size = np.diff(offs[a : b + 1]).astype(np.int64)
            part = flat[offs[a] : offs[b]]
            known, ids = np.unique(part, return_inverse=True)
            own = (offs[a : b + 1] - offs[a]).astype(np.int64)
            mark = np.zeros(len(known), np.int32)
            links, parent = np.zeros(n, np.int64), np.arange(n)

            def find(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            linked = np.zeros(n, bool)
            for i in range(n):
                js = _open(sig[a:b], block[a:b], i, band[a], low[a], high[a])
                # a smaller set cannot reach the threshold with a set of over size / threshold
                js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i]) - 1e-9]
                if not len(js):
                    continue
                mark[ids[own[i] : own[i + 1]]] = 1
                length = size[js]
                if len(js) == js[-1] - js[0] + 1:
                    common = np.add.reduceat(mark[ids[own[js[0]] : own[js[-1] + 1]]], own[js] - own[js[0]])
                else:
                    pos = np.repeat(own[js] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
                    common = np.add.reduceat(mark[ids[pos]], np.append(0, np.cumsum(length)[:-1]))
                mark[ids[own[i] : own[i + 1]]] = 0
                good = js[common >= threshold * (length + size[i] - common) - 1e-9]
                if len(good):
                    linked[i] = linked[good] = True
                    links[i] += copies[a + good].sum()
                    links[good] += copies[a + i]
                    root = find(i)
                    for j in good:
                        other = find(int(j))
                        if other != root:
                            parent[max(root, other)] = min(root, other)
                            root = min(root, other)
            for i in np.flatnonzero(linked):
                out_rep.append(rep[a + i])
                out_root.append(rep[a + find(int(i))])
                out_links.append(links[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_rep, pa.int64()), pa.array(out_root, pa.int64()), pa.array(out_links, pa.int64())], ["rep", "root", "links"])


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, class_id: the smallest node of each connected component (alternating large-star and small-star rounds)."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    mark, k, rows = None, 0, now.count()
    while True:
        k += 1
        near = both(now)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = join_hot(near.filter("v > u"), least.filter("n > 0"), ["u"], "n", rows).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = scratch.keep(large.select(F.col("a").alias("u"), F.col("b").alias("v")), f"large-{k}")
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(down, least, ["u"], "n", rows).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = scratch.keep(small.distinct(), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        scratch.drop(f"large-{k}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        rows = seen[0]
        if seen == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("class_id"))
        mark = seen


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, copy_of (smallest doc_id with the same shingle set), class_id (smallest doc_id of the connected
    component of links), n_links (other documents with Jaccard at or over the threshold, copies included)."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    sig = scratch.keep(signatures(docs, words, bands, rows), "signatures")
    full = (F.col("shingles") > 0).alias("full")
    ids = scratch.keep(sig.groupBy("doc_id").agg(F.min(F.struct("fp_a", "fp_b", full)).alias("s")).select("doc_id", "s.*"), "ids")
    n = ids.count()
    reps = scratch.keep(ids.groupBy("fp_a", "fp_b", "full").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "representatives")

    first = sig.join(reps.filter("full").select("fp_a", "fp_b", F.col("rep").alias("doc_id"), "copies"), ["doc_id", "fp_a", "fp_b"], "inner").dropDuplicates(["doc_id"])
    first = scratch.keep(first.select(F.col("doc_id").alias("rep"), "copies", "shingles", "bands"), "first")
    keys = first.select("rep", "shingles", F.posexplode("bands").alias("band", "hash"))
    crowded = keys.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("shingles").alias("all")).filter("n > 1")
    met = join_hot(keys, crowded, ["band", "hash"], "n", first.count() * bands).withColumn("ways", F.greatest(F.ceil(F.col("n") / block), F.least("n", F.ceil(F.col("all") / block_shingles))).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("ways")).cast("int")).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    met = met.select("rep", "band", "hash", "block", F.least("block", "peer").alias("low"), F.greatest("block", "peer").alias("high"))
    units = met.join(first.drop("shingles"), "rep")
    planned = scratch.keep(_by_unit(units, lambda it: _plan(it, bands)), "planned")
    wanted = planned.select("rep").distinct()
    sets = _sets(docs.withColumnRenamed("doc_id", "rep").join(wanted, "rep").dropDuplicates(["rep"]), words)
    packed = planned.join(sets, "rep")
    found = scratch.keep(_by_unit(packed, lambda it: _verify(it, bands, threshold), "rep long, root long, links long"), "found")
    classes = components(scratch, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # representatives get their class first; then documents get it with their representative, of which one may stand for a third of all
    labels = reps.join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.select("fp_a", "fp_b", "full", "copies", F.col("rep").alias("copy_of"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    labels = scratch.keep(labels, "labels")
    return join_hot(ids, labels, ["fp_a", "fp_b", "full"], "copies", n).select("doc_id", "copy_of", "class_id", "n_links")


def _by_unit(df: DataFrame, run, schema=None) -> DataFrame:
    return df.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, schema or df.schema)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: of each class of near-duplicates the document with the smallest doc_id stays; null ids stay."""
    classes = jaccard_join(docs, **options)
    gone = classes.filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
