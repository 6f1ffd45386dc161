"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A shingle is a run of 5 words; a text of 1 to 4 words has one shingle, all its words.  A short test item inside a long document has a
tiny Jaccard similarity with it, so documents are searched by windows.  Items are partitioned by their number of distinct shingles into
classes of at most u = 8, 16, 32, ... shingles.
For a class, documents are cut into windows of 2u shingle positions that start every u positions: any passage of u
positions lies whole inside some window, whose Jaccard similarity with an item of over u/2 shingles is at least
0.8 / (2 * 2 + 1 - 0.8) ~ 0.19.  ``hashes`` MinHash bands of one row each then find it with probability 1 - (1 - 0.19) ** hashes.
Window signatures come from minima over 8 positions, of which larger windows take minima again.
Items of up to 4 shingles are held whole or not at all at 0.8: their window is one shingle, the smallest one, which is its own exact key.
Shingles of 1 to 4 words are looked for only at the lengths that the benchmark has.

The benchmark may be large, so it is not broadcast: a bitmap of its band values, sized by their number, screens the windows, and
another screens the documents' shingles; what passes is shuffled to the benchmark's rows and joined exactly there.  A document that passes sends its screened
shingles, one row each.  Boilerplate that many items share must not multiply documents by items: to contain ``threshold`` of an item a document
needs one of any ``n - ceil(threshold * n) + 1`` of its shingles, so documents meet items on that many of each item's rarest shingles only.
Pairs that met so, share a band value and hold at least ``threshold`` of the item's shingles are results.

Edge cases: items without words match nothing; null texts are empty; repeated item rows
with one id are one item (all their shingles together); of rows that repeat a doc_id those with a hit count as one document; null ids take no part (``drop_contaminated``
searches rows without an id under a hash of their text); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table
from .textvec import PIECE, Tokens, mix, ngrams, permutations, pieces, tokens

WORDS, THRESHOLD, HASHES, BASE, SMALL = 5, 0.8, 48, 8, 4
NONE = np.uint32(0xFFFFFFFF)
EXACT = 63  # the class of items of up to SMALL shingles
BITS = (16, 28)  # least and most bits of a bitmap's index: 8 kB to 32 MB; a fuller bitmap screens less and loses nothing


def size_class(n: int) -> int:
    """Smallest c with n <= 8 * 2 ** c."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / BASE))))


def band_key(klass: int, k: int, value: np.ndarray) -> np.ndarray:
    return mix(value.astype(np.uint64) | (np.uint64(k) << np.uint64(32)) | (np.uint64(klass) << np.uint64(48)))


def _whole(t: Tokens, n: int) -> Tokens:
    """The shingle of each text that has just ``n`` words; none of other texts."""
    return ngrams(Tokens(t.hash[np.repeat(t.count == n, t.count)], np.append(0, np.cumsum(np.where(t.count == n, n, 0)))), n)


def exact_key(shingles: np.ndarray) -> np.ndarray:
    return mix(shingles ^ np.uint64(EXACT))


def _items(items: DataFrame, words: int, threshold: float, hashes: int) -> DataFrame:
    """item_id, keys (band keys), shingles, n, short (lengths of texts under ``words`` words), klass."""
    masks, factors = permutations(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = tokens(pa.array(texts, pa.string()))
                short = sorted({int(c) for c in t.count if 0 < c < words})
                whole = np.concatenate([ngrams(t, words).hash, *(_whole(t, c).hash for c in short)])
                s = np.unique(whole)
                if not len(s):
                    continue
                x = (s >> np.uint64(32)).astype(np.uint32)
                if len(s) <= SMALL or short:  # one of any so many shingles must be held
                    c, keys = EXACT, exact_key(s[: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1])
                else:
                    c = size_class(len(s))
                    keys = np.concatenate([band_key(c, k, ((x ^ masks[k]) * factors[k]).min()[None]) for k in range(hashes)])
                out.append((i, keys.view(np.int64).tolist(), s.view(np.int64).tolist(), len(s), short, c))
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["item_id", "keys", "shingles", "n", "short", "klass"])

    grouped = items.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.collect_set(F.coalesce("text", F.lit(""))).alias("texts"))
    return grouped.mapInArrow(run, "item_id long, keys array<long>, shingles array<long>, n long, short array<int>, klass int")


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of column ``key``, by its top ``bits`` bits; at most 2 ** (bits - 6) words reach the driver."""
    at = F.shiftrightunsigned("key", 64 - bits)
    word = F.shiftright(at, 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63L as int))")
    rows = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return out


def _has(bits: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - size)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _search(docs: DataFrame, words: int, hashes: int, bits: int, band_bits, shingle_size: int, shingle_bits, classes: list[int], lengths: list[int]) -> DataFrame:
    """doc_id, kind (0: band key, 1: shingle), key: what documents with a window hit have in common with the benchmark.

    ``lengths``: the words of shingles that are looked up by themselves, for items of few or short shingles."""
    masks, factors = permutations(hashes)
    windows = [c for c in classes if c != EXACT]

    def piece(ids: np.ndarray, column: pa.Array) -> pa.RecordBatch:
        words_of = tokens(column)
        grams = ngrams(words_of, words)
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        n = len(grams.hash)
        found = np.zeros(len(ids), bool)
        more = {w: grams if w == words else ngrams(words_of, w) for w in lengths}
        for g in more.values():
            keys = exact_key(g.hash)
            hit = np.flatnonzero(_has(band_bits.value, bits, keys))
            if len(hit):
                doc = np.repeat(np.arange(len(ids)), g.count)[hit]
                found[doc] = True
                out.append((doc, 0, keys[hit]))
        if n and windows:
            owner = np.repeat(np.arange(len(ids)), grams.count)
            blocks = -(-n // BASE)
            x = np.zeros(blocks * BASE, np.uint32)
            x[:n] = (grams.hash >> np.uint64(32)).astype(np.uint32)
            first = owner[np.arange(blocks) * BASE]
            last = owner[np.minimum(np.arange(blocks) * BASE + BASE - 1, n - 1)]
            for k in range(hashes):
                v = (x ^ masks[k]) * factors[k]
                v[n:] = NONE
                level = v.reshape(blocks, BASE).min(axis=1)
                for c in range(max(windows) + 1):
                    if c:
                        level = np.append(level, NONE) if len(level) % 2 else level
                        level = np.minimum(level[0::2], level[1::2])
                    if c not in windows:
                        continue
                    window = np.minimum(level, np.append(level[1:], NONE))
                    keys = band_key(c, k, window)
                    hit = np.flatnonzero(_has(band_bits.value, bits, keys))
                    if len(hit):
                        a = first[hit << c]
                        b = last[np.minimum((hit + 2 << c) - 1, blocks - 1)]
                        span = b - a + 1
                        docs_hit = np.repeat(a, span) + np.arange(span.sum()) - np.repeat(np.append(0, np.cumsum(span)[:-1]), span)
                        found[docs_hit] = True
                        out.append((docs_hit, 0, np.repeat(keys[hit], span)))
        if found.any():
            for g in {words: grams, **more}.values():
                owner = np.repeat(np.arange(len(ids)), g.count)
                mine = np.flatnonzero(found[owner])
                mine = mine[_has(shingle_bits.value, shingle_size, g.hash[mine])]
                out.append((owner[mine], 1, g.hash[mine]))
        doc = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64)
        kind = np.concatenate([np.full(len(o[0]), o[1], np.int32) for o in out]) if out else np.zeros(0, np.int32)
        key = np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(kind), pa.array(key.view(np.int64))], ["doc_id", "kind", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0).to_numpy(), batch.column(1)
            for a, b in pieces(text, PIECE):
                yield piece(ids[a:b], text.slice(a, b - a))

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, kind int, key long")


def bitmap_bits(keys: int) -> int:
    """Bits of the index of a bitmap that ``keys`` hashes fill to about a thirty-second."""
    return min(max(BITS[0], int(np.ceil(np.log2(max(keys, 1) * 32)))), BITS[1])


def contamination(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """doc_id, item_id, common (shingles of the item in the document), item_shingles, containment: pairs at or over the threshold."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    index = scratch.keep(_items(items, words, threshold, hashes), "items")
    schema = "doc_id long, item_id long, common long, item_shingles long, containment double"
    # one row for each class, so as many as the logarithm of the largest item
    classes = index.groupBy("klass").agg(F.sum(F.size("keys")).alias("keys"), F.sum("n").alias("shingles"), F.array_distinct(F.flatten(F.collect_set("short"))).alias("short")).collect()
    if not classes:
        return spark.createDataFrame([], schema)
    lengths = sorted({w for r in classes for w in r["short"]} | {words for r in classes if r["klass"] == EXACT})
    keys = index.select(F.explode("keys").alias("key"))
    shingles = index.select("item_id", "n", F.explode("shingles").alias("key"))
    sizes = [bitmap_bits(sum(r[c] for r in classes)) for c in ("keys", "shingles")]
    sc = spark.sparkContext
    band_bits, shingle_bits = sc.broadcast(bitmap(keys, sizes[0])), sc.broadcast(bitmap(shingles, sizes[1]))
    met = scratch.keep(_search(docs, words, hashes, sizes[0], band_bits, sizes[1], shingle_bits, [r["klass"] for r in classes], lengths), "met")
    held = met.filter("kind = 1").select("doc_id", "key").distinct()
    # an item's rarest shingles: without one of them a document cannot reach the threshold
    shared = shingles.groupBy("key").agg(F.count("*").alias("items"))
    place = F.row_number().over(W.partitionBy("item_id").orderBy("items", "key"))
    needed = F.ceil(F.col("n") * threshold - 1e-9)
    rare = shingles.join(shared, "key").withColumn("place", place).filter(F.col("place") <= F.col("n") - needed + 1).select("item_id", "key")
    pairs = held.join(rare, "key").select("doc_id", "item_id").distinct()
    banded = pairs.join(index.select("item_id", F.explode("keys").alias("key")), "item_id").join(met.filter("kind = 0").select("doc_id", "key"), ["doc_id", "key"], "left_semi")
    candidates = banded.select("doc_id", "item_id").distinct().join(shingles, "item_id")
    common = candidates.join(held, ["doc_id", "key"]).groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("common")).filter(F.col("common") >= needed)
    return common.select("doc_id", "item_id", "common", F.col("n").alias("item_shingles"), (F.col("common") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Pipeline stage: documents that contain a test item go; all others stay, with their columns."""
    key = F.coalesce("doc_id", F.xxhash64(F.lit("no id"), F.coalesce("text", F.lit(""))))
    gone = contamination(docs.select(key.alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, key == F.col("gone"), "left_anti").select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
